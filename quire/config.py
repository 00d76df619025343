"""Configuration of a run."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from typing import Any

from quire.functions.ids import config_hash


@dataclass(frozen=True)
class ChunkEmbedConfig:
    """Chunker and embedder with their parameters; unknown keys are ignored, missing ones have defaults."""

    chunker: str = "recursive"
    chunker_params: dict[str, Any] = field(default_factory=dict)
    max_rows_per_chunk: int = 20
    embedder: str = "local_hash"
    embedder_params: dict[str, Any] = field(default_factory=dict)
    retrieval_profile: str = "hybrid_default"

    @classmethod
    def of(cls, value: Any) -> ChunkEmbedConfig:
        if not isinstance(value, dict):
            return cls()
        return cls(**{k: v for k, v in value.items() if k in cls.__dataclass_fields__})

    def hash(self) -> str:
        return config_hash(asdict(self))


@dataclass(frozen=True)
class InputConfig:
    """Which files of a folder to read. Extensions get a leading dot and lower case; none allows all."""

    path: str
    recursive: bool = True
    include_hidden: bool = False
    extensions: tuple[str, ...] = ()
    max_files: int | None = None
    max_bytes: int = 536_870_912

    def __post_init__(self) -> None:
        if isinstance(self.extensions, str):
            raise ValueError("extensions must be a list")
        if self.max_files is not None and (isinstance(self.max_files, bool) or self.max_files < 1):
            raise ValueError("max_files must be a positive number")
        object.__setattr__(self, "extensions", tuple(dict.fromkeys("." + e.lower().lstrip(".") for e in self.extensions if e.strip())))


def input_mode(explicit: dict[str, Any], configured: str) -> str:
    """The one explicit source, else the configured one: local, s3_object or inventory."""
    given = [k for k, v in explicit.items() if v]
    if len(given) > 1:
        raise ValueError(f"at most one input source may be given, not {given}")
    mode = given[0] if given else configured
    if mode not in ("local", "s3_object", "inventory"):
        raise ValueError(f"unknown input mode {mode!r}")
    return mode


def load(path: str | None) -> dict[str, Any]:
    """A configuration file: JSON, or YAML where its library is installed. Sections input, chunk_embed; no file is no setting."""
    if not path:
        return {}
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.lower().endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("YAML files need the yaml library; JSON needs none") from e
        found = yaml.safe_load(text)
    else:
        found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no configuration")
    return found


def input_config(settings: dict[str, Any], path: str) -> InputConfig:
    """Settings of the input section; unknown keys are ignored."""
    known = {k: v for k, v in settings.items() if k in InputConfig.__dataclass_fields__ and k != "path"}
    return InputConfig(path, **known)
