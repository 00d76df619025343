"""Plug-ins: chunkers (text to spans) and embedders (column to vector column)."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


@dataclass
class Unit:
    """A piece that a chunker makes in place of a span: its own text, and its place in a tree of units, by their numbers."""

    start: int
    end: int
    text: str
    level: int = 0
    parent: int | None = None
    children: list[int] = field(default_factory=list)
    chunk_type: str | None = None


_CHUNKERS: dict[str, dict[str, Any]] = {}
_ALIASES: dict[str, str] = {}
_EMBEDDERS: dict[str, type] = {}


def chunker(name: str, *, needs: tuple[str, ...] = (), aliases: tuple[str, ...] = ()) -> Callable:
    """Registers f(text, **params) -> [(start, end)] or [Unit]; with needs it is called with resources=. A name or alias in use is an error."""

    def add(f: Callable) -> Callable:
        for n in (name, *aliases):
            if n in _CHUNKERS or n in _ALIASES:
                raise ValueError(f"chunker {n!r} is registered already")
        _CHUNKERS[name] = {"name": name, "function": f, "needs": tuple(needs), "aliases": tuple(aliases)}
        _ALIASES.update(dict.fromkeys(aliases, name))
        return f

    return add


def embedder(name: str) -> Callable[[type], type]:
    def add(cls: type) -> type:
        if name in _EMBEDDERS:
            raise ValueError(f"embedder {name!r} is registered already")
        _EMBEDDERS[name] = cls
        return cls

    return add


def chunker_info(name: str) -> dict[str, Any]:
    found = _CHUNKERS.get(_ALIASES.get(name, name))
    if found is None:
        raise KeyError(f"unknown chunker {name!r}; known: {sorted(_CHUNKERS)}")
    return found


def get_chunker(name: str, resources: dict[str, Any] | None = None) -> Callable:
    info = chunker_info(name)
    missing = [n for n in info["needs"] if (resources or {}).get(n) is None]
    if missing:
        raise RuntimeError(f"chunker {name!r} needs {missing}")
    return info["function"]


def create_embedder(name: str, params: dict[str, Any] | None = None):
    if name not in _EMBEDDERS:
        raise KeyError(f"unknown embedder {name!r}; known: {sorted(_EMBEDDERS)}")
    return _EMBEDDERS[name](**(params or {}))


def load_plugins(package: str) -> list[str]:
    """Imports every module of a package, so that its registrations run."""
    base = importlib.import_module(package)
    return [importlib.import_module(f"{package}.{m.name}").__name__ for m in pkgutil.iter_modules(base.__path__)]
