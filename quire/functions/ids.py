"""Deterministic identifiers."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_id(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the parts joined by '::'; a null part counts as 'None'."""
    texts = [F.coalesce(p.cast("string"), F.lit("None")) for p in parts]
    return F.substring(F.sha1(F.concat_ws("::", *texts)), 1, 16)


def document_id(uri: Column) -> Column:
    return short_id(F.lit("data-object"), uri)


def chunk_id(doc: Column, path: Column, start: Column, end: Column, suffix: str = "") -> Column:
    """SHA-256 of document, field path and 'start:end', written together."""
    return F.sha2(F.concat(doc, path, start.cast("string"), F.lit(":"), end.cast("string"), F.lit(suffix)), 256)


def params_hash(params: dict) -> str:
    return hashlib.sha256(json.dumps(params, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:12]


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
