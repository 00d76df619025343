"""Deeply nested JSON records to flat related tables with Merkle subtree identities.

Every object becomes a row, of the kind a rule gives it or of kind ``object``. Objects are canonicalised (sorted keys) and hashed
bottom-up, an object's hash being made of its values and its children's hashes, so equal subtrees have equal hashes wherever they
occur. ``objects`` stores each distinct object once, with the objects in it replaced by their hashes; ``occurrences`` keeps every place
it stood, with its parent and ordinal; ``rebuilt`` puts the records together again from these two. ``flat`` makes the table of one
kind, with what no rule names written out in place.

Defined results: a null, empty, broken or non-object body (and one nested deeper than the JSON parser goes) gives no rows; nulls and
bare values where a rule expects an object give none but keep their index; rows with the same id and path count once (redelivered
records repeat their body); rows with a null id are ignored; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "record_id string, node_path string, parent_path string, node_kind string, ordinal int, node_hash string, parent_hash string, content string"
_ARROW = pa.schema([("record_id", pa.string()), ("node_path", pa.string()), ("parent_path", pa.string()), ("node_kind", pa.string()), ("ordinal", pa.int32()), ("node_hash", pa.string()), ("parent_hash", pa.string()), ("content", pa.string())])


@dataclass(frozen=True)
class Rule:
    """Objects of ``kind`` stand under an object of kind ``within`` ('' is the record) at ``path``.

    A last step ``*`` takes the elements of an array, or the values of an object in its place; without it the value itself.
    A step ending in ``?`` may hold its value as a JSON string, which is decoded.
    """

    kind: str
    within: str
    path: tuple[str, ...]


def _decoded(value):
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return None
    return value


def _places(owner: dict, rule: Rule):
    """(keys to the value, value, its container, its key or index, ordinal) for each object the rule finds under owner."""
    at, where = owner, []
    steps = rule.path
    for i, step in enumerate(steps):
        soft = step.endswith("?")
        name = step[:-1] if soft else step
        if name == "*":
            if isinstance(at, list):
                entries = [(f"[{k}]", k, v) for k, v in enumerate(at)]
            elif isinstance(at, dict):
                entries = [(f".{k}", n, v) for n, (k, v) in enumerate(at.items())]
            else:
                return
            for suffix, n, v in entries:
                v = _decoded(v) if soft else v
                if isinstance(v, dict):
                    yield ".".join(where) + suffix, v, n
            return
        if not isinstance(at, dict) or name not in at:
            return
        at = at[name]
        if soft:
            at = _decoded(at)
        where.append(name)
        if i == len(steps) - 1 and isinstance(at, dict):
            yield ".".join(where), at, 0


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


INNER = "object"  # kind of the objects that no rule names


def shred_one(record: dict, rules: dict[str, list[Rule]], inline: bool = True, content: bool = True) -> list[tuple]:
    """Rows of one record: (path, parent path, kind, ordinal, hash, parent's hash, content).

    inline: rows of the rule objects alone; their content has the objects that no rule names written out. Else every object has a row,
    and content holds the hashes of the objects directly below. Hashes are the same in both forms. content: whether it is wanted at all
    (of inline rows; where only places and identities count, it need not be written).
    """
    found: list[tuple] = []  # path, parent path, kind, ordinal, object
    stack: list[tuple[dict, str, str]] = [(record, "", "")]
    while stack:
        owner, kind, path = stack.pop()
        for rule in rules.get(kind, ()):
            for suffix, obj, n in _places(owner, rule):
                full = f"{path}.{suffix}" if path and not suffix.startswith("[") else path + suffix
                found.append((full, path, rule.kind, n, obj))
                stack.append((obj, rule.kind, full))
    ruled = {id(x[4]) for x in found}
    hash_of: dict[int, str] = {}
    hash_at: dict[str, str | None] = {"": None}
    rows: list[tuple] = []

    def identified(v, at: str, owner: str, n: int):
        if isinstance(v, list):
            return [identified(x, f"{at}[{k}]", owner, k) for k, x in enumerate(v)]
        if not isinstance(v, dict):
            return v
        if id(v) not in hash_of:
            note(v, at, owner, INNER, n)
        return {"$": hash_of[id(v)]}

    def note(obj: dict, at: str, owner: str, kind: str, n: int) -> None:
        reduced = _dumped({k: identified(x, f"{at}.{k}", at, i) for i, (k, x) in enumerate(obj.items())})
        hash_of[id(obj)] = hash_at[at] = h = _sha(kind + "\0" + reduced)
        if not inline:
            rows.append((at, owner, kind, n, h, reduced))
        elif kind != INNER and not content:
            rows.append((at, owner, kind, n, h, None))
        elif kind != INNER:
            rows.append((at, owner, kind, n, h, _dumped({k: _written_out(x, hash_of, ruled) for k, x in obj.items()})))

    for full, parent, kind, n, obj in reversed(found):  # children come after their parents, so this is bottom-up
        note(obj, full, parent, kind, n)
    return [(*r[:5], hash_at[r[1]], r[5]) for r in reversed(rows)]


def _dumped(value) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def _written_out(v, hash_of: dict[int, str], ruled: set[int]):
    """A value with the rule objects in it replaced by their hashes, and all others written out."""
    if isinstance(v, list):
        return [_written_out(x, hash_of, ruled) for x in v]
    if isinstance(v, dict):
        return {"$": hash_of[id(v)]} if id(v) in ruled else {k: _written_out(x, hash_of, ruled) for k, x in v.items()}
    return v


def shred(df: DataFrame, id: str, body: str, rules: list[Rule], inline: bool = False, content: bool = True) -> DataFrame:
    """One row per object of every record (inline: per rule object), with its path, parent, ordinal, hash and content. See shred_one."""
    by_owner: dict[str, list[Rule]] = {}
    for r in rules:
        by_owner.setdefault(r.within, []).append(r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    record = json.loads(text)
                    if isinstance(record, dict):
                        rows.extend((rid, *r) for r in shred_one(record, by_owner, inline, content))
                except (ValueError, RecursionError):
                    continue
                if len(rows) > 20_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    some = df.select(F.col(id).cast("string").alias("record_id"), F.col(body).cast("string").alias("body")).filter("record_id is not null and body is not null")
    return some.mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    clean = [[None if v is None else v.encode("utf-8", "replace").decode() if isinstance(v, str) else v for v in col] for col in zip(*rows)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(clean, _ARROW)], schema=_ARROW)


def occurrences(shredded: DataFrame) -> DataFrame:
    """The bridge table: every place of every object, once."""
    return shredded.select("record_id", "node_path", "parent_path", "node_kind", "ordinal", "node_hash", "parent_hash").dropDuplicates(["record_id", "node_path"])


def objects(shredded: DataFrame) -> DataFrame:
    """The distinct objects, each stored once. Partial aggregation keeps a copy per map task, so a hot object moves little."""
    return shredded.groupBy("node_hash", "node_kind").agg(F.first("content").alias("content"))


def flat(shredded: DataFrame, kind: str, fields: dict[str, str | tuple[str, ...]]) -> DataFrame:
    """The flat table of one kind (of an inline shred): keys and parent link, and a column for each JSON path of ``fields``.

    Several paths are followed one after the other, so a value on the way may be JSON within a string.
    """
    rows = shredded.filter(F.col("node_kind") == kind).dropDuplicates(["record_id", "node_path"])
    return rows.select("record_id", "node_path", "parent_path", "ordinal", "node_hash", *[reduce(F.get_json_object, [p] if isinstance(p, str) else p, F.col("content")).alias(c) for c, p in fields.items()])


def rebuilt(objects: DataFrame, occurrences: DataFrame) -> DataFrame:
    """The top rule objects of every record, put together from the two tables: record_id, node_path, json, leaves (values in it), leaf_chars.

    The rows of a record come together; equal objects are told apart by nothing, so a hash is enough to put one in its places.
    """
    placed = occurrences.select("record_id", "node_path", "parent_path", "node_kind", "node_hash").join(objects.select("node_hash", "content"), "node_hash")
    whole = placed.groupBy("record_id").agg(F.collect_list(F.struct("node_path", "parent_path", "node_kind", "node_hash", "content")).alias("nodes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for rid, nodes in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                stored = {n["node_hash"]: n["content"] for n in nodes}
                for n in nodes:
                    if not n["parent_path"] and n["node_kind"] != INNER:
                        value = _put_together(json.loads(n["content"]), stored)
                        leaves = list(_leaves(value))
                        out.append((rid, n["node_path"], _dumped(value), len(leaves), sum(map(len, leaves))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["record_id", "node_path", "json", "leaves", "leaf_chars"])

    return whole.mapInArrow(run, "record_id string, node_path string, json string, leaves long, leaf_chars long")


def _put_together(v, stored: dict[str, str]):
    if isinstance(v, list):
        return [_put_together(x, stored) for x in v]
    if isinstance(v, dict):
        if v.keys() == {"$"} and v["$"] in stored:
            return _put_together(json.loads(stored[v["$"]]), stored)
        return {k: _put_together(x, stored) for k, x in v.items()}
    return v


def _leaves(v) -> Iterator[str]:
    if isinstance(v, dict):
        for x in v.values():
            yield from _leaves(x)
    elif isinstance(v, list):
        for x in v:
            yield from _leaves(x)
    else:
        yield "" if v is None else v if isinstance(v, str) else json.dumps(v)
