"""Schemas that drift between the JSON files of a series: a change report and one consistent table.

Files of a series (``group``) are read in order. Every file's nested schema is a tree of keys with typed leaves. For each transition
the tree edit distance between what ended and what began gives the cheapest script of deletions, insertions, renames and moves; the
scripts compile into a projection (old path to current path) that is applied to every file.

Where it runs: files are placed by (group, block of ``block`` consecutive numbers), so a group that holds a third of all files is
spread; a block is summed up, in order, to one record a path (first and last file, type runs), and only these summaries meet by
group. Summaries merge in order and grow with the number of paths and type changes, not with the number of files.

Fields: a leaf is a value that is no object; arrays are leaves. A null has no type but is present. An object standing where a leaf
stood before retypes the leaf, and what lies below it is no field. Unreadable payloads (null, empty, broken, not an object) are
passed over. Redelivered files repeat their content and change nothing. Rows with a null group or number are ignored; a group with
one readable file has no change; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut

BLOCK = 4096
RENAME, MOVE, BOTH, DELETE, INSERT = 1.0, 1.2, 1.6, 1.0, 1.0
_SHAPES = [
    ("time", re.compile(r"\d{4}-\d\d-\d\d([T ].*)?")),
    ("mime", re.compile(r"[a-z]+/[\w.+-]+")),
    ("hex", re.compile(r"[0-9a-f]{8,}")),
    ("number", re.compile(r"[+-]?\d+(\.\d+)?")),
    ("file", re.compile(r"\S+\.[A-Za-z]\w{0,4}")),
    ("phrase", re.compile(r".*\s.*", re.S)),
]


def json_type(v) -> str | None:
    if v is None:
        return None
    if isinstance(v, bool):
        return "boolean"
    return {str: "string", int: "integer", float: "number", list: "array", dict: "object"}[type(v)]


def shape(v) -> str:
    """The sort of a value within its JSON type."""
    if isinstance(v, str):
        return next((name for name, p in _SHAPES if p.fullmatch(v)), "word")
    if isinstance(v, float):
        return "share" if 0 <= v <= 1 else "amount"
    return ""


def walk(record: dict) -> Iterator[tuple[str, object]]:
    """Every path with its value; objects come before what is below them."""
    stack = [(k, v) for k, v in reversed(record.items())]
    while stack:
        path, v = stack.pop()
        yield path, v
        if isinstance(v, dict):
            stack.extend((f"{path}.{k}", x) for k, x in reversed(v.items()))


def parse(payload: str | None) -> dict | None:
    try:
        o = json.loads(payload) if payload else None
    except (ValueError, RecursionError):
        return None
    return o if isinstance(o, dict) else None


class Summary:
    """What a block of consecutive files says about each path.

    leaf: path -> [first, last, next file after the last, runs [[seq, type]..], shapes]; held: the same for objects at paths that
    were no leaf before in this block.
    """

    def __init__(self) -> None:
        self.first: int | None = None
        self.last: int | None = None
        self.leaf: dict[str, list] = {}
        self.held: dict[str, list] = {}

    def add(self, seq: int, record: dict) -> None:
        if self.first is None:
            self.first = seq
        if self.last is not None and seq != self.last:
            for kept in (self.leaf, self.held):
                for x in kept.values():
                    if x[1] == self.last:
                        x[2] = seq
        shadow: str | None = None
        for path, v in walk(record):
            if shadow is not None and path.startswith(shadow):
                continue
            shadow = None
            kind = json_type(v)
            known = self.leaf.get(path)
            if kind == "object" and (known is None or not known[3] or known[3][0][0] >= seq):
                x = self.held.setdefault(path, [seq, seq, None])
                x[1], x[2] = seq, None
                continue
            if known is None:
                known = self.leaf[path] = [seq, seq, None, [], {}]
            known[1], known[2] = seq, None
            if kind is None:
                continue
            if not known[3] or known[3][-1][1] != kind:
                known[3].append([seq, kind])
            s = known[4].setdefault(kind, [])
            sort = shape(v)
            if sort not in s:
                s.append(sort)
            if kind == "object":
                shadow = path + "."
        self.last = seq

    def dumps(self) -> str:
        return json.dumps([self.first, self.last, self.leaf, self.held])


def merge(blocks: Iterable[str]) -> dict[str, list]:
    """Summaries of one group, in order, to one: path -> [first, last, next file after the last, runs, shapes], plus the first file."""
    out: dict[str, list] = {}
    before: int | None = None
    start: int | None = None
    for text in blocks:
        first, last, leaf, held = json.loads(text)
        start = first if start is None else start
        if before is not None:
            for x in out.values():
                if x[1] == before:
                    x[2] = first
        typed = {p for p, x in out.items() if x[3]}

        def hidden(path: str) -> bool:
            parts = path.split(".")
            return any(".".join(parts[:i]) in typed for i in range(1, len(parts)))

        for path, (a, z, gone) in held.items():
            if path in typed and not hidden(path):
                _join(out, path, [a, z, gone, [[a, "object"]], {"object": [""]}])
        for path, x in leaf.items():
            if not hidden(path):
                _join(out, path, x)
        before = last
    return {"": [start, before, None, [], {}], **out}


def _join(out: dict[str, list], path: str, x: list) -> None:
    known = out.get(path)
    if known is None:
        out[path] = [x[0], x[1], x[2], list(x[3]), dict(x[4])]
        return
    if x[1] >= known[1]:
        known[1], known[2] = x[1], x[2]
    known[0] = min(known[0], x[0])
    runs = sorted(known[3] + x[3], key=lambda r: r[0])
    known[3] = [r for i, r in enumerate(runs) if i == 0 or runs[i - 1][1] != r[1]]
    for kind, s in x[4].items():
        known[4][kind] = sorted({*known[4].get(kind, []), *s})


def assignment(cost: list[list[float]]) -> list[int]:
    """Cheapest assignment of rows to columns (rows <= columns), by shortest augmenting paths."""
    n, m = len(cost), len(cost[0]) if cost else 0
    u, v, of = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        of[0], col = i, 0
        low, came, used = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while True:
            used[col] = True
            row, delta, nxt = of[col], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[row - 1][j - 1] - u[row] - v[j]
                    if c < low[j]:
                        low[j], came[j] = c, col
                    if low[j] < delta:
                        delta, nxt = low[j], j
            for j in range(m + 1):
                if used[j]:
                    u[of[j]] += delta
                    v[j] -= delta
                else:
                    low[j] -= delta
            col = nxt
            if of[col] == 0:
                break
        while col:
            of[col] = of[came[col]]
            col = came[col]
    out = [-1] * n
    for j in range(1, m + 1):
        if of[j]:
            out[of[j] - 1] = j - 1
    return out


def _alike(a: tuple, b: tuple) -> bool:
    return a[0] is not None and a[0] == b[0] and bool(set(a[1]) & set(b[1]))


def _tree(fields: dict[str, tuple]) -> dict:
    root: dict = {}
    for path, leaf in fields.items():
        at = root
        *above, key = path.split(".")
        for k in above:
            nxt = at.get(k)
            if not isinstance(nxt, dict):
                nxt = at[k] = {}
            at = nxt
        at.setdefault(key, leaf)
    return root


def _size(t) -> int:
    return sum(map(_size, t.values())) if isinstance(t, dict) else 1


def _distance(a, b) -> tuple[float, list[tuple[str, str]]]:
    """Top-down edit distance of two unordered key trees, with the pairs of leaves (paths below a and b) that are kept or renamed."""
    if not isinstance(a, dict) or not isinstance(b, dict):
        if isinstance(a, dict) or isinstance(b, dict) or not _alike(a, b):
            return float("inf"), []
        return 0.0, [("", "")]
    ka, kb = list(a), list(b)
    n = len(ka) + len(kb)
    big = 1e9
    pairs = {(i, j): _distance(a[x], b[y]) for i, x in enumerate(ka) for j, y in enumerate(kb)}
    cost = [[big] * n for _ in range(n)]
    for i, x in enumerate(ka):
        for j, y in enumerate(kb):
            cost[i][j] = min(big, pairs[i, j][0] + (RENAME if x != y else 0))
        for j in range(len(kb), n):
            cost[i][j] = DELETE * _size(a[x])
    for i in range(len(ka), n):
        for j, y in enumerate(kb):
            cost[i][j] = INSERT * _size(b[y])
        for j in range(len(kb), n):
            cost[i][j] = 0.0
    total, kept = 0.0, []
    for i, j in enumerate(assignment(cost)):
        total += cost[i][j]
        if i < len(ka) and j < len(kb):
            kept += [(f"{ka[i]}.{p}" if p else ka[i], f"{kb[j]}.{q}" if q else kb[j]) for p, q in pairs[i, j][1]]
    return total, kept


def edit_script(ended: dict[str, tuple], begun: dict[str, tuple]) -> list[tuple[str, str, str]]:
    """Cheapest script from the ended fields to the begun ones: (renamed, old, new), (removed, old, ''), (added, new, '').

    Fields are path -> (type, shapes). The tree distance keeps fields under one parent together; what it deletes and inserts is then
    matched across parents, as a move costs less than a deletion and an insertion.
    """
    _, kept = _distance(_tree(ended), _tree(begun))
    pairs = {a: b for a, b in kept if a in ended and b in begun}
    gone, new = [p for p in ended if p not in pairs], [p for p in begun if p not in set(pairs.values())]
    if gone and new:
        n = len(gone) + len(new)
        cost = [[1e9] * n for _ in range(n)]
        for i in range(n):
            for j in range(n):
                if i < len(gone) and j < len(new):
                    if _alike(ended[gone[i]], begun[new[j]]):
                        cost[i][j] = MOVE if gone[i].rpartition(".")[2] == new[j].rpartition(".")[2] else BOTH
                else:
                    cost[i][j] = 0.0 if i >= len(gone) and j >= len(new) else DELETE
        for i, j in enumerate(assignment(cost)):
            if i < len(gone) and j < len(new):
                pairs[gone[i]] = new[j]
    taken = set(pairs.values())
    return [("renamed", a, b) for a, b in pairs.items()] + [("removed", p, "") for p in ended if p not in pairs] + [("added", p, "") for p in begun if p not in taken]


def changes_of(summary: dict[str, list]) -> list[tuple[int, str, str, str]]:
    """(seq, path, kind, new path) of one merged group."""
    start = summary[""][0]
    ended: dict[int, dict[str, tuple]] = {}
    begun: dict[int, dict[str, tuple]] = {}
    out: list[tuple[int, str, str, str]] = []
    for path, (first, _last, gone, runs, shapes) in summary.items():
        if not path:
            continue
        out += [(r[0], path, "retyped", "") for r in runs[1:]]
        if gone is not None:
            kind = runs[-1][1] if runs else None
            ended.setdefault(gone, {})[path] = (kind, shapes.get(kind, [""]))
        if first != start:
            kind = runs[0][1] if runs else None
            begun.setdefault(first, {})[path] = (kind, shapes.get(kind, [""]))
    for seq in sorted({*ended, *begun}):
        out += [(seq, a, kind, b) for kind, a, b in edit_script(ended.get(seq, {}), begun.get(seq, {}))]
    return out


def _summaries(df: DataFrame, group: str, seq: str, payload: str, block: int) -> DataFrame:
    rows = df.select(F.col(group).cast("string").alias("g"), F.col(seq).cast("long").alias("s"), F.col(payload).cast("string").alias("p")).filter("g is not null and s is not null and p is not null")
    placed = rows.withColumn("b", F.floor(F.col("s") / block)).repartition("g", "b").sortWithinPartitions("g", "b", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now, out = None, Summary(), []
        for batch in batches:
            for g, s, p, b in zip(*(c.to_pylist() for c in batch.columns)):
                if (g, b) != at:
                    if at is not None and now.first is not None:
                        out.append((*at, now.dumps()))
                    at, now = (g, b), Summary()
                record = parse(p)
                if record is not None:
                    now.add(s, record)
            if len(out) > 500:
                yield _batch(out)
                out = []
        if at is not None and now.first is not None:
            out.append((*at, now.dumps()))
        if out:
            yield _batch(out)

    def _batch(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string()))], names=["g", "b", "summary"])

    return placed.mapInArrow(run, "g string, b long, summary string")


def changes(df: DataFrame, group: str, seq: str, payload: str, block: int = BLOCK) -> DataFrame:
    """Every change of every group: seq, field_path, change_kind (added, removed, renamed, retyped) and new_path."""
    placed = _summaries(df, group, seq, payload, block).repartition("g").sortWithinPartitions("g", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, texts, out = None, [], []
        for batch in batches:
            for g, _, text in zip(*(c.to_pylist() for c in batch.columns)):
                if g != at:
                    if texts:
                        out += [(at, *c) for c in changes_of(merge(texts))]
                    at, texts = g, []
                texts.append(text)
            if len(out) > 5000:
                yield _batch(out)
                out = []
        if texts:
            out += [(at, *c) for c in changes_of(merge(texts))]
        if out:
            yield _batch(out)

    def _batch(out: list) -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["grp", "seq", "field_path", "change_kind", "new_path"])

    return placed.mapInArrow(run, "grp string, seq long, field_path string, change_kind string, new_path string")


def current_paths(report: DataFrame) -> DataFrame:
    """The projection of each group: a map from every path that was renamed to its last name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for renames in batch.column(1).to_pylist():
                now: dict[str, str] = {}
                for r in sorted(renames, key=lambda r: (r["seq"], r["field_path"])):
                    for k, v in now.items():
                        if v == r["field_path"]:
                            now[k] = r["new_path"]
                    now[r["field_path"]] = r["new_path"]
                out.append(json.dumps(now))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["grp", "projection"])

    one = report.filter("change_kind = 'renamed'").groupBy("grp").agg(F.collect_list(F.struct("seq", "field_path", "new_path")).alias("r"))
    return one.mapInArrow(run, "grp string, projection string")


def unified(df: DataFrame, group: str, seq: str, payload: str, block: int = BLOCK) -> DataFrame:
    """One row per readable file, with its leaves under their current paths (a JSON object of path to value, keys sorted)."""
    script = current_paths(changes(df, group, seq, payload, block))
    rows = df.select(F.col(group).cast("string").alias("grp"), F.col(seq).cast("long").alias("seq"), F.col(payload).cast("string").alias("p")).filter("grp is not null and seq is not null and p is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, cache = [], {}
            for g, s, p, script in zip(*(c.to_pylist() for c in batch.columns)):
                record = parse(p)
                if record is None:
                    continue
                names = cache.get(script)
                if names is None:
                    names = cache[script] = json.loads(script) if script else {}
                flat = {names.get(path, path): v for path, v in walk(record) if not isinstance(v, dict) or not v}
                out.append((g, s, json.dumps(flat, sort_keys=True, ensure_ascii=True)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string()))], names=["grp", "seq", "fields"])

    joined = rows.join(script, "grp", "left").select("grp", "seq", "p", "projection")
    return joined.mapInArrow(run, "grp string, seq long, fields string").dropDuplicates(["grp", "seq"])


def cast_value(v, kind: str) -> str | None:
    """A value as text of the one type of its path: text itself for strings, else JSON."""
    if v is None or kind == "string" and isinstance(v, str):
        return v
    return json.dumps(float(v) if kind == "number" else v, sort_keys=True, ensure_ascii=False)


def table(df: DataFrame, group: str, seq: str, payload: str, block: int = BLOCK) -> DataFrame:
    """Every readable file with every current path of its group: grp, seq, path, type, value; null where the file has no value.

    A path has one type in all files of all groups: its own, number for integers and numbers, else string (a value of another type
    is then its JSON text). A path that only ever was null is a string.
    """
    files = cut(unified(df, group, seq, payload, block))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple] = set()
        for batch in batches:
            for g, fields in zip(*(c.to_pylist() for c in batch.columns)):
                found |= {(g, path, json_type(v)) for path, v in json.loads(fields).items()}
            if len(found) > 50_000:
                yield _columns(found, ("grp", "path", "type"))
                found = set()
        if found:
            yield _columns(found, ("grp", "path", "type"))

    def _columns(rows, names) -> pa.RecordBatch:
        types = {"seq": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.string())) for n, c in zip(names, zip(*rows))], names=list(names))

    paths = cut(files.select("grp", "fields").mapInArrow(seen, "grp string, path string, type string").distinct())
    kinds = F.collect_set("type")
    number = (F.size(kinds) == 2) & F.array_contains(kinds, "integer") & F.array_contains(kinds, "number")
    typed = paths.groupBy("path").agg(F.when(F.size(kinds) == 1, F.element_at(kinds, 1)).when(number, "number").otherwise("string").alias("type"))
    full = paths.select("grp", "path").distinct().join(typed, "path").groupBy("grp").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("path", "type"))))).alias("types"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, cache = [], {}
            for g, n, fields, types in zip(*(c.to_pylist() for c in batch.columns)):
                here = json.loads(fields)
                of = cache.get(types)
                if of is None:
                    of = cache[types] = json.loads(types)
                out += [(g, n, path, kind, cast_value(here.get(path), kind)) for path, kind in of.items()]
            if out:
                yield _columns(out, ("grp", "seq", "path", "type", "value"))

    return files.join(full, "grp").select("grp", "seq", "fields", "types").mapInArrow(fill, "grp string, seq long, path string, type string, value string")
