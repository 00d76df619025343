"""Cutting oversized items into pieces under a limit, at natural boundaries.

Text: dynamic programming over boundary positions. A cut costs by kind of boundary (paragraph, line, sentence, clause, word, inside a
word), a piece costs the square of its deviation from the even size; the cheapest sequence of cuts under the maximum length wins.
Each piece but the first starts exactly ``overlap`` characters before the cut, so piece k+1 repeats the end of piece k.
Tables: limited by their data rows alone, whatever their length; pieces of at most max_rows whole rows, the header repeated in each.

Defined results: characters are code points; offsets are [start, end) within the item's text and, plus the item's own start, in its
document (-1 where the item's start is negative or null); table offsets cover the rows, not the repeated header; an overlap of half
the limit or more is taken as just under half of it; null texts and items without limits are never oversized; items with the same
id count once; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "id string, limit_kind string, piece int, pieces int, start int, end int, char_start int, char_end int, text string"
_BREAKS = [  # fixed values: boundary, cost of a cut there
    (re.compile(r"\n\s*\n\s*"), 0.0),
    (re.compile(r"\n[ \t]*"), 0.6),
    (re.compile(r"[.!?。！？…][\"'”’»)\]]*\s+|[。！？]"), 0.8),
    (re.compile(r"[;:,–—)\]][\"'”’»]*\s+"), 2.0),
    (re.compile(r"\s+"), 4.0),
]
INSIDE = 12.0
BALANCE = 6.0


def boundaries(text: str, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a piece may end, with the cost of each. Gaps longer than half of reach get positions inside words."""
    cost: dict[int, float] = {}
    for pattern, c in _BREAKS:
        for m in pattern.finditer(text):
            if 0 < m.end() < len(text):
                cost[m.end()] = min(c, cost.get(m.end(), c))
    at = np.array([0, *sorted(cost), len(text)])
    step = max(1, reach // 16)
    for a, z in zip(at[:-1], at[1:]):
        if z - a > reach // 2:
            for p in range(a + step, z, step):
                cost[int(p)] = INSIDE
    at = np.array(sorted(cost), dtype=np.int64)
    return at, np.array([cost[int(p)] for p in at])


def cut_text(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """[start, end) of the pieces of text, each at most limit long, consecutive ones sharing overlap characters."""
    n, limit = len(text), max(1, limit)
    overlap = max(0, min(overlap, (limit - 1) // 2))
    if n <= limit:
        return [(0, n)]
    reach = limit - overlap
    at, cost = boundaries(text, reach)
    at, cost = np.r_[at, n], np.r_[cost, 0.0]
    even = n / np.ceil((n - overlap) / reach)
    best, came = np.full(len(at), np.inf), np.full(len(at), -1)
    low = 0
    for j in range(len(at)):
        options = []
        if at[j] <= limit:
            options.append((BALANCE * ((at[j] - even) / even) ** 2, -1))
        while low < j and at[j] - at[low] > reach:
            low += 1
        if low < j:
            lengths = at[j] - at[low:j] + overlap
            total = best[low:j] + BALANCE * ((lengths - even) / even) ** 2
            k = int(np.argmin(total))
            options.append((float(total[k]), low + k))
        if options:
            c, k = min(options)
            best[j], came[j] = c + cost[j], k
    ends, j = [], len(at) - 1
    while j >= 0:
        ends.append(int(at[j]))
        j = int(came[j])
    ends.reverse()
    return [(0 if i == 0 else ends[i - 1] - overlap, e) for i, e in enumerate(ends)]


_SEPARATOR = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t\r]*")
_ROW = re.compile(r"<tr\b", re.I)


def table_rows(text: str) -> tuple[str, list[tuple[int, int]], str]:
    """Header to repeat, [start, end) of the data rows, and what closes the table."""
    if text.lstrip().startswith("<"):
        starts = [m.start() for m in _ROW.finditer(text)]
        data = [(a, z) for a, z in zip(starts, [*starts[1:], len(text)]) if re.search(r"<td\b", text[a:z], re.I)]
        if not data:
            return text, [], ""
        m = re.search(r"</tbody\s*>|</table\s*>", text[data[-1][0] :], re.I)
        end = data[-1][0] + m.start() if m else len(text)
        data[-1] = (data[-1][0], end)
        return text[: data[0][0]], data, text[end:]
    lines, at = [], 0
    for line in text.split("\n"):
        if line.strip():
            lines.append((at, at + len(line)))
        at += len(line) + 1
    head = 2 if len(lines) > 1 and _SEPARATOR.fullmatch(text[slice(*lines[1])]) else 1
    return "\n".join(text[a:z] for a, z in lines[:head]) + "\n", lines[head:], ""


def cut_table(text: str, max_rows: int) -> list[tuple[int, int, str]]:
    """As few pieces as the limit allows, of sizes that differ by one row at most."""
    header, rows, close = table_rows(text)
    joint = "" if close or text.lstrip().startswith("<") else "\n"
    n = -(-len(rows) // max_rows)
    groups = [rows[k * len(rows) // n : (k + 1) * len(rows) // n] for k in range(n)]
    return [(g[0][0], g[-1][1], header + joint.join(text[a:z] for a, z in g) + close) for g in groups]


def data_rows(text: Column) -> Column:
    """Number of data rows of a Markdown or HTML table: neither header, separator line nor blank lines."""
    lines = F.filter(F.split(text, "\r\n|\n|\r"), lambda x: x.rlike(r"\S"))
    separator = F.try_element_at(lines, F.lit(2)).rlike(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")
    markdown = F.size(lines) - 1 - F.when(separator, 1).otherwise(0)
    parts = F.split(text, r"(?i)<tr\b")
    html = F.size(F.filter(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda x: x.rlike(r"(?i)<td\b")))
    return F.when(text.rlike(r"^\s*<"), html).otherwise(markdown)


def oversized(items: DataFrame) -> DataFrame:
    """Adds limit_kind and keeps the oversized. Columns id, is_table, text, start, max_rows, max_chars, overlap."""
    kind = F.when(F.col("is_table"), F.when(data_rows(F.col("text")) > F.col("max_rows"), "rows")).when(F.length("text") > F.col("max_chars"), "chars")
    return items.withColumn("limit_kind", kind).filter("limit_kind is not null")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    types = [pa.string(), pa.string(), *[pa.int32()] * 6, pa.string()]
    for batch in batches:
        out: list[tuple] = []
        for r in batch.to_pylist():
            text, cuts = r["text"], []
            max_chars, max_rows = r["max_chars"] or len(text), r["max_rows"] or 1 << 30
            if r["is_table"]:
                cuts = cut_table(text, max(1, max_rows))
            if not cuts:
                cuts = [(a, z, text[a:z]) for a, z in cut_text(text, max_chars, r["overlap"] or 0)]
            base = r["start"] if r["start"] is not None and r["start"] >= 0 else None
            for k, (a, z, piece) in enumerate(cuts):
                out.append((r["id"], r["limit_kind"], k, len(cuts), a, z, -1 if base is None else base + a, -1 if base is None else base + z, piece))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def split_oversized(items: DataFrame, limits: DataFrame, *, id: str, text: str, key: str, is_table: Column, start: str, max_rows: str, max_chars: str, overlap: str) -> DataFrame:
    """The pieces of every item that exceeds the limits its ``key`` names. Only oversized items leave the JVM or are shuffled."""
    of = limits.select(F.col(key).alias("_key"), F.col(max_rows).alias("max_rows"), F.col(max_chars).alias("max_chars"), F.col(overlap).alias("overlap")).dropDuplicates(["_key"])
    rows = items.select(F.col(id).cast("string").alias("id"), F.coalesce(is_table, F.lit(False)).alias("is_table"), F.col(text).alias("text"), F.col(start).alias("start"), F.col(key).alias("_key")).filter("id is not null and text is not null")
    return oversized(rows.join(of, "_key").drop("_key")).dropDuplicates(["id"]).mapInArrow(_pieces, SCHEMA)
