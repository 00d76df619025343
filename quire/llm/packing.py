"""Filling fixed-capacity containers with whole items: vector bin packing by the dot-product heuristic.

An item is a vector (tokens with its separator, one segment, loss-bearing tokens); a container limits all three at once. The open
container takes the fitting item whose vector has the greatest dot product with the room left, dimensions weighted by how scarce they
are; when none fits it is closed. Only items above the token capacity or the loss limit, which no container can take whole, are split,
into full pieces and a rest (loss is spread evenly over an item's tokens).

Where it runs: sizes are counted in Arrow batches, then only ids and sizes move. Items are spread by hash over shards of about
``shard_items``, whatever their source, and each shard is packed by itself; the items of poorly filled containers of all shards are
spread and packed once more. A shard is bounded, so no task grows with the input.

Defined results: items with null ids are ignored, repeated ids are kept as separate items only if their texts are separate rows (ids
are expected to be unique); null and empty texts are items of no tokens and are left out; ties go to the larger item, then the
smaller id; an empty table gives no containers; extra columns are ignored.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut

TOKENIZERS = os.environ.get("QUIRE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the vocabulary's own
SHARD_ITEMS = 40_000
POOR_FILL = 0.97
_LOADED: dict[str, object] = {}


def tokenizer(path: str):
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


_SLICE = 100_000
_SAFE = re.compile(r"(?<=\S) (?=[^\W\d_])")  # no token of the pattern goes over such a place


def count_tokens(encode: Callable[[str], list[int]], text: str) -> int:
    """Tokens of a text, whole. Long texts are encoded in slices that end where a token ends in any case, so the count is the same."""
    n, a = 0, 0
    while len(text) - a > 2 * _SLICE:
        m = _SAFE.search(text, a + _SLICE)
        if not m:
            break
        n += len(encode(text[a : m.start()]))
        a = m.start()
    return n + len(encode(text[a:]))


def prompt_length(text: str) -> int:
    """Characters of the prompt of an instruction example: its first paragraph, if others follow."""
    m = _PARAGRAPH.search(text)
    return m.end() if m and text[m.end() :].strip() else 0


_PARAGRAPH = re.compile(r"(?<=\S)\s*\n\s*\n\s*")


def token_counts(docs: DataFrame, id: str, text: str, path: str) -> DataFrame:
    """id, number of tokens of each text, and how many of them bear loss: those after its prompt (see prompt_length), or without a
    prompt all but the first, which nothing comes before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_ordinary
        for b in batches:
            n, loss = [], []
            for t in b.column(1).to_pylist():
                n.append(count_tokens(encode, t))
                head = prompt_length(t)
                loss.append(max(0, n[-1] - (count_tokens(encode, t[:head]) if head else 1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(loss, pa.int64())], names=["id", "tokens", "loss"])

    some = docs.select(F.col(id).cast("string").alias("id"), F.col(text).alias("text")).filter("id is not null and length(text) > 0")
    return some.mapInArrow(run, "id string, tokens long, loss long")


def pack_vectors(vectors: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Container number of each item. vectors: items x dimensions, none above the limits."""
    n = len(vectors)
    if not n:
        return np.zeros(0, np.int64)
    kinds, of = np.unique(vectors, axis=0, return_inverse=True)
    order = np.argsort(of.ravel(), kind="stable")
    counts = np.bincount(of.ravel(), minlength=len(kinds))
    first = np.cumsum(counts) - counts
    used = np.zeros(len(kinds), np.int64)
    scaled = kinds / limits
    weight = scaled.T @ counts / n  # mean demand of each dimension
    weight = weight / weight.sum()
    size = scaled @ weight
    alive = np.arange(len(kinds))
    out = np.full(n, -1, np.int64)
    bin_no = 0
    while len(alive):
        room = limits.astype(np.float64).copy()
        fits = alive
        placed = False
        while True:
            fits = fits[(kinds[fits] <= room).all(axis=1) & (used[fits] < counts[fits])]
            if not len(fits):
                break
            score = scaled[fits] @ (weight * room / limits)
            best = score.max()
            tied = fits[score >= best - 1e-12]
            k = tied[np.argmax(size[tied])]
            out[order[first[k] + used[k]]] = bin_no
            used[k] += 1
            room -= kinds[k]
            placed = True
        bin_no += 1
        alive = alive[used[alive] < counts[alive]]
        if not placed:
            raise ValueError("an item exceeds the limits")
    return out


def _pack_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    first = pdf.iloc[0]
    limits = np.array([first["capacity"] + first["separator"], first["max_segments"], first["max_loss"]], dtype=np.int64)
    pdf = pdf.sort_values(["id", "piece"], kind="stable").reset_index(drop=True)
    vectors = np.stack([pdf["size"] + pdf["separator"], np.ones(len(pdf), np.int64), pdf["loss"]], axis=1).astype(np.int64)
    binding = limits < first["capacity"]  # a limit as high as the tokens' is none: an item has no more segments or loss than tokens
    binding[0] = True
    pdf["bin"] = pack_vectors(vectors[:, binding], limits[binding])
    filled = pdf.groupby("bin")["size"].transform("sum") + pdf.groupby("bin")["size"].transform("count") * pdf["separator"] - pdf["separator"]
    pdf["filled"] = filled
    return pdf[["pack_id", "capacity", "separator", "max_segments", "max_loss", "id", "piece", "token_start", "size", "loss", "shard", "bin", "filled"]]


_ITEM = "pack_id string, capacity long, separator long, max_segments long, max_loss long, id string, piece int, token_start long, size long, loss long, shard string, bin long, filled long"


def pack(sizes: DataFrame, limits: list[dict], *, loss_share: float = 1.0, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Containers for every limit: pack_id, container, id, piece, token_start, tokens, loss, filled.

    sizes: id, tokens and optionally loss. limits: pack_id, capacity, separator and optionally max_segments, max_loss (not given:
    no limit); a list that the caller holds, one entry a packing. A limit under one is an error. A separator stands between neighbours, so n items need their sizes and n - 1 separators.
    """
    for x in limits:
        if min(x[k] for k in ("capacity", "max_segments", "max_loss") if x.get(k) is not None) < 1:
            raise ValueError(f"a limit of packing {x['pack_id']!r} leaves no room")
    rows = [F.struct(F.lit(x["pack_id"]).alias("pack_id"), *[F.lit(int(d if x.get(k) is None else x[k])).cast("long").alias(k) for k, d in (("capacity", 0), ("separator", 0), ("max_segments", x["capacity"]), ("max_loss", x["capacity"]))]) for x in limits]
    loss = F.col("loss") if "loss" in sizes.columns else F.ceil(F.col("tokens") * loss_share)
    each = sizes.filter("tokens > 0").select("id", F.col("tokens").cast("long").alias("tokens"), loss.cast("long").alias("all_loss"), F.explode(F.array(*rows)).alias("l")).select("id", "tokens", "all_loss", "l.*")
    step = F.expr("case when all_loss > 0 then least(capacity, max_loss * tokens div least(all_loss, tokens)) else capacity end")  # tokens a piece
    pieces = each.withColumn("step", step).withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("tokens") - 1) / F.col("step")).cast("int"))))
    start = F.col("piece") * F.col("step")
    size = F.least(F.col("step"), F.col("tokens") - start)
    items = cut(pieces.select("pack_id", "capacity", "separator", "max_segments", "max_loss", "id", "piece", start.cast("long").alias("token_start"), size.alias("size"), F.least(size, F.expr("(least(all_loss, tokens) * least(step, tokens - piece * step) + tokens - 1) div tokens")).cast("long").alias("loss")))
    full = items.filter("size = capacity and loss <= max_loss").withColumns({"shard": F.concat_ws("/", F.lit("full"), "id", "piece"), "bin": F.lit(0).cast("long"), "filled": F.col("size")})
    packed = cut(_pack_sharded(items.filter("not (size = capacity and loss <= max_loss)"), "a", shard_items))
    poor = F.col("filled") < POOR_FILL * F.col("capacity")
    again = _pack_sharded(packed.filter(poor).drop("shard", "bin", "filled"), "b", shard_items)
    done = full.select(*packed.columns).unionByName(packed.filter(~poor)).unionByName(again)
    return done.select("pack_id", "capacity", F.concat_ws("/", "shard", "bin").alias("container"), "id", "piece", "token_start", F.col("size").alias("tokens"), "loss", "filled")


def _pack_sharded(items: DataFrame, stage: str, shard_items: int) -> DataFrame:
    per_pack = {r["pack_id"]: r["count"] for r in items.groupBy("pack_id").count().collect()}  # one row a packing
    shards = F.create_map(*[F.lit(x) for p, n in per_pack.items() for x in (p, -(-n // shard_items))]) if per_pack else F.create_map(F.lit(""), F.lit(1))
    shard = F.concat_ws("/", F.lit(stage), F.pmod(F.xxhash64("id", "piece"), F.coalesce(F.try_element_at(shards, F.col("pack_id")), F.lit(1))))
    return items.withColumn("shard", shard).groupBy("pack_id", "shard").applyInPandas(_pack_group, _ITEM)
