"""Embedders. An embedder turns a text column into a vector column; model calls go in Arrow batches through a provider."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import vectors
from quire.functions.text import limited_py, sanitize, token_estimate
from quire.registry import embedder
from quire.session import cut


@embedder("local_hash")
class LocalHash:
    """Deterministic, offline, in the JVM."""

    def __init__(self, model: str = "local-hash-embedding-v1", dimension: int = 256, **_: object):
        self.model, self.dimension = model, dimension

    def apply(self, df: DataFrame, text: str, out: str) -> DataFrame:
        return df.withColumn(out, vectors.rounded(vectors.hash_embedding(sanitize(F.col(text)), self.dimension)))


class Transient(Exception):
    """A failure that may pass: too many requests, a server error, a lost connection."""


class OutOfMemory(Exception):
    """The model cannot take a batch of this size."""


def retried(call: Callable, retries: int, sleep: Callable[[float], None] = time.sleep, longest: float = 40.0):
    """The result of call; after a transient failure it is called again, at most ``retries`` times in all, with pauses of 2, 4, 8 ... seconds."""
    for attempt in range(max(1, retries)):
        try:
            return call()
        except Transient:
            if attempt + 1 >= retries:
                raise
            sleep(min(2.0 ** (attempt + 1), longest))


# Estimated tokens of the longest text of a batch, and how many texts such a batch may hold.
BATCH_TIERS = ((512, 64), (2_048, 16), (8_192, 4))


def tiered(tokens: list[int], size: int) -> list[list[int]]:
    """Places by rising length, in batches whose size falls with their longest text."""
    out: list[list[int]] = []
    for i in sorted(range(len(tokens)), key=lambda i: tokens[i]):
        most = min(size, next((n for longest, n in BATCH_TIERS if tokens[i] <= longest), 1))
        if not out or len(out[-1]) >= most:
            out.append([])
        out[-1].append(i)
    return out


def halved(ask: Callable[[list[str]], list], texts: list[str]) -> list:
    """Vectors of texts; a batch the model has no memory for is halved, down to single texts."""
    try:
        return ask(texts)
    except OutOfMemory:
        if len(texts) == 1:
            raise
        half = len(texts) // 2
        return [*halved(ask, texts[:half]), *halved(ask, texts[half:])]


@embedder("provider")
class Provider:
    """Vectors of a function from texts to vectors, called once a batch. Only texts without a vector in the cache are asked, each once.

    Batches hold at most batch_size texts and, unless one text alone exceeds it, request_tokens estimated tokens; with tiers (for a
    model in the task's own memory) they are put together by length. Transient failures are tried again with growing pauses, and a
    batch that does not fit the memory is halved. cache: a table text_hash, vector; cache_path: a folder of such a table, to which new
    vectors are added. vocabulary: see functions.text.limited_py.
    """

    def __init__(
        self, ask: Callable[[list[str]], list[list[float]]], model: str, dimension: int, batch_size: int = 64, request_tokens: int = 250_000, cache: DataFrame | None = None, cache_path: str | None = None,
        retries: int = 6, tiers: bool = False, vocabulary: str | None = None, sleep: Callable[[float], None] = time.sleep,
    ):
        self.ask, self.model, self.dimension, self.batch_size, self.request_tokens, self.cache = ask, model, dimension, batch_size, request_tokens, cache
        self.cache_path, self.retries, self.tiers, self.vocabulary, self.sleep = cache_path, retries, tiers, vocabulary, sleep

    def _known(self, spark: SparkSession) -> DataFrame | None:
        if self.cache is not None or not self.cache_path:
            return self.cache
        try:
            return spark.read.schema("text_hash string, vector array<double>").parquet(self.cache_path)
        except AnalysisException:  # nothing has been written yet
            return None

    def apply(self, df: DataFrame, text: str, out: str) -> DataFrame:
        clipped = sanitize(F.col(text)) if not self.vocabulary else limited_py(self.vocabulary)(sanitize(F.col(text)))
        keyed = df.withColumn("_text", clipped).withColumn("_key", F.sha1(F.concat(F.lit(self.model + ":"), "_text")))
        wanted = keyed.select("_key", "_text", token_estimate(F.col("_text")).alias("_tokens")).dropDuplicates(["_key"])
        cache, known = self._known(df.sparkSession), None
        if cache is not None:
            known = cache.select(F.col("text_hash").alias("_key"), F.col("vector").cast("array<double>").alias(out)).dropDuplicates(["_key"])
            wanted = wanted.join(known.select("_key"), "_key", "left_anti")
        made = wanted.mapInArrow(self._asker(), f"_key string, {out} array<double>")
        if self.cache_path:
            made = cut(made)  # asked once, for the cache and for the result
            made.select(F.col("_key").alias("text_hash"), F.col(out).alias("vector")).write.mode("append").parquet(self.cache_path)
        have = made if known is None else made.unionByName(known)
        return keyed.join(have, "_key", "left").drop("_key", "_text")

    def _asker(self):
        ask, size, most, retries, tiers, sleep = self.ask, self.batch_size, self.request_tokens, self.retries, self.tiers, self.sleep

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys, texts, tokens = (c.to_pylist() for c in b.columns)
                for group in tiered(tokens, size) if tiers else token_batches(tokens, size, most):
                    got = halved(lambda some: retried(lambda: ask(some), retries, sleep), [texts[i] for i in group])
                    if len(got) != len(group):
                        raise RuntimeError(f"the embedder returned {len(got)} vectors for {len(group)} texts")
                    yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in group]), pa.array([[float(x) for x in v] for v in got], pa.list_(pa.float64()))], names=["_key", "v"])

        return run


def token_batches(tokens: list[int], size: int, most: int) -> list[list[int]]:
    """Places in order, grouped under both limits."""
    out: list[list[int]] = []
    room = 0
    for i, n in enumerate(tokens):
        if not out or len(out[-1]) >= size or n > room:
            out.append([])
            room = most
        out[-1].append(i)
        room -= n
    return out


def batch_tokens(text: Column) -> Column:
    return F.sum(token_estimate(text))
