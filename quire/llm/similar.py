"""Most similar vectors for every vector, by an inverted multi-index.

Vectors are scaled to length one and cut into halves; each half is quantised by its own centroids, so a vector lies in the cell of a
centroid pair. A query visits cells in the order of the summed distances of its halves to the two centroids: a priority queue holds,
for every first-half centroid, its next second-half centroid, and the least sum is taken until ``probes`` cells are visited. The
entries of these cells are reranked by exact cosine (on 16-bit components, good to about 1e-5).

This serves near copies (``similar_pairs``): they lie in the first few cells. The k nearest of every vector mostly are no near copies, so
``neighbours`` without ``probes`` takes another index (``CellNeighbours``): centroids of whole vectors, about two times the root of the
rows, and as many of them visited as hold ``recall`` of the true k nearest of ``TRIAL_ROWS`` sampled vectors, which are compared with all
rows; so the number follows the data and their size. Ties at the k-th place between different vectors are cut in any order there.

The centroids are fitted on a bounded sample (``fit_rows`` vectors a model); every vector is indexed and, unless restricted, a query.
Where it runs: vectors are placed by groups of neighbouring first-half centroids (a shard), split further by hash where the sample says
that a shard would exceed ``shard_rows``; a query goes to the shards of its cells only, once each. Exact copies are one class: the class is searched, and
its members are put back at the end, each with its first k others at most, so copies make no quadratic output.

Defined results: a vector counts if its status is the wanted one, it has as many elements as its dimension, all finite and not all
zero; ids and models must not be null; rows with the same id and model count once; equal similarities are ordered by id; an empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.session import cut

FIT_ROWS = 16_000
SHARD_ROWS = 100_000
LEAST_SHARDS = 8  # of a model, so that small inputs are spread too
CELL_ROWS = 32
PROBES = 16
RECALL = 0.95
TRIAL_ROWS = 400
CELL_SHARD_ROWS = 100_000
SCALE = 32767.0


def compact(id: Column) -> Column:
    """Ids as binary, hexadecimal ones in half the space; expand() gives them back."""
    hexed = id.rlike("^([0-9a-f]{2})+$")
    return F.when(hexed, F.concat(F.lit(b"\x01"), F.unhex(id))).otherwise(F.concat(F.lit(b"\x00"), F.encode(id, "utf-8")))


def expand(id: Column) -> Column:
    rest = F.substring(id, 2, 1 << 30)
    return F.when(F.substring(id, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(F.decode(rest, "utf-8"))


def _fixed(width: int, rows: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _unit_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, model, dim, values -> id, model, dim, vec: the valid vectors, of length one, as 16-bit integers."""
    for b in batches:
        values = b.column(3)
        values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        ends = values.offsets.to_numpy()
        flat = values.values.to_numpy(zero_copy_only=False).astype(np.float64)
        length = np.diff(ends)
        right = np.flatnonzero((length == b.column(2).to_numpy(zero_copy_only=False)) & (length > 0))
        for d in np.unique(length[right]):
            rows = right[length[right] == d]
            v = flat[ends[rows][:, None] + np.arange(d)]
            top = np.abs(v).max(axis=1)
            ok = np.isfinite(v).all(axis=1) & (top > 0)
            rows, v = rows[ok], v[ok] / top[ok][:, None]
            if len(rows):
                v /= np.linalg.norm(v, axis=1)[:, None]
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(np.full(len(rows), d, np.int32)), _fixed(2 * int(d), np.rint(v * SCALE).astype(np.int16))], names=["id", "model", "dim", "vec"])


def unit_vectors(df: DataFrame, *, id: str, vector: str, model: str | None = None, dimension: str | None = None, usable: Column | None = None) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    some = df.filter(usable) if usable is not None else df
    some = some.select(
        compact(F.col(id).cast("string")).alias("id"), (F.col(model).cast("string") if model else F.lit("")).alias("model"),
        (F.col(dimension) if dimension else F.size(v)).cast("int").alias("dim"), F.col(vector).cast("array<float>").alias("v"),
    ).filter("id is not null and model is not null and dim is not null and v is not null")
    return some.mapInArrow(_unit_vectors, "id binary, model string, dim int, vec binary")


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        a = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, a, x)
        n = np.bincount(a, minlength=k)
        c = np.where(n[:, None] > 0, total / np.maximum(1, n)[:, None], x[rng.choice(len(x), k)])
    return c.astype(np.float32)


class MultiIndex:
    """Centroids of both halves for one model, and how many shards each first-half centroid needs."""

    def __init__(self, sample: np.ndarray, rows: int, cell_rows: int, shard_rows: int):
        rng = np.random.default_rng(7)
        self.half = sample.shape[1] // 2
        self.k = int(min(4096, max(2, 2 ** round(np.log2(max(1.0, rows / cell_rows) ** 0.5)))))
        self.first = kmeans(sample[:, : self.half], self.k, rng) if self.half else np.zeros((self.k, 0), np.float32)
        self.second = kmeans(sample[:, self.half :], self.k, rng)
        share = np.bincount(self.distances(sample)[0].argmin(axis=1), minlength=self.k) / len(sample)
        # Neighbouring first-half centroids share a shard, so that a query is sent once for all cells it visits there.
        n_groups = int(min(self.k, max(LEAST_SHARDS, np.ceil(rows / shard_rows))))
        centres = kmeans(self.first, n_groups, rng) if self.half else np.zeros((1, 0), np.float32)
        self.group = ((centres**2).sum(axis=1) - 2 * self.first @ centres.T).argmin(axis=1)
        self.place = np.zeros(self.k, np.int64)  # of a centroid within its group
        for g in range(len(centres)):
            mine = np.flatnonzero(self.group == g)
            self.place[mine] = np.arange(len(mine))
        held = np.bincount(self.group, weights=share, minlength=len(centres))
        self.salts = np.maximum(1, np.ceil(held * rows / shard_rows)).astype(np.int64)
        self.offset = np.cumsum(self.salts) - self.salts

    def code(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Number of a cell within its shard."""
        return (self.place[first] * self.k + second).astype(np.uint32)

    def distances(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = v[:, : self.half], v[:, self.half :]
        return (self.first**2).sum(axis=1) - 2 * a @ self.first.T, (self.second**2).sum(axis=1) - 2 * b @ self.second.T

    def visit(self, d1: np.ndarray, d2: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """First- and second-half centroids of the cells each row visits, by summed distance.

        The queue of every row holds one candidate per first-half centroid (its next second-half centroid in order of distance); all
        rows take their least candidate at once.
        """
        n, probes = len(d1), min(probes, self.k * self.k)
        width = min(self.k, probes)  # cell (a, b) is visited after all cells of smaller ranks, so ranks stay below probes
        o1 = np.argsort(d1, axis=1, kind="stable")[:, :width]
        o2 = np.argsort(d2, axis=1, kind="stable")[:, :width]
        s1, s2 = np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1)
        s2 = np.concatenate([s2, np.full((n, 1), np.inf, s2.dtype)], axis=1)
        at = np.zeros((n, width), dtype=np.int64)
        queue = s1 + s2[:, :1]
        rows = np.arange(n)
        out1, out2 = np.empty((n, probes), np.int64), np.empty((n, probes), np.int64)
        for p in range(probes):
            a = queue.argmin(axis=1)
            b = at[rows, a]
            out1[:, p], out2[:, p] = o1[rows, a], o2[rows, np.minimum(b, width - 1)]
            at[rows, a] = np.minimum(b + 1, width)
            queue[rows, a] = s1[rows, a] + s2[rows, at[rows, a]]
        return out1, out2


_SHARDED = "shard long, kind byte, id binary, model string, cells binary, vec binary"


def _spread(indexes: dict[str, MultiIndex], base: dict[str, int], probes: int):
    """Every class as an entry of its shard, and as a query to each shard of its cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            models = whole.column(1).to_pylist()
            for m in sorted(set(models)):
                take = np.flatnonzero([x == m for x in models])
                for part in np.array_split(take, max(1, len(take) // 4000)):
                    b = whole.take(pa.array(part))
                    ix = indexes[m]
                    raw = b.column(3).to_pylist()
                    v = np.frombuffer(b"".join(raw), dtype=np.int16).reshape(len(raw), -1).astype(np.float32) / SCALE
                    d1, d2 = ix.distances(v)
                    i, j = d1.argmin(axis=1), d2.argmin(axis=1)
                    home = ix.group[i]
                    salt = np.frombuffer(b"".join(x[:2] for x in raw), dtype=np.uint16).astype(np.int64) * 40503 % 65536 % ix.salts[home]
                    ids = b.column(0)
                    yield _rows(base[m] + ix.offset[home] + salt, 0, ids, m, [c.tobytes() for c in ix.code(i, j)], b.column(3))
                    q = np.flatnonzero(b.column(4).to_numpy(zero_copy_only=False))
                    if not len(q):
                        continue
                    v1, v2 = ix.visit(d1[q], d2[q], probes)
                    owner = np.repeat(q, v1.shape[1])
                    shard, code = ix.group[v1.ravel()], ix.code(v1.ravel(), v2.ravel())
                    order = np.lexsort((shard, owner))
                    owner, shard, code = owner[order], shard[order], code[order]
                    start = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (shard[1:] != shard[:-1])])
                    ends = np.r_[start[1:], len(owner)]
                    cells = [code[a:z].tobytes() for a, z in zip(start, ends)]
                    of, asked = owner[start], shard[start]
                    n = ix.salts[asked]
                    rep = np.repeat(np.arange(len(of)), n)
                    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    yield _rows(base[m] + ix.offset[asked[rep]] + k, 1, ids.take(pa.array(of[rep])), m, [cells[r] for r in rep], b.column(3).take(pa.array(of[rep])))

    def _rows(shard, kind, ids, model, cells, vec) -> pa.RecordBatch:
        n = len(shard)
        return pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int64)), pa.array(np.full(n, kind, np.int8)), ids, pa.array([model] * n, pa.string()), pa.array(cells, pa.binary()), vec], names=["shard", "kind", "id", "model", "cells", "vec"])

    return run


def _search(k: int, least: float | None):
    """Entries of a shard come first, then its queries: exact cosines within the visited cells."""
    floor = -2.0 if least is None else least - 2e-5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, table = None, [], None
        for b in batches:
            shards, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
            change = np.flatnonzero(np.r_[True, (shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1])])
            for a, z in zip(change, np.r_[change[1:], len(shards)]):
                if shards[a] != shard:
                    shard, held, table = shards[a], [], None
                part = b.slice(a, z - a)
                if kinds[a] == 0:
                    held.append(part)
                elif held:
                    if table is None:
                        table = _table(held)
                    for lo in range(0, part.num_rows, 2048):
                        yield from _block(table, part.slice(lo, 2048))

    def _matrix(vec) -> np.ndarray:
        raw = vec.to_pylist()
        return np.frombuffer(b"".join(raw), dtype=np.int16).reshape(len(raw), -1).astype(np.float32) / SCALE

    def _table(held):
        ids = np.array([x for p in held for x in p.column(2).to_pylist()], dtype=object)
        cell = np.frombuffer(b"".join(x for p in held for x in p.column(4).to_pylist()), dtype=np.uint32)
        v = np.concatenate([_matrix(p.column(5)) for p in held])
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        return ids[order], v[order], cell

    def _block(table, part):
        ids, v, cell = table
        qid = np.array(part.column(2).to_pylist(), dtype=object)
        qv = _matrix(part.column(5))
        lists = part.column(4).to_pylist()
        owner = np.repeat(np.arange(len(lists)), [len(x) // 4 for x in lists])
        wanted = np.frombuffer(b"".join(lists), dtype=np.uint32)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for c in np.unique(wanted):
            lo, hi = np.searchsorted(cell, c, "left"), np.searchsorted(cell, c, "right")
            if lo == hi:
                continue
            asked = owner[wanted == c]
            for part_rows in np.array_split(asked, max(1, len(asked) * (hi - lo) // 8_000_000)):  # a block of cosines stays under 32 MB
                s = qv[part_rows] @ v[lo:hi].T
                n = np.count_nonzero(s >= floor, axis=1)
                few, many = np.flatnonzero((n > 0) & (n <= k + 1)), np.flatnonzero(n > k + 1)
                if len(few):
                    r, e = np.nonzero(s[few] >= floor)
                    found.append((part_rows[few[r]], e + lo, s[few[r], e]))
                if len(many):  # only the best can be among the k most similar; one more, for the vector itself
                    near = np.argpartition(-s[many], k, axis=1)[:, : k + 1]
                    r, e = np.repeat(many, k + 1), near.ravel()
                    found.append((part_rows[r], e + lo, s[r, e]))
        if not found:
            return
        r, e, s = (np.concatenate(x) for x in zip(*found))
        other = qid[r] != ids[e]
        r, e, s = r[other], e[other], s[other]
        order = np.lexsort((-s, r))
        r, e, s = r[order], e[order], s[order]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, int)
        rank = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)]))
        keep = rank < k
        r, e, s = r[keep], e[keep], s[keep]
        if len(r):
            yield pa.RecordBatch.from_arrays([part.column(3).take(pa.array(r)), pa.array(qid[r], pa.binary()), pa.array(ids[e], pa.binary()), pa.array(np.minimum(s, 1.0).astype(np.float64))], names=["model", "a", "b", "similarity"])

    return run


class Classes:
    """The classes of copies (checkpointed, numbered by ``at``) and a sample of them."""

    def __init__(self, vectors: DataFrame, k: int, fit_rows: int, queries: Column | None):
        self.k, self.vectors = k, vectors
        # dense_rank <= k + 1 is limited before the shuffle too, so a class of copies moves k + 1 ids a task at most
        ranked = vectors.withColumn("rank", F.dense_rank().over(W.partitionBy("model", "dim", "vec").orderBy("id"))).filter(F.col("rank") <= k + 1)
        asks = F.max(queries if queries is not None else F.lit(True)).alias("asks")
        self.classes = cut(ranked.groupBy("model", "dim", "vec").agg(F.sort_array(F.collect_set("id")).alias("ids"), asks).select("model", "dim", "vec", "ids", "asks", F.element_at("ids", 1).alias("id"), F.monotonically_increasing_id().alias("at")))
        self.name = name = F.concat_ws("/", "model", "dim")
        kinds = self.classes.groupBy("model", "dim").count().collect()  # a row a model
        fits = F.create_map(*[x for r in kinds for x in (F.lit(f"{r['model']}/{r['dim']}"), F.lit(min(1.0, fit_rows / r["count"])))]) if kinds else None
        self.rows: dict[str, int] = {f"{r['model']}/{r['dim']}": r["count"] for r in sorted(kinds, key=lambda r: (r["model"], r["dim"]))}
        self.sample: dict[str, np.ndarray] = {}
        self.sample_at: dict[str, np.ndarray] = {}
        if kinds:
            sampled = self.classes.filter(F.pmod(F.xxhash64("vec"), F.lit(1_000_000)) < fits[name] * 1_000_000).select(name.alias("m"), "at", "vec").limit(2 * fit_rows * len(kinds)).collect()
            by: dict[str, list] = {}
            for r in sampled:
                by.setdefault(r["m"], []).append(r)
            for m in self.rows:
                rows = by.get(m) or self.classes.filter(name == m).select("at", "vec").limit(1).collect()
                self.sample[m] = np.stack([np.frombuffer(bytes(x["vec"]), dtype=np.int16) for x in rows]).astype(np.float32) / SCALE
                self.sample_at[m] = np.array([x["at"] for x in rows], dtype=np.int64)

    def copies(self) -> DataFrame:
        """a, b, similarity: the first k others of every member of a class."""
        k = self.k
        many = self.classes.filter(F.size("ids") > 1)
        within = many.select(F.explode("ids").alias("a"), F.col("ids").alias("bs"))
        crowded = many.filter(F.size("ids") > k)
        if not crowded.isEmpty():  # members beyond the first k + 1 of a class: copies of the first ones
            rest = self.vectors.join(crowded.select("model", "dim", "vec", "ids"), ["model", "dim", "vec"]).filter(~F.array_contains("ids", F.col("id"))).select(F.col("id").alias("a"), F.col("ids").alias("bs")).distinct()
            within = within.unionByName(rest)
        return within.select("a", F.explode(F.slice(F.filter("bs", lambda x: x != F.col("a")), 1, k)).alias("b"), F.lit(1.0).alias("similarity"))

    def named(self, across: DataFrame) -> DataFrame:
        return across.unionByName(self.copies()).select(expand(F.col("a")).alias("a"), expand(F.col("b")).alias("b"), "similarity")


class Neighbours(Classes):
    """The neighbours found between the classes by the inverted multi-index."""

    def __init__(self, vectors: DataFrame, k: int, least: float | None, probes: int, fit_rows: int, shard_rows: int, cell_rows: int, queries: Column | None):
        super().__init__(vectors, k, fit_rows, queries)
        self.index: dict[str, MultiIndex] = {}
        base: dict[str, int] = {}
        at = 0
        for m, rows in self.rows.items():
            ix = self.index[m] = MultiIndex(self.sample[m], rows, cell_rows, shard_rows)
            base[m], at = at, at + int(ix.salts.sum())
        spread = self.classes.select("id", self.name.alias("model"), "dim", "vec", "asks").mapInArrow(_spread(self.index, base, probes), _SHARDED)
        found = spread.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_search(k, least), "model string, a binary, b binary, similarity double")
        self.found = found

    def between_classes(self) -> DataFrame:
        """model, a, b, similarity (found from either side), with the members of both classes."""
        f = self.found
        both = f.unionByName(f.select("model", F.col("b").alias("a"), F.col("a").alias("b"), "similarity")).groupBy("model", "a", "b").agg(F.max("similarity").alias("similarity"))
        many = self.classes.filter(F.size("ids") > 1).select(F.concat_ws("/", "model", "dim").alias("model"), "id", "ids")
        # classes of copies grow with the data, so they are never the broadcast side
        left = many.select("model", F.col("id").alias("a"), F.col("ids").alias("ids_a")).hint("merge")
        right = many.select("model", F.col("id").alias("b"), F.col("ids").alias("ids_b")).hint("merge")
        return both.join(left, ["model", "a"], "left").join(right, ["model", "b"], "left").select("model", "a", "b", "similarity", F.coalesce("ids_a", F.array("a")).alias("ids_a"), F.coalesce("ids_b", F.array("b")).alias("ids_b"))

    def pairs(self) -> DataFrame:
        """a, b, similarity: b is among the k most similar of a."""
        k = self.k
        before = F.coalesce(F.sum(F.size("ids_b")).over(W.partitionBy("model", "a").orderBy(F.desc("similarity"), "b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        room = self.between_classes().withColumn("room", F.lit(k) - (F.size("ids_a") - 1) - before).filter("room > 0")
        across = room.select("similarity", F.explode("ids_a").alias("a"), F.slice("ids_b", 1, F.least(F.size("ids_b"), F.col("room").cast("int"))).alias("bs")).select("a", F.explode("bs").alias("b"), "similarity")
        return self.named(across)


class CellIndex:
    """Centroids of whole vectors for one model. Near cells share a shard; a cell above shard_rows has several."""

    def __init__(self, sample: np.ndarray, rows: int, shard_rows: int):
        self.k = int(min(4096, len(sample), max(1, 2 ** round(np.log2(2 * rows**0.5)))))
        self.centres = kmeans(sample, self.k, np.random.default_rng(7))
        share = np.bincount(self.distances(sample).argmin(axis=1), minlength=self.k) / len(sample)
        self.salts = np.maximum(1, np.ceil(share * rows / shard_rows)).astype(np.int64)
        self.offset = np.zeros(self.k, np.int64)
        self.shards, room = 0, 0.0
        full = min(shard_rows, 1.05 * rows / np.ceil(rows / shard_rows))  # shards of like size
        for c in self._near_order(np.arange(self.k), share):
            need = share[c] * rows
            if self.salts[c] > 1 or need > room or not self.shards:
                self.shards, room = self.shards + int(self.salts[c]), full if self.salts[c] == 1 else 0.0
            self.offset[c] = self.shards - self.salts[c]
            room -= need
        self.probes = self.k

    def distances(self, v: np.ndarray) -> np.ndarray:
        return (self.centres**2).sum(axis=1) - 2 * v @ self.centres.T

    def _near_order(self, cells: np.ndarray, share: np.ndarray) -> list[int]:
        """Cells in the order of a tree that halves them along their widest direction."""
        if len(cells) < 3:
            return cells.tolist()
        x = self.centres[cells] - self.centres[cells].mean(axis=0)
        cells = cells[np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0], kind="stable")]
        cut_at = int(np.clip(np.searchsorted(np.cumsum(share[cells]), share[cells].sum() / 2), 1, len(cells) - 1))
        return self._near_order(cells[:cut_at], share) + self._near_order(cells[cut_at:], share)

    def nearest(self, d: np.ndarray) -> np.ndarray:
        """The cells each row visits."""
        if self.probes >= self.k:
            return np.broadcast_to(np.arange(self.k), d.shape)
        return np.argpartition(d, self.probes - 1, axis=1)[:, : self.probes]


def _matrix(vec) -> np.ndarray:
    raw = vec.to_pylist()
    return np.frombuffer(b"".join(raw), dtype=np.int16).reshape(len(raw), -1).astype(np.float32) / SCALE


def _by_model(batch: pa.RecordBatch, column: int, rows: int):
    """A batch in parts of one model and at most so many rows."""
    models = np.array(batch.column(column).to_pylist(), dtype=object)
    for m in sorted(set(models)):
        take = np.flatnonzero(models == m)
        for part in np.array_split(take, -(-len(take) // rows)):
            yield m, batch.take(pa.array(part))


def _trial(indexes: dict[str, CellIndex], asked: dict[str, tuple[np.ndarray, np.ndarray]], k: int):
    """at, model, vec -> for each asked vector its k most similar among the task's rows: similarity, and how many cells come before theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        ranks = {m: indexes[m].distances(v).argsort(axis=1).argsort(axis=1) for m, (_, v) in asked.items()}
        for batch in batches:
            for m, b in _by_model(batch, 1, 4000):
                at, q = asked[m]
                v = _matrix(b.column(2))
                s = q @ v.T
                s[at[:, None] == b.column(0).to_numpy()[None, :]] = -3
                rank = ranks[m][:, indexes[m].distances(v).argmin(axis=1)]
                if m in best:
                    s, rank = np.concatenate([best[m][0], s], axis=1), np.concatenate([best[m][1], rank], axis=1)
                if s.shape[1] > k:
                    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                    s, rank = np.take_along_axis(s, top, 1), np.take_along_axis(rank, top, 1)
                best[m] = s, rank
        for m, (s, rank) in best.items():
            r, c = np.nonzero(s > -3)
            yield pa.RecordBatch.from_arrays([pa.array([m] * len(r), pa.string()), pa.array(r.astype(np.int32)), pa.array(s[r, c].astype(np.float32)), pa.array(rank[r, c].astype(np.int32))], names=["model", "q", "similarity", "rank"])

    return run


_PLACED = "shard long, kind byte, at long, n byte, cell short, vec binary"


def _place(indexes: dict[str, CellIndex], base: dict[str, int]):
    """at, n, model, vec, asks -> every class as an entry of its shard, and as a query to each shard of the cells it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for m, b in _by_model(whole, 2, 4000):
                ix, v = indexes[m], _matrix(b.column(3))
                d = ix.distances(v)
                cell = d.argmin(axis=1)
                salt = np.arange(len(v)) % ix.salts[cell]
                yield _rows(b, np.arange(len(v)), base[m] + ix.offset[cell] + salt, 0, cell)
                q = np.flatnonzero(b.column(4).to_numpy(zero_copy_only=False))
                if not len(q):
                    continue
                near = ix.nearest(d[q])
                owner, near = np.repeat(q, near.shape[1]), near.ravel()
                n = ix.salts[near]
                shard = np.repeat(ix.offset[near], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                owner, shard = np.divmod(np.unique(np.repeat(owner, n) * ix.shards + shard), ix.shards)
                yield _rows(b, owner, base[m] + shard, 1, np.zeros(len(owner)))  # its cells are found again in the shard, so they need not be sent

    def _rows(b, rows, shard, kind, cell) -> pa.RecordBatch:
        take = pa.array(rows)
        return pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int64)), pa.array(np.full(len(rows), kind, np.int8)), b.column(0).take(take), b.column(1).take(take), pa.array(cell.astype(np.int16)), b.column(3).take(take)], names=["shard", "kind", "at", "n", "cell", "vec"])

    return run


_HIT = np.dtype([("at", "<i8"), ("similarity", "<f4"), ("n", "i1")])


def _search_cells(indexes: dict[str, CellIndex], base: dict[str, int], k: int):
    """Entries of a shard come first, then its queries: at, n and the k + 1 best hits (perhaps itself) of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, table = None, [], None
        for b in batches:
            shards, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
            change = np.flatnonzero(np.r_[True, (shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1])])
            for a, z in zip(change, np.r_[change[1:], len(shards)]):
                if shards[a] != shard:
                    shard, held, table = shards[a], [], None
                part = b.slice(a, z - a)
                if kinds[a] == 0:
                    held.append(part)
                elif held:
                    table = table or _table(held)
                    yield _block(indexes[max((m for m in base if base[m] <= shard), key=base.get)], table, part)

    def _table(held):
        cell = np.concatenate([p.column(4).to_numpy() for p in held])
        order = np.argsort(cell, kind="stable")
        at, n = (np.concatenate([p.column(c).to_numpy() for p in held])[order] for c in (2, 3))
        return at, n, np.concatenate([_matrix(p.column(5)) for p in held])[order], cell[order]

    def _block(ix, table, part):
        at, n, v, cell = table
        qv = _matrix(part.column(5))
        near = ix.nearest(ix.distances(qv))
        wanted = near.ravel()
        order = np.argsort(wanted, kind="stable")
        owner, wanted = order // near.shape[1], wanted[order]
        best, entry = np.full((len(qv), k + 1), -2, np.float32), np.full((len(qv), k + 1), -1, np.int64)
        for c in np.unique(cell):
            lo, hi = np.searchsorted(cell, c, "left"), np.searchsorted(cell, c, "right")
            asked = owner[np.searchsorted(wanted, c, "left") : np.searchsorted(wanted, c, "right")]
            for rows in np.array_split(asked, max(1, len(asked) * (hi - lo) // 8_000_000)):  # a block of cosines stays under 32 MB
                s = qv[rows] @ v[lo:hi].T
                better = np.flatnonzero(s.max(axis=1) > best[rows].min(axis=1))
                if not len(better):
                    continue
                rows = rows[better]
                s = np.concatenate([best[rows], s[better]], axis=1)
                e = np.concatenate([entry[rows], np.broadcast_to(np.arange(lo, hi), (len(rows), hi - lo))], axis=1)
                top = np.argpartition(-s, k, axis=1)[:, : k + 1]
                best[rows], entry[rows] = np.take_along_axis(s, top, 1), np.take_along_axis(e, top, 1)
        hit = entry >= 0
        out = np.empty(int(hit.sum()), _HIT)
        out["at"], out["similarity"], out["n"] = at[entry[hit]], best[hit], n[entry[hit]]
        ends = np.r_[0, np.cumsum(hit.sum(axis=1))] * _HIT.itemsize
        hits = pa.Array.from_buffers(pa.binary(), len(qv), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)])
        return pa.RecordBatch.from_arrays([part.column(2), part.column(3), hits], names=["at", "n", "hits"])

    return run


def _merge(k: int, least: float | None):
    """at, n, hits of all shards -> a, b, similarity and how many members of b fit among the k most similar of a."""
    floor = -2.0 if least is None else least - 2e-5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2).to_pylist()
            owner = np.repeat(np.arange(len(lists)), [sum(map(len, x)) // _HIT.itemsize for x in lists])
            h = np.frombuffer(b"".join(y for x in lists for y in x), dtype=_HIT)
            a, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            keep = (h["at"] != a[owner]) & (h["similarity"] >= floor)
            owner, h = owner[keep], h[keep]
            order = np.lexsort((h["at"], -h["similarity"], owner))
            owner, h = owner[order], h[order]
            before = np.cumsum(h["n"], dtype=np.int64) - h["n"]
            if len(h):
                before -= before[np.searchsorted(owner, owner, "left")]
            room = k - (n[owner].astype(np.int64) - 1) - before
            keep = room > 0
            owner, h, room = owner[keep], h[keep], room[keep]
            yield pa.RecordBatch.from_arrays([pa.array(a[owner]), pa.array(h["at"].copy()), pa.array(np.minimum(h["similarity"], 1).astype(np.float32)), pa.array(np.minimum(room, h["n"]).astype(np.int32))], names=["a_at", "b_at", "similarity", "fit"])

    return run


class CellNeighbours(Classes):
    """The neighbours found between the classes in as many cells as the recall asks for."""

    def __init__(self, vectors: DataFrame, k: int, least: float | None, recall: float, fit_rows: int, shard_rows: int, queries: Column | None):
        if k > 126:
            raise ValueError("k must be at most 126")  # class sizes up to k + 1 are bytes
        super().__init__(vectors, k, fit_rows, queries)
        self.index = {m: CellIndex(self.sample[m], rows, shard_rows) for m, rows in self.rows.items()}
        asked = {m: (self.sample_at[m][:TRIAL_ROWS], self.sample[m][:TRIAL_ROWS]) for m in self.rows}
        best = F.row_number().over(W.partitionBy("model", "q").orderBy(F.desc("similarity"), "rank"))
        tried = self.classes.select("at", self.name.alias("model"), "vec").mapInArrow(_trial(self.index, asked, k), "model string, q int, similarity float, rank int").withColumn("best", best).filter(F.col("best") <= k)
        ranks: dict[str, list[int]] = {}
        for r in tried.select("model", "rank").collect() if self.rows else []:  # k rows for each asked vector
            ranks.setdefault(r["model"], []).append(r["rank"])
        base: dict[str, int] = {}
        at = 0
        for m, ix in self.index.items():
            if m in ranks:
                ix.probes = int(np.quantile(ranks[m], min(1.0, recall), method="higher")) + 1
            base[m], at = at, at + ix.shards
        placed = self.classes.select("at", F.size("ids").cast("byte").alias("n"), self.name.alias("model"), "vec", "asks").mapInArrow(_place(self.index, base), _PLACED)
        hits = placed.repartitionById(max(1, at), F.col("shard").cast("int")).sortWithinPartitions("shard", "kind").mapInArrow(_search_cells(self.index, base, k), "at long, n byte, hits binary")
        self.found = hits.groupBy("at").agg(F.first("n").alias("n"), F.collect_list("hits").alias("hits")).mapInArrow(_merge(k, least), "a_at long, b_at long, similarity float, fit int")

    def pairs(self) -> DataFrame:
        """a, b, similarity: b is among the k most similar of a."""
        ids = self.classes.select("at", "ids")
        across = self.found.join(ids.withColumnRenamed("at", "b_at"), "b_at").select("a_at", F.explode(F.slice("ids", F.lit(1), F.col("fit"))).alias("b"), "similarity")
        across = across.join(ids.withColumnRenamed("at", "a_at"), "a_at").select(F.explode("ids").alias("a"), "b", F.col("similarity").cast("double").alias("similarity"))
        return self.named(across)


def neighbours(vectors: DataFrame, *, k: int = 10, least: float | None = None, probes: int | None = None, recall: float = RECALL, fit_rows: int = FIT_ROWS, shard_rows: int | None = None, cell_rows: int = CELL_ROWS, queries: Column | None = None) -> DataFrame:
    """a, b, similarity for the k most similar b of every a (only those of at least ``least``). queries: which ids ask (a column over id).

    probes: cells of the multi-index to visit; without it, whole-vector cells are visited as far as ``recall`` of a sample's true neighbours asks.
    """
    return _found(vectors, k, least, probes, recall, fit_rows, shard_rows, cell_rows, queries).withColumn("similarity", F.round("similarity", 4))


def _found(vectors: DataFrame, k: int, least: float | None, probes: int | None, recall: float = RECALL, fit_rows: int = FIT_ROWS, shard_rows: int | None = None, cell_rows: int = CELL_ROWS, queries: Column | None = None) -> DataFrame:
    if probes is None:
        return CellNeighbours(vectors, k, least, recall, fit_rows, shard_rows or CELL_SHARD_ROWS, queries).pairs()
    return Neighbours(vectors, k, least, probes, fit_rows, shard_rows or SHARD_ROWS, cell_rows, queries).pairs()


def similar_pairs(vectors: DataFrame, *, k: int = 10, least: float = 0.9, probes: int = PROBES, **how) -> DataFrame:
    """record_id_a < record_id_b, similarity: at least one is among the other's k most similar, with cosine of at least ``least``."""
    n = _found(vectors, k, least, probes, **how).filter(F.col("similarity") >= least)  # compared as computed, rounded afterwards
    pairs = n.groupBy(F.least("a", "b").alias("record_id_a"), F.greatest("a", "b").alias("record_id_b")).agg(F.max("similarity").alias("similarity"))
    return pairs.withColumn("similarity", F.round("similarity", 4))
