import numpy as np
import pytest
from pyspark.sql import functions as F
from quire.llm import similar

SCHEMA = "rid string, v array<float>, m string, d int, st string, id string"


def brute(rows, k, least):
    out = {}
    for m in {r[2] for r in rows}:
        ids = sorted({r[0] for r in rows if r[2] == m})
        by = {r[0]: np.array(r[1]) for r in rows if r[2] == m}
        v = np.stack([by[i] / np.linalg.norm(by[i]) for i in ids])
        s = np.round(v @ v.T, 5)
        for a, i in enumerate(ids):
            order = sorted((-s[a, b], ids[b]) for b in range(len(ids)) if b != a)[:k]
            out[i] = [(j, -x) for x, j in order if -x >= least]
    return out


def clustered(n=1500, d=16, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n // 3):
        base = rng.normal(size=d)
        for k in range(3):
            x = (base / np.linalg.norm(base) + rng.normal(size=d) * 0.05) * rng.uniform(0.1, 20)
            rows.append((f"{len(rows):08x}" if c % 2 else f"id-{len(rows)}", [float(np.float32(y)) for y in x], "m1" if c % 5 else "m2", d, "ok", "clash"))
    return rows


def units(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return similar.unit_vectors(df, id="rid", vector="v", model="m", dimension="d", usable=F.col("st") == "ok")


def test_pairs_against_brute_force(spark):
    rows = clustered()
    want = {tuple(sorted((a, b))) for a, bs in brute(rows, 5, 0.9).items() for b, _ in bs}
    got = {(r[0], r[1]) for r in similar.similar_pairs(units(spark, rows + rows[:50]), k=5, least=0.9, shard_rows=100, fit_rows=600).collect()}
    assert len(got & want) / len(want) > 0.95 and len(got - want) <= 0.01 * len(got)


def test_neighbours_recall_with_stated_queries(spark):
    rng = np.random.default_rng(5)
    rows = [(f"{i:06d}", [float(x) for x in rng.normal(size=8)], "m", 8, "ok", "") for i in range(2000)]
    want = brute(rows, 10, -2)
    asks = F.decode(F.substring("id", 2, 10), "utf-8").cast("int") % 20 == 0
    got = {}
    ids = F.col("id")
    for r in similar.neighbours(units(spark, rows), k=10, probes=28, queries=(similar.expand(ids).cast("int") % 20 == 0)).filter("cast(a as int) % 20 = 0").collect():
        got.setdefault(r["a"], set()).add(r["b"])
    assert asks is not None and set(got) == {r[0] for r in rows if int(r[0]) % 20 == 0}
    recall = np.mean([len(got[a] & {b for b, _ in want[a]}) / 10 for a in got])
    assert recall >= 0.9


def test_copies_and_unusable(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(f"c{i:03d}", [x * (i + 1) for x in v], "m", 4, "ok", "") for i in range(40)]
    rows += [("near", [1.0, 2.0, 3.0, 4.1], "m", 4, "ok", ""), ("other", v, "n", 4, "ok", ""), ("zero", [0.0] * 4, "m", 4, "ok", ""), ("nan", [float("nan"), 1.0, 1.0, 1.0], "m", 4, "ok", ""), ("inf", [float("inf"), 1.0, 1.0, 1.0], "m", 4, "ok", ""),
             ("short", [1.0, 2.0], "m", 4, "ok", ""), ("nulls", [None, 2.0, 3.0, 4.0], "m", 4, "ok", ""), ("none", None, "m", 4, "ok", ""), ("nodim", v, "m", None, "ok", ""), ("failed", v, "m", 4, "failed", ""), (None, v, "m", 4, "ok", ""), ("c000", v, "m", 4, "ok", "")]
    got = {(r["a"], r["b"]) for r in similar.neighbours(units(spark, rows), k=3, least=0.9).collect()}
    firsts = ["c000", "c001", "c002", "c003"]
    want = {(f"c{i:03d}", b) for i in range(40) for b in [f for f in firsts if f != f"c{i:03d}"][:3]} | {("near", b) for b in firsts[:3]}
    assert got == want


@pytest.mark.parametrize("rows", [[], [("a", [1.0, 1.0], "m", 2, "ok", "")], [("a", [1.0], "m", 1, "ok", ""), ("b", [2.0], "m", 1, "ok", "")]])
def test_tiny(spark, rows):
    assert similar.similar_pairs(units(spark, rows), k=2, least=0.9).count() == (1 if len(rows) == 2 else 0)


def test_visits_cells_in_order_of_summed_distance():
    rng = np.random.default_rng(3)
    ix = similar.MultiIndex(rng.normal(size=(500, 6)).astype(np.float32), 5000, 32, 10**6)
    q = rng.normal(size=(20, 6)).astype(np.float32)
    d1, d2 = ix.distances(q)
    a, b = ix.visit(d1, d2, 30)
    for r in range(20):
        every = np.sort((d1[r][:, None] + d2[r][None, :]).ravel())[:30]
        assert np.allclose(d1[r, a[r]] + d2[r, b[r]], every, atol=1e-5) and len(set(zip(a[r], b[r]))) == 30


@pytest.mark.parametrize("shard_rows", [300, 10**6])
def test_every_vector_gets_its_k_neighbours(spark, shard_rows):
    rng = np.random.default_rng(9)
    rows = [(f"{i:06d}", [float(x) for x in rng.normal(size=12)], "m1" if i % 4 else "m2", 12, "ok", "") for i in range(3000)]
    want = brute(rows, 10, -2)
    got = {}
    for r in similar.neighbours(units(spark, rows), k=10, shard_rows=shard_rows).collect():
        got.setdefault(r["a"], {})[r["b"]] = r["similarity"]
    assert {a: len(bs) for a, bs in got.items()} == dict.fromkeys(want, 10)
    assert np.mean([len(got[a].keys() & {b for b, _ in bs}) / 10 for a, bs in want.items()]) >= 0.9
    assert all(abs(got[a][b] - s) < 2e-4 for a, bs in want.items() for b, s in bs if b in got[a])


def test_registered_query_gives_every_record_its_neighbours(spark, tmp_path):
    from quire.llm import queries

    rng = np.random.default_rng(2)
    rows = [(f"{i:04x}", [float(x) for x in rng.normal(size=6)], "m", 6, "embedded" if i else "failed", "") for i in range(60)]
    spark.createDataFrame(rows, "record_id string, embedding array<float>, embedding_model string, embedding_dimension int, embedding_status string, x string").write.parquet(str(tmp_path / "vector_records.parquet"))
    got = queries.QUERIES["p3_neighbours"](spark, str(tmp_path)).groupBy("record_id").count().collect()
    assert {(r[0], r[1]) for r in got} == {(x[0], 10) for x in rows[1:]}
