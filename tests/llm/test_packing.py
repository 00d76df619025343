import os
import random

import numpy as np
import pytest
from quire.llm import packing

LIMITS = [{"pack_id": "a", "capacity": 100, "separator": 1, "max_segments": 6, "max_loss": 70}, {"pack_id": "b", "capacity": 40, "separator": 0}]


def test_every_item_once_and_all_limits_hold(spark):
    rnd = random.Random(1)
    rows = [(f"d{i}", rnd.choice([1, 2, 5, 30, 39, 40, 41, 77, 100, 101, 260]), "x") for i in range(800)] + [("none", 0, "x")]
    df = spark.createDataFrame(rows, "id string, tokens long, shard string").selectExpr("id", "tokens", "tokens div 2 as loss", "shard as note")
    out = packing.pack(df, LIMITS, shard_items=150).toPandas()
    for x in LIMITS:
        p = out[out.pack_id == x["pack_id"]]
        assert p.groupby("id").tokens.sum().to_dict() == {i: n for i, n, _ in rows if n}
        assert not p.duplicated(["id", "piece"]).any()
        whole = {i for i, n, _ in rows if 0 < n <= x["capacity"]}
        assert set(p[p.id.isin(whole)].piece) == {0}
        g = p.groupby("container").tokens.agg(["sum", "count"])
        assert ((g["sum"] + (g["count"] - 1) * x["separator"]) <= x["capacity"]).all()
        if "max_segments" in x:
            assert (g["count"] <= x["max_segments"]).all()
    b = out[out.pack_id == "b"]
    assert b.container.nunique() <= 1.08 * np.ceil(b.tokens.sum() / 40)


def test_loss_limit_splits_items(spark):
    df = spark.createDataFrame([("a", 90, 90), ("b", 50, 20), ("c", 250, 100), ("d", 100, 45), ("e", 7, 0), ("f", 99, 98)], "id string, tokens long, loss long")
    out = packing.pack(df, [{"pack_id": "x", "capacity": 100, "separator": 1, "max_loss": 30}]).toPandas()
    of = {r["id"]: (r["tokens"], r["loss"]) for r in df.collect()}
    assert out.groupby("id").tokens.sum().to_dict() == {i: n for i, (n, _) in of.items()}
    out["loss"] = [t * of[i][1] / of[i][0] for i, t in zip(out.id, out.tokens)]
    assert out.groupby("container").loss.sum().max() <= 30
    assert sorted(out[out.id == "a"].tokens) == [30, 30, 30] and len(out[out.id == "b"]) == 1
    assert not out.duplicated(["id", "token_start"]).any()


def test_all_three_limits_bind(spark):
    """Short examples fill the segments, answers the loss, long prompts the tokens; a limit of nought is refused, not replaced."""
    rnd = random.Random(4)
    rows = [(f"s{i}", 5, 2) for i in range(300)] + [(f"a{i}", rnd.randint(20, 40), 0) for i in range(100)] + [(f"l{i}", 45, 44) for i in range(100)]
    rows = [(i, n, n - 1 if i[0] == "a" else k) for i, n, k in rows] + [(f"p{i}", 60, 3) for i in range(60)]
    limit = {"pack_id": "x", "capacity": 100, "separator": 1, "max_segments": 4, "max_loss": 60}
    out = packing.pack(spark.createDataFrame(rows, "id string, tokens long, loss long"), [limit]).toPandas()
    g = out.groupby("container").agg(t=("tokens", "sum"), n=("id", "count"), l=("loss", "sum"))
    assert (g.t + g.n - 1 <= 100).all() and (g.n <= 4).all() and (g.l <= 60).all()
    assert (g.n == 4).sum() > 20 and (g.l >= 57).sum() > 10 and (g.t + g.n - 1 >= 97).sum() > 5
    assert out.groupby("id").loss.sum().to_dict() == {i: k for i, _, k in rows}
    for bad in ({"max_loss": 0}, {"max_segments": 0}):
        with pytest.raises(ValueError):
            packing.pack(spark.createDataFrame(rows, "id string, tokens long, loss long"), [{**limit, **bad}])


def test_prompts():
    assert packing.prompt_length("Ask this.\n \n Answer.") == len("Ask this.\n \n ") and packing.prompt_length("No prompt\nhere") == 0
    assert packing.prompt_length("Only a head.\n\n  ") == 0 and packing.prompt_length("\n\nx") == 0


def test_dot_product_balances_dimensions():
    vectors = np.array([[60, 1, 10]] * 10 + [[40, 1, 60]] * 10)
    bins = packing.pack_vectors(vectors, np.array([100, 8, 70]))
    assert bins.max() + 1 == 10
    with pytest.raises(ValueError):
        packing.pack_vectors(np.array([[101, 1, 1]]), np.array([100, 1, 1]))
    assert len(packing.pack_vectors(np.zeros((0, 3), int), np.array([1, 1, 1]))) == 0


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "id string, tokens long"), LIMITS).count() == 0


@pytest.mark.skipif(not os.path.exists(f"{packing.TOKENIZERS}/{packing.VOCABULARY}"), reason="no tokenizer files")
def test_token_counts(spark):
    path = f"{packing.TOKENIZERS}/{packing.VOCABULARY}"
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "a" * 250_000), (None, "x")], "k long, text string")
    n = {r["id"]: r["tokens"] for r in packing.token_counts(df, "k", "text", path).collect()}
    assert n["1"] == 2 and set(n) == {"1", "4"}


@pytest.mark.skipif(not os.path.exists(f"{packing.TOKENIZERS}/{packing.VOCABULARY}"), reason="no tokenizer files")
def test_long_texts_count_as_a_whole():
    encode = packing.tokenizer(f"{packing.TOKENIZERS}/{packing.VOCABULARY}").encode_ordinary
    rnd = random.Random(2)
    text = "".join(rnd.choice(["word ", "don't ", "  ", "\n\n", "naïve, ", "12345 ", "...", "x"]) for _ in range(150_000))
    assert len(text) > 3 * packing._SLICE and packing.count_tokens(encode, text) == len(encode(text))
