import random

import pytest
from pyspark.sql import functions as F
from quire.llm import splitting


def test_pieces_cover_with_overlap_and_prefer_natural_cuts():
    rnd = random.Random(3)
    for _ in range(40):
        text = "".join(rnd.choice(["word ", "Ende. ", "x" * rnd.randint(1, 90), "\n\n", "é, ", "\n"]) for _ in range(rnd.randint(1, 200)))
        limit, overlap = rnd.randint(20, 200), rnd.randint(0, 120)
        cuts = splitting.cut_text(text, limit, overlap)
        real = min(overlap, (limit - 1) // 2)
        assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
        assert all(0 < z - a <= limit for a, z in cuts) or not text
        assert all(b[0] == a[1] - real and b[1] > a[1] for a, b in zip(cuts, cuts[1:]))
    text = "A sentence of words. " * 40 + "\n\n" + "Another one here. " * 40
    assert splitting.cut_text(text, 900, 0)[0][1] == text.index("Another")
    assert splitting.cut_text("x" * 1000, 100, 10)[-1][1] == 1000
    assert splitting.cut_text("", 10, 0) == [(0, 0)]


def brute_cost(text, limit, overlap):
    """Cheapest cost over all sequences of cuts, by plain recursion."""
    at, cost = splitting.boundaries(text, limit - overlap)
    at, cost, n = [*map(int, at), len(text)], [*map(float, cost), 0.0], len(text)
    even = n / -(-(n - overlap) // (limit - overlap))
    memo = {}

    def f(j):
        if j not in memo:
            best = splitting.BALANCE * ((at[j] - even) / even) ** 2 if at[j] <= limit else float("inf")
            for i in range(j):
                length = at[j] - at[i] + overlap
                if length <= limit:
                    best = min(best, f(i) + splitting.BALANCE * ((length - even) / even) ** 2)
            memo[j] = best + cost[j]
        return memo[j]

    return f(len(at) - 1), at, cost, even


def test_dynamic_programming_is_optimal():
    rnd = random.Random(5)
    for _ in range(20):
        text = " ".join(rnd.choice(["aa", "bbb.", "c,", "ddddd"]) for _ in range(60))
        cuts = splitting.cut_text(text, 40, 6)
        want, at, cost, even = brute_cost(text, 40, 6)
        got = sum(splitting.BALANCE * ((z - a - even) / even) ** 2 + cost[at.index(z)] for a, z in cuts)
        assert got == pytest.approx(want)


def test_tables_and_odd_rows(spark):
    md = "| a | b |\n| --- | --- |\n" + "\n".join(f"| {i} | x |" + ("\n" if i == 3 else "") for i in range(7))
    html = "<table>\n<TR><th>a</th></TR>" + "".join(f"<tr class='r'><td>{i}</td></tr>" for i in range(5)) + "</table>"
    bare = "| h |\n" + "\n".join("| v |" for _ in range(3))
    rows = [("m", "table_chunk", md, 5, "k"), ("h", "table_chunk", html, -1, "k"), ("b", "table_chunk", bare, 0, "k"), ("t", "text_chunk", "wort " * 60, 7, "k"), ("t", "text_chunk", "wort " * 60, 7, "k"),
            ("n", "text_chunk", None, 1, "k"), (None, "text_chunk", "wort " * 60, 1, "k"), ("o", "text_chunk", "wort " * 60, 1, "other"), ("e", "table_chunk", "", 1, "k"), ("w", "table_chunk", "| h |\n" + "|" + "y" * 300 + "|", None, "k")]
    items = spark.createDataFrame(rows, "id string, chunk_type string, text string, start int, key string").withColumn("max_rows", F.lit("clash"))
    limits = spark.createDataFrame([("k", 3, 200, 20), ("k", 3, 200, 20)], "key string, r int, c int, o int")
    out = splitting.split_oversized(items, limits, id="id", text="text", key="key", is_table=F.col("chunk_type") == "table_chunk", start="start", max_rows="r", max_chars="c", overlap="o").collect()
    by = {}
    for r in sorted(out, key=lambda r: (r["id"], r["piece"])):
        by.setdefault(r["id"], []).append(r)
    assert {k: v[0]["limit_kind"] for k, v in by.items()} == {"m": "rows", "h": "rows", "t": "chars"}  # w: one long row is within the limit of a table
    assert [r["text"].count("| x |") for r in by["m"]] == [2, 2, 3] and all(r["text"].startswith("| a | b |\n| --- |") for r in by["m"])
    assert all(r["text"].startswith("<table>\n<TR><th>") and r["text"].endswith("</table>") for r in by["h"]) and "".join(r["text"] for r in by["h"]).count("<td>") == 5
    assert by["m"][1]["char_start"] == 5 + by["m"][1]["start"] and by["h"][0]["char_start"] == -1
    assert all(len(r["text"]) <= 200 for v in by.values() for r in v)
    assert [r["piece"] for r in by["t"]] == list(range(by["t"][0]["pieces"]))
    assert splitting.split_oversized(items.limit(0), limits, id="id", text="text", key="key", is_table=F.col("chunk_type") == "table_chunk", start="start", max_rows="r", max_chars="c", overlap="o").count() == 0
