import random

from quire.llm import leakage


def distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(t, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min(row)


def brute(passage, text):
    """Any run of n >= 20 words within n // 8 edits of any part of the text."""
    p, t = leakage.words(passage), leakage.words(text)
    return any(distance(p[a : a + n], t) <= n // 8 for n in range(20, len(p) + 1) for a in range(len(p) - n + 1))


def test_myers_equals_plain_distance():
    rnd = random.Random(2)
    for _ in range(300):
        p, t = [rnd.randrange(4) for _ in range(rnd.randint(1, 40))], [rnd.randrange(4) for _ in range(rnd.randint(0, 60))]
        assert leakage.myers(p, t) == distance(p, t)


def test_windows_suffice_and_pieces():
    assert leakage.windows_for(20, 8) == [(20, 2), (24, 3), (32, 4)]
    assert leakage.piece_words([(20, 2), (24, 3), (32, 4)]) == 6


def test_leaks_match_brute_force():
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    passages = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([15, 20, 24, 34, 45]))) for _ in range(12)]
    index = leakage.Index(list(enumerate(passages)), 20, 8)
    agree = hits = 0
    for _ in range(160):
        k = rnd.randrange(len(passages))
        w = leakage.words(passages[k])
        a = rnd.randint(0, max(0, len(w) - 18))
        part = w[a : a + rnd.choice([17, 19, 20, 23, 26, 34, 45])]
        for _ in range(rnd.choice([0, 1, 2, 3, 4, 5])):
            at = rnd.randrange(len(part) + 1)
            part = rnd.choice([part[:at] + ["new"] + part[at:], part[:at] + part[at + 1 :], part[:at] + ["odd"] + part[at + 1 :]])
        text = " ".join([*(rnd.choice(vocabulary) for _ in range(8)), *part, *(rnd.choice(vocabulary) for _ in range(8))])
        want = {i for i, p in enumerate(passages) if brute(p, text)}
        got = set(index.leaks(text))
        assert got == want
        hits += bool(want)
        agree += 1
    assert hits > 40


def test_query_form(spark):
    passage = " ".join(f"word{i}" for i in range(30))
    quoted = "> «" + passage.upper().replace(" ", ",\n> ") + "»"
    docs = spark.createDataFrame([(1, "intro " + passage + " end", 0), (1, passage, 0), (2, quoted, 0), (3, None, 0), (4, "", 0), (None, passage, 0), (5, " ".join(passage.split()[:17]), 0), (6, "x " * 50_000 + passage, 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, passage), (7, passage), (8, None), (9, "short one"), (None, passage)], "i long, p string")
    got = leakage.leaks(docs, items, id="doc_id", text="text", item_id="i", passage="p", items_per_block=1).collect()
    assert sorted(map(tuple, got)) == [(1, 7), (2, 7), (6, 7)]
    assert leakage.leaks(docs.limit(0), items, id="doc_id", text="text", item_id="i", passage="p").count() == 0
    assert leakage.leaks(docs, items.limit(0), id="doc_id", text="text", item_id="i", passage="p").count() == 0
