import random

import pytest
from quire.llm import language

WORDS = {
    "en": "the of and house which reader writes every morning before window through without paper should would",
    "de": "der die und das haus welches leser schreibt jeden morgen vor dem fenster durch ohne papier sollte würde",
    "fr": "le la les et maison lequel lecteur écrit chaque matin devant la fenêtre sans papier devrait serait",
    "es": "el la los y casa cual lector escribe cada mañana ante la ventana sin papel debería sería según",
    "pt": "o a os e casa qual leitor escreve cada manhã diante da janela sem papel deveria seria não",
}


def sentence(rnd, code, n=9):
    return " ".join(rnd.choice(WORDS[code].split()) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def model(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(sentence(rnd, c) for _ in range(6)), c if i % 20 else "xx") for i, c in enumerate(list(WORDS) * 60)]
    return language.train(spark.createDataFrame(rows, "i long, t string, l string"), id="i", text="t", label="l", per_language=40)


def test_held_out_accuracy_and_mixtures(model):
    rnd = random.Random(9)
    right = 0
    for _ in range(200):
        main, other = rnd.sample(list(WORDS), 2)
        parts = [sentence(rnd, main) for _ in range(5)] + ([sentence(rnd, other)] if rnd.random() < 0.5 else [])
        text = " ".join(parts) + f' ("{WORDS[other][:12]}")'
        got = {r[0] for r in language._document(model, text, 3) if r[4] > 0}
        right += got == ({main, other} if len(parts) == 6 else {main})
    assert right >= 190


def test_labels(spark):
    rows = [(x,) for x in ["EN", "en-US", " eng ", "Deutsch", "zxx", "", None, "--", "français", "it", "pt_BR", "Klingon", "por", "English (UK)"]]
    df = spark.createDataFrame(rows, "l string")
    assert [r[0] for r in df.select(language.label_code(df.l)).collect()] == ["en", "en", "en", "de", "", "", "", "", "fr", "it", "pt", "klingon", "pt", "en"]


def test_issues_and_odd_rows(spark, model):
    rnd = random.Random(3)
    en, de = [" ".join(sentence(rnd, c) for _ in range(5)) for c in ("en", "de")]
    rows = [("a", en, "English"), ("b", en, None), ("c", en, "de-AT"), ("d", en + " " + sentence(rnd, "de", 12), "en"), ("e", "12 34\n56", None), ("f", "", None), ("g", None, "xx"), (None, de, ""), ("h", de, " "), ("h", de, " "), ("i", (en + "\n\n") * 400, "fr")]
    df = spark.createDataFrame(rows, "id string, main string, code string")
    got = sorted(map(tuple, language.issues(df, model, id="id", text="main", label="code").collect()))
    assert got == [("b", "missing", "en"), ("c", "wrong", "en"), ("d", "mixed", "de"), ("d", "mixed", "en"), ("h", "missing", "de"), ("i", "wrong", "en")]
    seg = language.segments(df, model, id="id", text="main").filter("id = 'd'").orderBy("segment").collect()
    assert [s["code"] for s in seg] == ["en", "de"] and all(0.5 < s["confidence"] <= 1 for s in seg)
    assert "".join(s["text"] for s in seg) == rows[3][1] and [s["char_start"] for s in seg] == [0, seg[0]["char_end"]]
    assert language.issues(df.limit(0), model, id="id", text="main", label="code").count() == 0


def test_segments_hold_the_whole_text(model):
    rnd = random.Random(5)
    for _ in range(60):
        parts = [sentence(rnd, rnd.choice(["en", "de", "fr"])) for _ in range(6)]
        parts.insert(rnd.randrange(7), rnd.choice(['("la casa")', "[12]", "12 34", "„das Haus“", "\n\n", "\f"]))
        text = rnd.choice(["", "12. ", "(x) "]) + rnd.choice([" ", "\n\n"]).join(parts)
        runs = language._runs(model, text)
        assert "".join(r[6] for r in runs) == text and all(text[r[4] : r[5]] == r[6] for r in runs)
        assert sum(r[5] for r in language._document(model, text, 3)) == sum(map(str.isalpha, text))


def test_repeated_ids_take_the_latest_version(spark, model):
    rnd = random.Random(7)
    en, de = [" ".join(sentence(rnd, c) for _ in range(5)) for c in ("en", "de")]
    df = spark.createDataFrame([("a", en, None, "2024-01-01"), ("a", de, None, "2024-01-02"), ("a", de, None, "2024-01-02")], "id string, main string, code string, version string")
    got = [tuple(r) for r in language.issues(df, model, id="id", text="main", label="code", version="version").collect()]
    assert got == [("a", "missing", "de")]
