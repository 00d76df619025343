import random

import pytest
from quire.llm import scannoise

WORDS = "the table reader checks every page border and a careful editor writes missing caption after second pass while archive office stores document title under older settings because modern scanner returns better images".split()


def clean_lines(rnd, n=8):
    return [" ".join(rnd.choice(WORDS) for _ in range(9)) for _ in range(n)]


@pytest.fixture(scope="module")
def channel(spark):
    rnd = random.Random(1)
    rows = [(str(i), "\n".join(clean_lines(rnd, 30)) + "\na well-known side-by-side view of the XML-file", "x") for i in range(60)]
    rows += [("bad", "the tablc reader ernpty clocument", "x")]
    df = spark.createDataFrame(rows, "id string, text string, field string")
    return scannoise.fit(scannoise.texts_of(df, "id", "text", "f"), 1e-4)


def found(channel, text):
    return scannoise.repair(text, channel)[1]


def test_confusions_are_decoded(channel):
    text, defects = scannoise.repair("The tablc reacler checks evcry pa9e and the d0cument t1tle of the n0thing.", channel)
    assert defects == {"misread"} and text == "The table reader checks every page and the document title of the n0thing."
    assert scannoise.repair("run r5e4a kept 644 of 9126 pages T18 v50", channel)[1] == set()
    assert scannoise.repair("the sc(ond pass, (missing caption)", channel) == ("the second pass, (missing caption)", {"misread"})


def test_line_end_hyphens(channel):
    text, defects = scannoise.repair("the missing cap-\ntion of the well-\nknown side-by-\nside view, XML-\nfile and docu¬\nment", channel)
    assert defects == {"hyphen_break"} and text == "the missing caption of the well-known side-by-side view, XML-file and document"
    assert found(channel, "a well-\nknown table") == set()
    assert found(channel, "the missing cap-\nti0n") == {"hyphen_break", "misread"}


def test_heads_and_page_numbers(channel):
    page = "{}\n{}\nthe careful editor writes the\nmissing caption under the\n"
    head = "Doc. 12/4 – The Table"
    text = "\f".join(page.format(h, f"- {n} -") for n, h in ((7, head), (8, head), (9, "Doc. 12/4 – The Tablc")))
    fixed, defects = scannoise.repair(text, channel)
    assert {"running_header", "page_number"} <= defects and "Doc." not in fixed and "8" not in fixed
    assert fixed.count("\n\n") == 0
    assert found(channel, "7253\n6117\n3781\n1849") == set()
    assert found(channel, "a page\n12\nof the table\n13\nof the archive\n14") == {"page_number"}
    assert found(channel, "Note:\n\nthe table\n\nNote:\n\nthe archive\n\nNote:\n\nthe page") == set()
    assert found(channel, "the page\nxii\nof the table") == {"page_number"}


def test_viterbi_is_the_best_sequence(channel):
    rnd = random.Random(2)
    noisy = ["tablc", "evcry", "pagc", "the", "rcader", "storcs", "wrifes"]
    for _ in range(30):
        parts = [rnd.choice(noisy) for _ in range(4)]
        options = [channel.candidates(w) for w in parts]

        def score(path):
            return sum(c + channel.prior(w, path[i - 1][0] if i else None) for i, (w, c) in enumerate(path))

        best = [[]]
        for o in options:
            best = [p + [x] for p in best for x in o]
        assert score([next(x for x in o if x[0] == w) for o, w in zip(options, channel.decode(parts))]) == pytest.approx(max(map(score, best)))


def test_noise_added_to_clean_text_is_found(channel):
    rnd = random.Random(7)
    right = 0
    for _ in range(100):
        lines = clean_lines(rnd)
        if rnd.random() < 0.5:
            words = lines[3].split()
            k = max(range(9), key=lambda i: len(words[i]))
            true, seen = rnd.choice([(a, b) for a, b in [("e", "c"), ("t", "f"), ("i", "l"), ("s", "5"), ("n", "ri"), ("d", "cl")] if a in words[k]] or [("", "")])
            words[k] = words[k].replace(true, seen, 1) if true else words[k]
            lines[3] = " ".join(words)
            right += ("misread" in found(channel, "\n".join(lines))) == bool(true)
        else:
            right += not found(channel, "\n".join(lines))
    assert right >= 95


def test_query_form(spark):
    rows = [("a", "the page\n\nthe page", 1), ("a", "the page\n\nthe page", 1), ("n", None, 1), ("e", "", 1), (None, "cap-\ntion caption", 1), ("l", "word " * 60_000, 1)]
    df = spark.createDataFrame(rows, "id string, text string, field int")
    t = scannoise.texts_of(df, "id", "text", "f")
    assert scannoise.defects(t).count() == 0
    assert {r["id"] for r in scannoise.repaired(t).collect()} == {"a", "l"}
    empty = scannoise.texts_of(df.limit(0), "id", "text", "f")
    assert scannoise.defects(empty).count() == 0 and scannoise.repaired(empty).count() == 0


def test_confusions_are_learnt_from_the_corpus(spark):
    """A confusion that is not in the prior is found by aligning words, and corrected in words where it was never seen."""
    rnd = random.Random(3)
    rows = []
    for i in range(80):
        words = [w for line in clean_lines(rnd, 30) for w in [*line.split(), "house", "dispatch", "sustain"]]
        for k, w in enumerate(words):
            if "s" in w and w not in ("house", "dispatch") and rnd.random() < 0.015:
                words[k] = w.replace("s", "z", 1)
        rows.append((str(i), " ".join(words)))
    t = scannoise.texts_of(spark.createDataFrame(rows, "id string, text string"), "id", "text", "f")
    ch = scannoise.fit(t, 1e-5, prior=[])
    assert ("s", "z") in ch.rules and 0.001 < 2.718281828 ** ch.rates["s", "z"] < 0.05 and len(ch.rules) <= 4
    assert scannoise.repair("the houze and the dizpatch", ch) == ("the house and the dispatch", {"misread"})


def test_the_whole_lexicon_can_be_held(spark):
    rows = [("a", "the table reader and the unique zebra"), ("b", "the table reader and the table of contents")]
    t = scannoise.texts_of(spark.createDataFrame(rows, "id string, text string"), "id", "text", "f")
    assert "zebra" in scannoise.fit(t, 0, 1).words and "zebra" not in scannoise.fit(t).words


def test_many_heads_and_misread_labels(channel):
    n = len(WORDS)
    heads = [f"The {WORDS[k % n]} {WORDS[(k * 7 + 3) % n]} {WORDS[(k * 11 + 5) % n]} Archive" for k in range(60)]
    lines = []
    for n in range(3):
        for k, h in enumerate(heads):
            lines += [h if n < 2 else h.replace("e", "c", 1), f"the careful editor writes {k} more", f"{'Page' if n else 'Pagc'} {n * 60 + k + 1}"]
    got = scannoise.head_lines(lines, scannoise.page_lines(lines, channel), channel)
    assert {i for i in range(0, len(lines), 3)} == got
    assert scannoise.page_lines(lines, channel) == set(range(2, len(lines), 3))
    assert scannoise.page_lines(["Pagc 4", "Pagan 4", "12 of 40", "- xii -", "Seite | 7", "Paragraph 7"], channel) >= {0, 2, 3}


def test_runs_of_doubtful_words_are_decoded_between_sure_ones(channel):
    whole = "the tablc rcader chccks evcry page bordcr and a carcful edifor".split()
    got = channel.decode(whole)
    assert got == "the table reader checks every page border and a careful editor".split()
    assert channel.decode([]) == [] and channel.decode(["tablc"]) == ["table"]
