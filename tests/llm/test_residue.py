import pytest
from quire.llm import residue

CASES = [
    ("Dear {{ customer name }}, your order", {"placeholder"}),
    ("title = <%= owner %>", {"placeholder"}),
    ("The guide shows `{{ customer }}` as syntax.", set()),
    ("Syntax:\n```\nname = ${owner}\n```\ndone", set()),
    ("The range {1, 2, 3} and \\frac{{1}}{{2}} and [see appendix C] and <5 mm> stay.", set()),
    ("| a<br>b | c |\n| --- | --- |", set()),
    ("Lorem ipsum dolor sit amet consectetur elit.", {"filler"}),
    ("Designers call such passages lorem ipsum, and the guide forbids them.", set()),
    ("foo bar baz foo bar baz foo bar baz.", {"filler"}),
    ("Your text goes here.\n\nReal words follow the heading of the report.", {"filler"}),
    ("HTTP Error 502\nBad Gateway", {"error_page"}),
    ("Zugriff verweigert.", {"error_page"}),
    ("The chapter on error 404 describes how the scanner reacts when a page is not found.", set()),
    ("The parser logs error 500 and retries 3 times.", set()),
    ("Please enable JavaScript and try again.", {"script_notice"}),
    ("Release 3 drops the JavaScript menu; readers without scripts see the plain list.", set()),
    ("Your session has expired. {{ name }}\nScripting is off.", {"error_page", "placeholder", "script_notice"}),
    ("", set()),
]


@pytest.fixture(scope="module")
def found(spark):
    common = [(1000 + i, f"The parser checks page {i} of the report and the text of the archive, as the guide on the reading order says in the office.", "x") for i in range(300)]
    rows = [(i, t, "x") for i, (t, _) in enumerate(CASES)] + common + [(900, None, "x"), (None, "Access denied.", "x"), (901, "Access denied.", "x"), (901, "Access denied.", "x"), (902, "word " * 100_000 + "\nAccess denied.", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, residue string")
    return df, {(r["doc_id"], r["residue"]) for r in residue.residues(df, id="doc_id", text="text").collect()}


def test_cases(found):
    _, rows = found
    assert {(i, s) for i, s in rows if i < 900} == {(i, s) for i, (_, sorts) in enumerate(CASES) for s in sorts}
    assert {r for r in rows if r[0] >= 900} == {(901, "error_page"), (902, "error_page")}


def test_clean_and_empty(found):
    df, rows = found
    kept = {r["doc_id"] for r in residue.clean(df, id="doc_id", text="text").collect()}
    assert not kept & {i for i, _ in rows} and {2, 900, 1000} <= kept
    assert residue.residues(df.limit(0), id="doc_id", text="text").count() == 0

HELD_OUT = [  # wordings that are in no exemplar
    ("Please enable JavaScript to use this form.", "script_notice"),
    ("You need to enable JavaScript to see the archive.", "script_notice"),
    ("Veuillez activer JavaScript pour lire cette page.", "script_notice"),
    ("Ative o JavaScript no navegador para abrir a página.", "script_notice"),
    ("Bitte aktivieren Sie JavaScript im Browser.", "script_notice"),
    ("HTTP/2 503 Service Unavailable", "error_page"),
    ("Error 431: Request Header Fields Too Large!", "error_page"),
    ("We are sorry, page not found.", "error_page"),
    ("Access denied (code 7).", "error_page"),
    ("La página solicitada no existe.", "error_page"),
    ("at org.sample.Reader.parse(Reader.java:77)", "error_page"),
    ('File "tools/read.py", line 3, in parse', "error_page"),
    ("Eiusmod tempor nisi aliqua velit dolore, laboris.", "filler"),
    ("Your own text goes here.", "filler"),
    ("Send it to <%= customer.street %> now.", "placeholder"),
    ("Objet : {{{ref_no}}}", "placeholder"),
    ("Signed by XX-head of office-XX on the day", "placeholder"),
    ("The sum of TODO_AMOUNT is due", "placeholder"),
    ("Hello [Your first name], welcome", "placeholder"),
    ("ends on $END_DATE at noon", "placeholder"),
    ("of @@city@@ and %REGION% with #ZIP#", "placeholder"),
    ("(delivery date: to be completed)", "placeholder"),
]


def _detector(extra=()):
    import numpy as np

    words, forms = residue.labelled_words(), residue.labelled_shapes()
    names = {t for _, ts, _ in words + forms for t in ts}
    common = {t: 400 for t in "# the a of and to in is at on you we are page this for with not be if it la de le".split()}
    return residue.Detector(words, forms, residue.Weights({t: common.get(t, 5) for t in names}, np.full(residue.BUCKETS, 30), 1000))


def test_held_out_wordings():
    d = _detector()
    wrong = [(t, d.sorts(t)) for t, sort in HELD_OUT if d.sorts(t) != {sort}]
    assert len(wrong) <= len(HELD_OUT) // 10, wrong


@pytest.mark.parametrize(
    "text",
    [
        "x < y and z > 3, with f{a} and \\textbf{bold} and {1, 2} and arr[NAME] and List<Name>",
        "<td>cell</td><br/><h2>head</h2> and [link text](http://x) and [3] and [A] and [see above]",
        "# Heading\n#tag and C# and 50% of it, $300 and US$ALL, he said ... (laughs) at noon (Paris: 3)",
        "| a | b |\n| --- | --- |\n| 1 | 2 |",
        "```\n{{ name }}\n```\nUse `${name}` or ``<%= x %>`` there.",
        "The error of 404 pages was found, and nobody had access to the denied folder.",
    ],
)
def test_look_alikes_are_no_residue(text):
    assert _detector().sorts(text) == set()


def test_weights_do_not_depend_on_the_size_of_the_corpus():
    for n in (10_000, 1_000_000):
        assert residue.Weights.idf(0, n) == pytest.approx(residue.Weights.idf(0, 100 * n), abs=0.8)
        assert residue.Weights.idf(n // 50, n) == pytest.approx(residue.Weights.idf(2 * n, 100 * n), abs=0.01)
