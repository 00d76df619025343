import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from quire.functions import cells, geometry, ids, text, vectors
from quire.operators import lexical, workbook


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "f,value,want",
    [
        (text.strip, " \t a b \n", "a b"),
        (text.clean, "a \r\nb\t\n", "a\nb"),
        (text.collapse, " a \n b ", "a b"),
        (text.fold, "Straße’S", "strasse's"),
        (text.sanitize, " \n ", " "),
        (text.sanitize, "x" * 30_000, "x" * 24_000),
        (text.sanitize, "字" * 7_000, "字" * 6_000),
        (text.token_estimate, "abcd", 3),
        (text.token_estimate, "字字", 4),
        (text.markdown_title, "x\n ## Head  ##\n# B", "Head"),
        (text.pascal_label, "section-header item", "SectionHeaderItem"),
        (text.pascal_label, "--", "Block"),
        (text.slug, "-a b/c.", "a-b-c"),
        (text.file_format, "a/b.C.PDF", "pdf"),
        (text.file_format, "a/.hidden", "unknown"),
        (text.file_format, "noext", "unknown"),
        (text.content_type, "x.md", "text/markdown"),
        (text.safe_file_name, "a/b  c?.txt", "b-c-.txt"),
        (text.safe_file_name, "--", "document"),
        (text.clean_etag, ' "abc" ', "abc"),
        (text.s3_bucket, "s3://b/k/x", "b"),
        (text.s3_key, "s3://b/k/x", "k/x"),
        (text.s3_key, "s3://b/k?x", None),
        (text.table_html, "a <TABLE x><tr></tr></table> b <table></table>", "<TABLE x><tr></tr></table>"),
        (text.html_text_py, "<p>a &amp; b</p><script>c</script>", "a & b c"),
        (text.sanitize_html_py, "<p onclick=x>a<script>b</script><td colspan=2>c&lt;</td>", "<p>ab<td colspan='2'>c&lt;</td>"),
        (text.sanitize_html_py, "<A HREF='x>y'>l</A><!-- no --><x>&amp;<br/></br><td rowspan=2px colspan='3'>\"", "<a>l</a>&amp;<br><td colspan='3'>&quot;"),
        (text.casefold_py, "Ǆ’", "ǆ'"),
        (text.fold, "ﬁn Σίσυφοςs’ e\u0301 ſ µ", "fin σίσυφοσs' é s μ"),
        (text.fold, "STRASSE Straße’", "strasse strasse'"),
        (lambda c: text.portable_path(c, "/root/"), "/root/a/b", "a/b"),
    ],
)
def test_strings(spark, f, value, want):
    assert one(spark, value, f) == want


def test_analyze_and_payload(spark):
    s = "The scan_ner's don't’s Über 3x x²  -- STRASSE straße"
    toks = one(spark, s, text.analyze)
    assert toks == workbook.terms_py(s)
    p = one(spark, s, lexical.payload)
    assert p["dl"] == len(toks) and p["tf"] == {t: toks.count(t) for t in toks}
    assert one(spark, " -- ", lexical.payload) is None and one(spark, None, lexical.payload) is None


def test_ids_and_embedding(spark):
    assert one(spark, "u", ids.document_id) == hashlib.sha1(b"data-object::u").hexdigest()[:16]
    assert one(spark, None, lambda c: ids.short_id(c, F.lit("x"))) == hashlib.sha1(b"None::x").hexdigest()[:16]
    raw = [b / 127.5 - 1 for k in range(3) for b in hashlib.sha256(f"{k}:text".encode()).digest()][:70]
    n = sum(x * x for x in raw) ** 0.5
    assert one(spark, "text", lambda c: vectors.hash_embedding(c, 70)) == pytest.approx([x / n for x in raw])
    assert one(spark, [0.0, 0.0], vectors.normalized, "array<double>") == [0.0, 0.0]


def test_citations_and_mid_sentence(spark):
    c = ["/page/3/Text/0", " ", "/page/3/Text/0", "odd", "/page/4/x"]
    assert [tuple(r) for r in one(spark, c, lambda x: text.source_refs(x, "f"), "array<string>")] == [("/page/3/Text/0", 3, "f"), ("odd", None, "f"), ("/page/4/x", 4, "f")]
    assert one(spark, c, text.single_page, "array<string>") is None and one(spark, c[:3], text.single_page, "array<string>") == 3
    for s, end, want in (("It ends.", 5, False), ("It goes on", 5, True), ("It goes on", 10, False), ("  ", 1, False)):
        assert one(spark, s, lambda x, e=end: text.mid_sentence(x, F.lit(e), F.lit(10))) is want


def test_tables_and_cells(spark):
    assert one(spark, ["a", " a ", "", None, "a_2", "key"], lambda c: cells.unique_headers(c, ["key"]), "array<string>") == ["a", "a_2", "column_3", "column_4", "a_2_2", "key_2"]
    rows = [[""], ["a", ""], [None], ["b"], ["", " "]]
    assert [(r["row"], r["cells"]) for r in one(spark, rows, cells.trim_outer_rows, "array<array<string>>")] == [(2, ["a", ""]), (3, [None]), (4, ["b"])]
    assert text.table_shape("<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td colspan=2>c</td></tr></table>") == (2, 3)
    assert text.table_shape("<p>no</p>") is None and text.table_shape(None) is None
    assert text.table_shape('<TABLE><thead><tr><th COLSPAN="3">a</th></tr></thead><tr><td rowspan="9">b<td><table><tr><td>x<td>y<td>z</table></td><!-- <td> --></tr><tr></tr></TABLE>') == (3, 3)
    assert text.table_shape("<table><tr><td>a</td></tr><tr><td rowspan=2>b</td></tr><tr><td>c</td><td>d</td></tr></table>") == (3, 3)
    for v, kind, want in ((True, T.BooleanType(), "true"), (3.0, T.DoubleType(), "3"), (2.5, T.DoubleType(), "2.5"), (None, T.StringType(), "")):
        df = spark.createDataFrame([(v,)], T.StructType([T.StructField("x", kind)]))
        assert df.select(cells.cell(F.col("x"), kind)).first()[0] == want


def test_boxes(spark):
    assert one(spark, "10, 20, 30.5, 40", geometry.box_of_text) == [10, 20, 30.5, 40]
    assert one(spark, [0.0, 0.0, 0.0, 1.0], geometry.area, "array<double>") is None
    assert one(spark, [1.0, 2.0, 4.0, 6.0], geometry.area, "array<double>") == 12
    assert one(spark, [[0.0, 1.0], [4.0, 1.0], [4.0, 3.0]], geometry.box_of_polygon, "array<array<double>>") == [0, 1, 4, 3]
    assert one(spark, [10.0, 10.0, 20.0, 20.0], lambda c: geometry.crop(c, F.lit(25), F.lit(20), 0.05), "array<double>") == [9, 9, 21, 20]
    assert one(spark, [-5.0, 0.0, 5.0, 5.0], lambda c: geometry.clamp(c, F.lit(4), F.lit(4)), "array<double>") == [0, 0, 4, 4]
