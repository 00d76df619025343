import os
import random
import re

import pytest
from pyspark.sql import functions as F
from quire import registry
from quire.config import ChunkEmbedConfig, InputConfig, input_mode
from quire.operators import chunking, documents, embedding, layout, retrieval, workbook

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def texts(rnd):
    return "".join(rnd.choice(["Wort ", "Satz. ", "Frage? ", "\n\n", "x" * rnd.randint(1, 60) + " ", "\n", "。 "]) for _ in range(rnd.randint(0, 80)))


def test_span_rules():
    assert chunking.fixed_overlap("w0 w1 w2 w3 w4 w5 w6 w7 w8 w9", 4, 1) == [(0, 11), (9, 20), (18, 29)]
    assert chunking.fixed_overlap("a b c d", 4, 1) == [(0, 7)] and chunking.fixed_overlap("a b c d e", 2, 2) == [(0, 3), (2, 5), (4, 7), (6, 9)]
    gaps = "a\n\n\n b \n\nc"
    assert [gaps[a:z] for a, z in chunking.paragraph(gaps)] == ["a", " b ", "c"]
    assert ["A b. C d! E"[a:z] for a, z in chunking.sentence_group("A b. C d! E", 1)] == ["A b.", "C d!", "E"]
    assert len(chunking.sentence_group("A. " * 7, 5)) == 2
    assert chunking.recursive("x" * 60, 40) == [(0, 60)] and chunking.recursive("x" * 200, 40) == [(0, 80), (80, 160), (160, 200)]
    for f in (chunking.fixed_overlap, chunking.paragraph, chunking.sentence_group, chunking.recursive):
        assert f("") == [] and f("  \n") == []


def test_spans_hold_all_words():
    rnd = random.Random(1)
    for _ in range(200):
        t = texts(rnd)
        for f, kw in ((chunking.paragraph, {}), (chunking.sentence_group, {"n": 2}), (chunking.recursive, {"target": 50}), (chunking.fixed_overlap, {"n_words": 7, "overlap": 2})):
            s = f(t, **kw)
            covered = "".join(t[a:z] if a >= last else t[last:z] for (a, z), last in zip(s, [0, *(z for _, z in s)]))
            assert re.sub(r"\s", "", covered) == re.sub(r"\s", "", t)
            assert f is chunking.fixed_overlap or all(a[1] <= b[0] for a, b in zip(s, s[1:]))
        assert all(z - a <= 100 for a, z in chunking.recursive(t, 50))


def test_spans_keep_columns_and_odd_texts(spark):
    df = spark.createDataFrame([(1, "a b c", 2.5), (2, None, None), (3, "", 1.0), (4, "𝄞 b", 1.0)], "start long, text string, piece_of double")
    out = chunking.spans(df.withColumnRenamed("start", "id"), "text", "fixed_overlap", {"n_words": 2, "overlap": 0}).orderBy("id", "piece").collect()
    assert [(r["id"], r["piece"], r["start"], r["end"], r["content"], r["piece_of"]) for r in out] == [(1, 0, 0, 3, "a b", 2.5), (1, 1, 4, 5, "c", 2.5), (4, 0, 0, 3, "𝄞 b", 1.0)]


DOC = "doc_id string, language string, main_text string, main_text_citations array<string>, tables array<struct<caption:string,caption_citations:array<string>,content:string,content_citations:array<string>>>, figures array<struct<caption:string,description:string>>, formulas array<string>"


def docs(spark):
    rows = "\n".join(f"| {i} |" for i in range(45))
    table = (" Cap ", ["/page/2/x/0"], f"| h |\n| --- |\n{rows}", [])
    return spark.createDataFrame([("d1", "en", "One. Two.", ["/page/1/Text/0"], [table, (None, None, "  ", None), (None, None, "| h |", ["/page/4/Table/1"])], [("c", "d"), (None, " "), (None, "only")], ["x^2", " ", "y"]), ("d2", None, " ", None, None, None, None)], DOC)


def test_document_chunks_and_items(spark):
    c = chunking.document_chunks(docs(spark), ChunkEmbedConfig(chunker="sentence_group", chunker_params={"n": 1})).cache()
    got = [(r["field_path"], r["chunk_type"], r["piece"], r["start"], r["end"], r["page"]) for r in c.orderBy("route", "field_index", "piece").collect()]
    assert got[:2] == [("main_text", "text_chunk", 0, 0, 4, 1), ("main_text", "text_chunk", 1, 5, 9, 1)]
    assert [g[0] for g in got[2:]] == ["tables[0]"] * 3 + ["tables[2]", "figures[0]", "figures[2]", "formulas[0]", "formulas[2]"]
    assert [g[5] for g in got[2:6]] == [2, 2, 2, 4]
    second = c.filter("field_path = 'tables[0]' and piece = 1").first()
    assert second["content"].startswith("| h |\n| --- |\n| 20 |") and second["content"].endswith("| 39 |") and second["caption"] == "Cap"
    assert c.filter("field_path = 'figures[0]'").first()["content"] == "c\n\nd"
    items = {r["field_path"]: r for r in retrieval.items(c).filter("retrieval_type <> 'text_chunk'").collect()}
    assert items["tables[2]"]["position_index"] == 2
    text = retrieval.items(c).filter("retrieval_type = 'text_chunk'").orderBy("position_index").collect()
    assert [r["field_path"] for r in text] == ["main_text", "main_text", "formulas[0]", "formulas[2]"]
    e = registry.create_embedder("local_hash", {"dimension": 8})
    joined = retrieval.with_vectors(retrieval.items(c), retrieval.vectors(c, e))
    assert joined.filter("size(embeddings) <> 1").count() == 0
    assert c.select("chunk_id").distinct().count() == c.count()
    assert chunking.document_chunks(docs(spark).limit(0), ChunkEmbedConfig()).count() == 0
    q = retrieval.quality(c).first()
    sizes = sorted(len(r["content"]) for r in c.collect())
    assert q["chars_p90"] == sizes[min(len(sizes) - 1, int(0.9 * (len(sizes) - 1) + 0.5))] and q["chunks"] == len(sizes)
    assert retrieval.quality(c.limit(0)).count() <= 1


def test_units_and_resources(spark):
    from quire import registry

    @registry.chunker("halves_of_test", needs=("size",))
    def halves(text, resources, sep="|"):
        a, _, b = text.partition(sep)
        n = resources["size"]
        return [registry.Unit(0, len(text), text[:n], 0, None, [1, 2, 9]), registry.Unit(0, len(a), a, 1, 0), registry.Unit(len(a) + 1, len(text), b, 1, 0, [], "half_chunk")]

    config = ChunkEmbedConfig(chunker="halves_of_test", chunker_params={"sep": "|"})
    one = docs(spark).limit(1).withColumn("main_text", F.lit("ab|c"))
    with pytest.raises(RuntimeError):
        chunking.document_chunks(one, config)
    c = {x["unit"]: x for x in chunking.document_chunks(one, config, {"size": 3}).filter("route = 0").collect()}
    assert c[1]["parent_id"] == c[0]["chunk_id"] and c[0]["child_ids"] == [c[1]["chunk_id"], c[2]["chunk_id"]] and c[2]["child_ids"] == [] and c[0]["parent_id"] is None
    assert (c[0]["content"], c[2]["content"], c[2]["level"], c[2]["chunk_type"], c[0]["chunk_type"]) == ("ab|", "c", 1, "half_chunk", "text_chunk")
    assert len({x["chunk_id"] for x in c.values()}) == 3


EX = "struct<document_type:string,language:string,title:string,main_text:string,tables:array<string>,figures:array<string>,formulas:array<string>>"
PARSED = f"object_id string, source_uri string, source_format string, text string, rows array<struct<extraction:{EX},source_blocks:array<struct<component_id:string,page:int,block_index:int,type:string,text:string,bbox:array<double>>>,reading_order:array<string>>>, metadata struct<parser:string,backend:string,page_count:int>"


def row(main=None, blocks=(), title=None, formulas=()):
    return ((None, None, title, main, [], [], list(formulas)), list(blocks), [])


def test_validation_views_and_schema(spark):
    rows = [
        ("ok", "u", "pdf", None, [row("A"), row("", title="T"), row("B")], ("p", "native", 1)),
        ("zero", "u", "pdf", "x", [], ("p", "native", 0)),
        ("null", "u", "pdf", None, [(None, [], [])], ("p", "hosted", None)),
        ("blank", "u", "pdf", " \n", [row(" ")], ("p", "native", 2)),
        ("formula", "u", "pdf", None, [row(None, formulas=["x"])], ("p", "native", None)),
        ("block", "u", "pdf", None, [row(None, blocks=[("/page/0/Text/0", 0, 0, "Text", "t", None)])], ("p", "native", None)),
        ("norows", "u", "pdf", None, None, ("p", "native", None)),
    ]
    df = spark.createDataFrame(rows, PARSED)
    v = documents.validated(df)
    got = {r["object_id"]: [x["code"] for x in r["reasons"]] for r in v.collect()}
    assert got == {"ok": [], "zero": ["zero_page_count"], "null": ["null_extraction", "empty_parsed_content"], "blank": ["empty_parsed_content"], "formula": [], "block": [], "norows": ["empty_parsed_content"]}
    assert documents.accepted(v).count() == 3 and documents.quarantined(v).count() == 4
    view = {r["source_object_id"]: r for r in documents.view(df).collect()}
    assert view["ok"]["main_text"] == "A\n\nB" and view["ok"]["title"] == "T" and view["ok"]["row_count"] == 3
    s = {r["source_object_id"]: r for r in documents.initial_schema(df).collect()}
    assert s["ok"]["observed_fields"] == ["document.title", "document.main_text"] and s["formula"]["relationships"][0]["relationship_type"] == "has_formula"
    assert {r["source_object_id"]: r["reason"] for r in retrieval.failures(df).collect()} == {"zero": "the document has no rows", "null": "the first row has no extraction", "norows": "the document has no rows"}
    assert documents.latest(df.unionByName(df), "object_id").count() == 7
    h = spark.createDataFrame([([["a", " "], ["b", "a"]],)], "h array<array<string>>").select(documents.header_fields(F.col("h"))).first()[0]
    assert h == ["table.a", "table.b"]


def test_layout(spark):
    b = [("/page/10/Text/0", 10, 0, "Text", "x", [0.0, 0.0, 5.0, 5.0]), ("/page/2/Text/1", 2, 1, "Text", "y", [0.0, 0.0, 100.0, 100.0]), ("odd", None, 0, "Text", "z", None), ("/page/2/Text/1", 2, 1, "Text", "again", None), ("/page/2/Picture/0", 2, 0, "Picture", "p", [0.0, 0.0, 9.0, 9.0])]
    df = spark.createDataFrame([("d", "u", "pdf", None, [row("m", blocks=b)], ("p", "native", 1))], PARSED)
    blocks = layout.blocks(df)
    assert [r["component_id"] for r in layout.reading_order(blocks).orderBy("position").collect()] == ["/page/2/Picture/0", "/page/2/Text/1", "/page/10/Text/0", "odd"]
    assert {r["page"]: r["bounds"] for r in layout.page_bounds(blocks).collect()} == {10: [0, 0, 5, 5], 2: [0, 0, 100, 100]}
    figs = spark.createDataFrame([("d", "pdf", 0, "/page/2/Picture/0", "A chart"), ("d", "pdf", 1, "/page/2/Text/1", "Company logo"), ("d", "pdf", 2, "none", "logotype"), ("d", "docx", 3, "none", "logo")], "object_id string, source_format string, original_index int, source_ref string, description string")
    f = {r["original_index"]: (r["reasons"], r["geometry_reason"]) for r in layout.figure_filter(figs, blocks).collect()}
    assert f == {0: (["below_min_page_area_ratio"], None), 1: (["short_ocr_logo_description"], None), 2: ([], "missing_or_invalid_bbox"), 3: ([], "missing_or_invalid_bbox")}
    assets = spark.createDataFrame([("d", 0, "/page/2/Text/1"), ("d", 1, None), ("d", 2, None), ("d", 3, None)], "object_id string, asset_index int, source_ref string")
    m = {r["original_index"]: r["asset_index"] for r in layout.match_assets(figs, assets).collect()}
    assert m == {0: 0, 1: None, 2: 2, 3: 3} or m == {0: 0, 1: 1, 2: 2, 3: 3}
    found = layout.walk_blocks({"block_type": "Page", "bbox": [0, 0, 9, 9], "children": [{"id": "/page/0/Text/1", "html": "<p>a</p> b"}, {"id": "/page/0/Page/0", "block_type": "Page"}]})
    assert [(x["component_id"], x["text"], x["page_bbox"]) for x in found] == [("/page/0/Text/1", "a b", [0, 0, 9, 9])]
    assert layout.walk_blocks("{broken") == []


def test_joins_and_reports(spark):
    asked = spark.createDataFrame([("u", 3, "r3"), ("u", 1, "r1"), ("v", 2, "r2"), ("w", 9, "r9")], "k string, n int, r string")
    got = spark.createDataFrame([("v", 1, "a"), ("u", 5, "c"), ("u", 4, "b")], "k string, m int, d string")
    assert {r["r"]: r["d"] for r in retrieval.restore_order(asked, got, "k", "n", "m").collect()} == {"r1": "b", "r3": "c", "r2": "a"}
    df = spark.createDataFrame([(True,), (None,)], "f boolean")
    assert df.agg(retrieval.stage_mode(F.col("f"))).first()[0] == "implemented"
    assert df.filter("f").agg(retrieval.stage_mode(F.col("f"))).first()[0] == "pass-through"
    assert df.limit(0).agg(retrieval.stage_mode(F.col("f"))).first()[0] == "implemented"
    a = spark.createDataFrame([("k", "x"), ("k", "x"), ("k", "y")], "k string, t string")
    o = retrieval.multiset_overlap(a, a.limit(2), ["k"], "t").first()
    assert (o["overlap"], o["precision"]) == (2, 1.0)


def test_registry_and_config():
    with pytest.raises(ValueError):
        registry.chunker("paragraph")(lambda t: [])
    with pytest.raises(KeyError, match="known"):
        registry.chunker_info("nothing")
    assert registry.chunker_info("recursive_400")["name"] == "recursive"
    registry.chunker("needs_model", needs=("model",))(lambda t: [])
    with pytest.raises(RuntimeError):
        registry.get_chunker("needs_model")
    assert "quire.operators.chunking" in registry.load_plugins("quire.operators")
    assert InputConfig("x", extensions=("PDF", ".md")).extensions == (".pdf", ".md")
    with pytest.raises(ValueError):
        InputConfig("x", max_files=0)
    with pytest.raises(ValueError):
        input_mode({"local": "a", "inventory": "b"}, "local")
    assert ChunkEmbedConfig.of({"chunker": "paragraph", "other": 1}).chunker == "paragraph"
    assert embedding.token_batches([3, 3, 3, 9, 1], 2, 7) == [[0, 1], [2], [3], [4]]


def test_provider_embedder_uses_its_cache(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "k int, t string")
    import hashlib

    cache = spark.createDataFrame([(hashlib.sha1(b"m:b").hexdigest(), [9.0])], "text_hash string, vector array<double>")

    def ask(texts):
        assert "b" not in texts
        return [[float(len(t))] for t in texts]

    e = embedding.Provider(ask, "m", 1, cache=cache)
    assert {r["k"]: r["v"] for r in e.apply(df, "t", "v").collect()} == {1: [1.0], 2: [9.0], 3: [1.0]}


def test_workbook_responses(spark):
    import json

    bodies = [
        {"structures": [{"sheet": "S", "structure": {}, "odd": 1}, None], "workbooks": [" wb "], "metadata_artifacts": [{"workbook": "x", "metadata": {"name": "first"}}, {"workbook": "wb", "metadata": {"name": "N", "description": "D"}}], "retrieval_items": [{"id": 7, "content": {"a": "x y", "b": [1, True, None]}, "embedding": {"embedding_model": "m", "embedding": [1, 2]}}, "bare"]},
        {"structures": [{"sheet": "S"}], "retrieval": {"items": []}},
        {"job": 1},
    ]
    df = spark.createDataFrame([(str(i), "a/b.xlsx", json.dumps(b)) for i, b in enumerate(bodies)] + [("3", None, "{"), ("4", "u", None)], "id string, uri string, body string")
    n = {r["response_id"]: r for r in workbook.normalize(df, "id", "uri", "body").collect()}
    assert set(n) == {"0", "1"} and n["0"]["title"] == "N" and n["0"]["avgdl"] == 3.0 and n["0"]["embeddings"] == 1 and n["1"]["title"] == "b.xlsx"
    i = {(r["response_id"], r["item_index"]): r for r in workbook.items(df, "id", "uri", "body").collect()}
    assert i["0", 0]["item_id"] == "7" and i["0", 0]["embeddings"][0].asDict() == {"model": "m", "dimension": 2, "values": [1.0, 2.0], "extensions": None}
    assert i["1", 0]["item_id"] == "b.xlsx:S:0" and i["0", 0]["tf"] == {"1": 1, "x": 1, "y": 1}
    assert {r["response_id"] for r in workbook.invalid(df, "id", "uri", "body").collect()} == {"2", "3", "4"}


def test_workbook_annotations_and_odd_shapes(spark):
    import json

    body = {
        "structures": [{"workbook": "", "sheet": "S", "status": None, "structure": {"b": 1}, "odd": {"k": 1}, "none": None}, "{}", 3], "workbooks": [None, " ", "one", "two"], "answers": [{"a": 1}], "artifacts": "none", "trace": 1.5,
        "retrieval": {"items": [{"item_id": 0, "id": "x", "type": "", "content": "bare", "table_name": "T 1", "embeddings": [None, {"values": None, "embedding": [1], "dimension": 0, "unit": "u"}, {"values": 3}]}, None], "scope": "all", "none": None},
        "metadata_artifacts": [{"workbook": "two", "metadata": {"name": "N", "owner": "o"}, "note": 1}, {"workbook": "one", "metadata": {}}, 7],
    }
    df = spark.createDataFrame([("r", "u/one", json.dumps(body), "clash")] * 2 + [(None, "u", "{}", "")], "id string, uri string, body string, title string")
    n = workbook.normalize(df, "id", "uri", "body").collect()
    assert len(n) == 1 and n[0]["title"] == "one" and n[0]["tables"] == 1 and json.loads(n[0]["extensions"]) == {"trace": 1.5}
    assert json.loads(n[0]["table_json"])[0]["workbook"] == "one" and json.loads(json.loads(n[0]["table_json"])[0]["extensions"]) == {"odd": {"k": 1}}
    i = workbook.items(df, "id", "uri", "body").collect()
    assert [(r["item_index"], r["item_id"], r["type"], json.loads(r["content"]), r["dl"]) for r in i] == [(0, "x", "table", {"table_name": "T 1"}, 2)]
    assert [e.asDict() for e in i[0]["embeddings"]] == [{"model": None, "dimension": 1, "values": [1.0], "extensions": '{"unit":"u"}'}]
    a = {(r["place"], r["key"]): r["value"] for r in workbook.annotations(df, "id", "uri", "body").collect()}
    assert a == {("answers", "0"): '{"a":1}', ("extensions", "trace"): "1.5", ("extensions", "retrieval.scope"): '"all"', ("extensions", "additional_workbooks[0]"): '" "', ("extensions", "additional_workbooks[1]"): '"one"', ("extensions", "additional_workbooks[2]"): '"two"', ("workbook_metadata[two]", "metadata.owner"): '"o"', ("workbook_metadata[two]", "note"): "1"}
    assert workbook.items(df.limit(0), "id", "uri", "body").count() == 0


def test_provider_retries_halves_and_fills_its_cache(spark, tmp_path):
    from quire.operators.embedding import OutOfMemory, Provider, Transient, halved, retried, tiered

    pauses, left = [], [3]

    def flaky():
        left[0] -= 1
        if left[0]:
            raise Transient
        return "done"

    assert retried(flaky, 6, pauses.append) == "done" and pauses == [2.0, 4.0]
    with pytest.raises(Transient):
        retried(lambda: (_ for _ in ()).throw(Transient()), 2, pauses.append)

    def small(texts):
        if len(texts) > 2:
            raise OutOfMemory
        return [len(t) for t in texts]

    assert halved(small, ["a", "bb", "ccc", "dddd", "e"]) == [1, 2, 3, 4, 1]
    with pytest.raises(OutOfMemory):
        halved(lambda t: (_ for _ in ()).throw(OutOfMemory()), ["a"])
    batches = tiered([10, 9000, 600, 20, 3000, 600], 64)
    assert sorted(i for b in batches for i in b) == list(range(6)) and batches[0] == [0, 3, 2, 5] or all(len(b) <= 64 for b in batches)
    df = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a")], "k int, t string")
    path = str(tmp_path / "cache")
    first = {r["k"]: r["v"] for r in Provider(lambda ts: [[float(len(t))] for t in ts], "m", 1, cache_path=path, tiers=True).apply(df, "t", "v").collect()}

    def never(texts):
        raise AssertionError("all vectors are in the cache")

    assert first == {1: [1.0], 2: [2.0], 3: [1.0]} == {r["k"]: r["v"] for r in Provider(never, "m", 1, cache_path=path).apply(df, "t", "v").collect()}
    assert spark.read.parquet(path).count() == 2


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no tokenizer files")
def test_exact_token_limit(spark):
    from quire.functions import text as X

    long, short = "word " * 9000, "word " * 500
    df = spark.createDataFrame([(long,), (short,), (None,), (" ",)], "t string")
    rows = df.select(X.limited_py(VOCABULARY)(X.sanitize(F.col("t"))).alias("cut"), X.token_count_py(VOCABULARY)(F.col("t")).alias("n"))
    got = rows.withColumn("m", X.token_count_py(VOCABULARY)(F.col("cut"))).collect()
    e = X.encoding(VOCABULARY)
    assert [r["n"] for r in got] == [len(e.encode_ordinary(long)), len(e.encode_ordinary(short)), None, 1]
    assert got[0]["cut"] == e.decode(e.encode_ordinary(long[:24000])[:8000]) and got[1]["cut"] == short and got[3]["cut"] == " "


def test_content_may_stand_in_any_row_field(spark):
    row = "struct<text:string,extraction:struct<document_type:string,main_text:string,markdown:string,tables:array<string>>,notes:array<string>,extra:struct<k:int>,pages:map<string,int>>"
    cases = [
        (None, [], True), (" ", None, True), ("x", [], False), (None, [(None, None, None, None, None)], True), (None, [(" t", None, [], None, {})], False), (None, [(None, ("letter", " ", "\n", []), [], None, {})], True),
        (None, [(None, (None, None, "m", None), None, None, None)], False), (None, [(None, (None, None, None, ["t"]), None, None, None)], False), (None, [(None, None, ["n"], None, None)], False), (None, [(None, None, None, (1,), None)], False), (None, [(None, None, None, None, {"a": 1})], False),
    ]
    df = spark.createDataFrame([(str(i), t, r) for i, (t, r, _) in enumerate(cases)], f"object_id string, text string, rows array<{row}>").withColumn("metadata", F.expr("struct(1 as page_count, 'native' as backend)"))
    got = {int(r["object_id"]): [x["code"] for x in r["reasons"]] for r in documents.validated(df).collect()}
    assert got == {i: ["empty_parsed_content"] if empty else [] for i, (_, _, empty) in enumerate(cases)}


def test_figure_reference_has_four_levels(spark):
    kind = "struct<description:string,caption:string,source_ref:string,description_citations:array<string>,caption_citations:array<string>,source_refs:array<struct<component_id:string,page:int>>>"
    figs = [("d", "c", " /a ", [" ", "/x"], ["/y"], [("/z", 1)]), ("d", "c", " /a ", None, [None, " /y "], None), ("d", "c", " /a ", [], [], [("/z", 1)]), ("d", "c", " ", None, None, [(" ", 0), (None, 1), ("/z", 2)]), ("d", "c", None, None, None, None)]
    df = spark.createDataFrame([("o", "PDF", [((figs,),)])], f"object_id string, source_format string, rows array<struct<extraction:struct<figures:array<{kind}>>>>")
    assert [r["source_ref"] for r in layout.figures(df).orderBy("original_index").collect()] == ["/x", "/y", "/a", "/z", ""]
    plain = spark.createDataFrame([("o", "PDF", [(([("d", "c", ["p", "q"])],),)])], "object_id string, source_format string, rows array<struct<extraction:struct<figures:array<struct<description:string,caption:string,source_refs:array<string>>>>>>")
    assert [r["source_ref"] for r in layout.figures(plain).collect()] == ["p"]
