import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F
from quire.config import ChunkEmbedConfig, InputConfig
from quire.operators import chunking
from quire.plans import artifacts, ingest, pipeline
from quire.sources import files, office
from quire.streaming import incremental

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, x in parts.items():
            z.writestr(n, x)
    return out.getvalue()


def docx():
    p = lambda t, pr="": f"<w:p><w:pPr>{pr}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in (("h", "i"), ("1", "a|b"))) + "</w:tbl>"
    return packed({"word/document.xml": f'<w:document {W}><w:body>{p("Head", "<w:pStyle w:val=" + chr(34) + "Heading1" + chr(34) + "/>")}{p("Body text")}{p("item", "<w:numPr><w:ilvl w:val=" + chr(34) + "1" + chr(34) + "/></w:numPr>")}{table}</w:body></w:document>'})


def pptx():
    sp = lambda t, y, ph="": f'<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="0" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    return packed({f"ppt/slides/slide{k}.xml": f"<p:sld {A}>{x}</p:sld>" for k, x in ((10, sp("Last", 1)), (2, sp("low", 9) + sp("high", 1) + sp("Title", 50, '<p:ph type="title"/>')))})


def xlsx():
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cells = '<row><c r="B2" t="s"><v>0</v></c><c r="C2" t="inlineStr"><is><t>x</t></is></c></row><row><c r="B4"><v>3.0</v></c><c r="C4" s="1"><v>45000</v></c></row><row><c r="B5" t="b"><v>1</v></c><c r="C5"><f>A1+1</f><v>2</v></c></row>'
    return packed({
        "xl/workbook.xml": f'<workbook {S} {rel}><sheets><sheet name="One" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {S}><si><t>head</t></si></sst>", "xl/styles.xml": f'<styleSheet {S}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>', "xl/worksheets/sheet1.xml": f"<worksheet {S}><sheetData>{cells}</sheetData></worksheet>",
    })


def test_office_parsers():
    d = office.docx(docx(), "x/a.docx")
    assert d.title == "Head" and d.text.startswith("Head\n\nBody text\n\n  - item\n\n| h | i |") and "a\\|b" in d.text and d.tables[0]["rows"] == [["1", "a|b"]]
    p = office.pptx(pptx(), "a.pptx")
    assert [b["text"] for b in p.blocks] == ["Title", "high", "low", "Last"] and [b["page"] for b in p.blocks] == [0, 0, 0, 1] and p.title == "Title"
    x = office.xlsx(xlsx(), "a.xlsx")
    assert x.tables == [{"name": "One", "headers": ["", "head", "x"], "rows": [["", "", ""], ["", "3", "2023-03-15"], ["", "true", "=A1+1"]]}]


def test_pictures_order_and_unread_content(spark):
    ns = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rels = lambda **k: "<Relationships>" + "".join(f'<Relationship Id="{i}" Target="{t}"/>' for i, t in k.items()) + "</Relationships>"
    pic = lambda name, descr, rid: f'<p:pic><p:nvPicPr><p:cNvPr id="1" name="{name}" descr="{descr}"/></p:nvPicPr><p:blipFill><a:blip r:embed="{rid}"/></p:blipFill></p:pic>'
    slide = lambda body: f"<p:sld {ns}><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:sld>"
    text = lambda t: f"<p:sp><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>"
    deck = packed({
        "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId id="1" r:id="b"/><p:sldId id="2" r:id="a"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": rels(a="slides/slide1.xml", b="slides/slide2.xml"),
        "ppt/slides/slide1.xml": slide(text("second") + pic("Picture 3", "", "x") + "<p:graphicFrame><a:graphic/></p:graphicFrame>"), "ppt/slides/_rels/slide1.xml.rels": rels(x="../media/one.png"),
        "ppt/slides/slide2.xml": slide(text("first") + pic("Picture 1", "A chart", "y")), "ppt/slides/_rels/slide2.xml.rels": rels(y="/ppt/media/two.png"), "ppt/media/one.png": "1", "ppt/media/two.png": "22",
    })
    p = office.pptx(deck, "a.pptx")
    assert [(b["text"], b["page"]) for b in p.blocks] == [("first", 0), ("A chart", 0), ("second", 1)] and p.unsupported == {"graphicFrame": 1}
    assert [(x["name"], x["alt"], x["page"], x["content"]) for x in p.pictures] == [("two.png", "A chart", 0, b"22"), ("one.png", None, 1, b"1")]
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" ' + ns
    body = '<w:p><w:r><w:drawing><wp:docPr xmlns:wp="u" name="Image 1" descr="A seal"/><a:blip r:embed="i"/></w:drawing></w:r></w:p><w:p><w:r><w:drawing/><w:object/></w:r></w:p><w:sdt/><w:sectPr/>'
    doc = packed({"word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": rels(i="media/seal.png"), "word/media/seal.png": "s"})
    d = office.docx(doc, "b.docx")
    assert [b["text"] for b in d.blocks] == ["A seal"] and d.pictures[0]["content"] == b"s" and d.unsupported == {"drawing": 1, "object": 1, "sdt": 1}
    rows = spark.createDataFrame([("1", "a.pptx", bytearray(deck)), ("2", "b.docx", bytearray(doc))], "object_id string, uri string, content binary")
    got = office.parse_files(rows, pictures=True)
    assert {r["object_id"]: len(r["pictures"]) for r in got.collect()} == {"1": 2, "2": 1} and office.parse_files(rows).filter(F.size("pictures") > 0).count() == 0
    assert {r["kind"]: (r["n"], r["files"]) for r in office.unsupported_counts(got).collect()} == {"graphicFrame": (1, 1), "drawing": (1, 1), "object": (1, 1), "sdt": (1, 1)}


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in" / "Sub").mkdir(parents=True)
    put = lambda n, b: (tmp_path / "in" / n).write_bytes(b)
    put("b.md", b"\xef\xbb\xbf# Head line\n\nSome text. More text.")
    put("A.TXT", b"bad \xff byte")
    put("_x.txt", b"underscore")
    put(".secret.txt", b"hidden")
    put("empty.txt", b"")
    put("broken.json", b"{")
    put("Sub/c.docx", docx())
    put("scan.tif", b"II")
    put("odd.xyz", b"?")
    return str(tmp_path / "in")


def test_local_files(spark, folder):
    names = lambda **kw: [r["relative"] for r in files.local_files(spark, InputConfig(folder, **kw)).collect()]
    assert names() == ["_x.txt", "A.TXT", "b.md", "broken.json", "empty.txt", "odd.xyz", "scan.tif", "Sub/c.docx"]
    assert names(include_hidden=True)[0] == ".secret.txt" and names(extensions=("TXT",), max_files=2) == ["_x.txt", "A.TXT"]
    assert "Sub/c.docx" not in names(recursive=False)
    big = files.local_files(spark, InputConfig(folder, max_bytes=3)).filter("content is null").count()
    assert big > 0


def test_pipeline_end_to_end(spark, folder, tmp_path):
    objects = files.data_objects(files.local_files(spark, InputConfig(folder)))
    out = pipeline.run(objects, ChunkEmbedConfig(embedder_params={"dimension": 8}))
    names = {r["object_id"]: r["uri"] for r in objects.collect()}
    assert {names[r["object_id"]] for r in out.accepted.collect()} == {"_x.txt", "A.TXT", "b.md", "Sub/c.docx"}
    why = {names[r["document_id"]]: r["reasons"][0]["code"] for r in out.quarantined.collect()}
    assert why == {"broken.json": "parse_failed", "scan.tif": "parse_deferred", "odd.xyz": "parse_unsupported", "empty.txt": "empty_parsed_content"}
    assert out.chunks.filter(F.col("content").contains("�")).count() == 1
    assert out.report.first()["status"] == "passed"
    pipeline.write(out, objects, str(tmp_path / "runs" / "r1"))
    got = artifacts.read_stage(spark, str(tmp_path / "runs" / "r1"), "output")
    done = {r["document_id"]: r for r in got.collect()}
    assert {names[i] for i in done} == {"_x.txt", "A.TXT", "b.md", "Sub/c.docx"}  # the quarantined end in the ingested stage
    md = next(r for i, r in done.items() if names[i] == "b.md")
    assert md["document"]["title"] == "Head line" and len(md["retrieval"]["items"][0]["embeddings"][0]["values"]) == 8
    assert md["ingest"]["source"]["uri"] == "b.md" and md["ingest"]["data"]["text"] and md["clean"]["data"]["pass_through"] and md["enrich"]["data"]["pass_through"] and md["retrieval"]["lexical_stats"]["N"] > 0
    first = {names[r["document_id"]]: r for r in artifacts.read_stage(spark, str(tmp_path / "runs" / "r1"), "ingested").collect()}
    assert len(first) == 8 and first["b.md"]["schema_id"] and first["b.md"]["failure"] is None and first["empty.txt"]["failure"]["disposition"] == "quarantined" and first["empty.txt"]["parsed"] is not None and first["odd.xyz"]["source"]["uri"] == "odd.xyz"
    assert artifacts.read_stage(spark, str(tmp_path / "runs" / "r1"), "cleaned").filter("data.pass_through and schema_id is not null").count() == 4
    assert artifacts.read_stage(spark, str(tmp_path / "runs" / "r1"), "embedded").filter("size(retrieval.items) > 0").count() == 4
    m = spark.read.json(str(tmp_path / "runs" / "r1" / "manifests" / "ingested")).first()
    assert m["progress"]["status"] == "completed" and m["progress"]["quarantined_document_count"] == 4
    runs = files.runs(spark, str(tmp_path / "runs")).collect()
    assert [(r["run_id"], r["stages"]) for r in runs] == [("r1", ["ingested", "output"])]


def test_configured_run(spark, folder, tmp_path):
    for name, text in (("c.json", json.dumps({"input": {"path": folder, "extensions": ["md"], "odd": 1}, "chunk_embed": {"chunker": "paragraph", "embedder_params": {"dimension": 4}}})), ("c.yaml", f"input:\n  path: {folder}\n  extensions: [md, TXT]\nchunk_embed:\n  embedder_params: {{dimension: 6}}\n")):
        (tmp_path / name).write_text(text)
    run = f"{tmp_path}/runs/" + pipeline.cli(["--config", str(tmp_path / "c.json"), "--out", str(tmp_path / "runs")])
    got = artifacts.read_stage(spark, run, "output").collect()
    assert [r["document"]["file_name"] for r in got] == ["b.md"] and len(got[0]["retrieval"]["items"][0]["embeddings"][0]["values"]) == 4
    run = f"{tmp_path}/runs/" + pipeline.cli(["--config", str(tmp_path / "c.yaml"), "--dimension", "3", "--out", str(tmp_path / "runs")])
    got = artifacts.read_stage(spark, run, "output").collect()
    assert {r["document"]["file_name"] for r in got} == {"b.md", "A.TXT", "_x.txt"} and {len(r["retrieval"]["items"][0]["embeddings"][0]["values"]) for r in got} == {3}
    with pytest.raises(ValueError):
        pipeline.cli(["--out", str(tmp_path / "runs")])
    with pytest.raises(ValueError):
        pipeline.cli(["--local", folder, "--s3-uri", "s3://b/k", "--out", str(tmp_path / "runs")])


def test_inventory_run_keeps_lost_entries(spark, tmp_path):
    (tmp_path / "a.txt").write_text("One sentence. Another one.")
    url = f"file://{tmp_path}/a.txt"
    entries = [("good.txt", url, None), ("size.txt", url, 4), ("none.txt", f"file://{tmp_path}/none", None), ("large.txt", url, 1 << 40)]
    path = tmp_path / "inv.json"
    path.write_text(json.dumps({"bucket": "b", "files": [{"key": k, "presigned_url": u, "size": n} for k, u, n in entries]}))
    run = f"{tmp_path}/runs/" + pipeline.cli(["--inventory", str(path), "--out", str(tmp_path / "runs"), "--dimension", "8"])
    got = {r["source"]["uri"]: r for r in artifacts.read_stage(spark, run, "ingested").collect()}
    assert {k: r["status"] for k, r in got.items()} == {"s3://b/good.txt": "succeeded", "s3://b/size.txt": "quarantined", "s3://b/none.txt": "quarantined", "s3://b/large.txt": "quarantined"}
    assert {k: r["failure"]["reasons"][0]["code"] for k, r in got.items() if r["failure"]} == {"s3://b/size.txt": "download_size_mismatch", "s3://b/none.txt": "download_failed", "s3://b/large.txt": "download_too_large"}
    assert "No such file" in got["s3://b/none.txt"]["failure"]["reasons"][0]["message"]
    m = spark.read.json(f"{run}/manifests/ingested").first()
    assert (m["document_count"], m["succeeded_count"], m["other_count"]) == (4, 1, 3)
    assert artifacts.read_stage(spark, run, "output").count() == 1  # lost entries end in the ingested stage


def test_inventory(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"12345")
    entry = lambda k, **kw: {"key": k, "presigned_url": f"file://{tmp_path}/a.bin", **kw}
    path = tmp_path / "inv.json"
    path.write_text(json.dumps({"bucket": "b", "files": [entry("x/"), entry("k1", size=5, etag='"e"'), entry("k2", size=4), {"key": "k3", "presigned_url": f"file://{tmp_path}/none", "size": None}]}))
    e = files.inventory(spark, str(path))
    assert [r["key"] for r in e.orderBy("ordinal").collect()] == ["k1", "k2", "k3"] and e.first()["etag"] == "e"
    assert {r["key"]: r["status"] for r in files.download(e).collect()} == {"k1": "loaded", "k2": "size_mismatch", "k3": "failed"}
    assert files.select_entry(e, "k2").count() == 1
    with pytest.raises(ValueError):
        files.select_entry(e)
    path.write_text(json.dumps({"bucket": "b", "files": [{"key": "k", "presigned_url": "ftp://x"}]}))
    with pytest.raises(Exception, match="valid url"):
        files.inventory(spark, str(path)).collect()


def test_json_rows_and_routes(spark):
    df = spark.createDataFrame([(1, "[1, {\"a\": 2}]"), (2, '{"b": 3}'), (3, "7"), (4, "{")], "i int, c string")
    rows = files.json_rows(df, "c").select("i", F.to_json("row").alias("r")).collect()
    assert sorted((r["i"], r["r"]) for r in rows) == [(1, '{"a":2}'), (1, '{"value":1}'), (2, '{"b":3}'), (3, '{"value":7}')]
    with pytest.raises(ValueError):
        ingest.route_table({"a": ["x"], "b": ["x"]})
    docs, sheets = ingest.split_spreadsheets(spark.createDataFrame([("XLSX",), ("pdf",), (None,)], "f string"), "f")
    assert docs.count() == 2 and sheets.count() == 1


def test_strip_fields(spark):
    v = {"a": {"reasoning": 1, "x_meta": 2, "text_citations": ["/page/2/T/0", " ", "/page/2/T/0"], "lineage": {}}, "contract_version": "v", "l": [{"citations": "c"}]}
    got = json.loads(spark.createDataFrame([(json.dumps(v),)], "v string").select(artifacts.strip_fields_py("v")).first()[0])
    assert got == {"a": {"source_refs": [{"component_id": "/page/2/T/0", "page": 2, "field": "text"}]}, "l": [{"source_refs": [{"component_id": "c"}]}]}


def test_pages_and_replay(spark):
    pages = spark.createDataFrame([("d", 1, "b", 2, None), ("d", 0, "a", 3, "x"), ("e", 0, None, None, None)], "object_id string, page int, text string, tokens int, error string")
    r = {x["object_id"]: (x["text"], x["page_count"], x["tokens"], x["failed_pages"]) for x in office.pages_to_documents(pages).collect()}
    assert r == {"d": ("a\n\nb", 2, 5, 1), "e": ("", 1, 0, 0)}
    objects = spark.createDataFrame([("1", "a/x.pdf", bytearray(b"")), ("2", "a/y.pdf", bytearray(b""))], "object_id string, uri string, content binary")
    got = {x["object_id"]: (x["status"], x["text"], x["error_type"]) for x in office.parse_files(objects, {"pdf": office.replayed({"x.pdf": {"text": "T"}})}).collect()}
    assert got == {"1": ("success", "T", None), "2": ("failed", None, "KeyError")}


def test_streaming_writes_each_document_once(spark, tmp_path):
    schema = "doc_id string, language string, main_text string, main_text_citations array<string>, tables array<struct<caption:string,caption_citations:array<string>,content:string,content_citations:array<string>>>, figures array<struct<caption:string,description:string>>, formulas array<string>"
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    put = lambda ids: spark.createDataFrame([(i, None, f"text of {i}", None, None, None, None) for i in ids], schema).coalesce(1).write.mode("append").parquet(src)
    config = ChunkEmbedConfig(chunker="paragraph")
    for ids in (["a", "b"], ["b", "c"]):
        put(ids)
        incremental.start(spark, src, schema, out, ck, config).awaitTermination()
    assert sorted(r["doc_id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
    incremental.process(spark.read.schema(schema).parquet(src), out, config)
    assert spark.read.parquet(out).count() == 3
    assert chunking.spans(spark.createDataFrame([], "id int, t string"), "t", "paragraph").count() == 0
