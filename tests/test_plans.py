import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F
from quire.config import ChunkEmbedConfig
from quire.plans import chunk_embed, dispatch
from quire.sources import service


def test_workbook_service_rows(spark):
    objects = spark.createDataFrame([("1", "b/ok.xlsx", bytearray(b"1")), ("2", "b/bad.xlsx", bytearray(b"2")), ("3", "b/down.xlsx", None), ("4", "b/list.xlsx", None)], "object_id string, uri string, content binary")

    def ask(content, name):
        if name == "bad.xlsx":
            raise service.ServiceError(422, "no")
        if name == "down.xlsx":
            raise TimeoutError("slow")
        return [] if name == "list.xlsx" else {"structures": [], "n": content.decode()}

    got = {r["response_id"]: r for r in service.workbook_responses(objects, ask).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"1": "ok", "2": "invalid_request", "3": "service_failure", "4": "service_failure"}
    assert json.loads(got["1"]["body"])["n"] == "1" and got["3"]["error"] == "TimeoutError: slow"


def test_completions_are_asked_once(spark):
    import hashlib

    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "fails"), (5, None)], "k int, p string")
    cache = spark.createDataFrame([(hashlib.sha1(b"m:b").hexdigest(), "cached")], "prompt_hash string, completion string")

    def ask(p):
        if p == "fails":
            raise OSError
        assert p == "a"
        return "A"

    assert {r["k"]: r["completion"] for r in service.completions(df, "p", ask, "m", cache).collect()} == {1: "A", 2: "A", 3: "cached", 4: "", 5: ""}


def test_dispatch(spark):
    request = spark.createDataFrame([("u", 2), ("w", 1), ("u", 0)], "source_uri string, ordinal int")
    docs = spark.createDataFrame([("u", "d1", "doc", None, ["a", "b"]), ("u", "d2", "doc", None, ["a", "b"])], "source_uri string, document_id string, kind string, job_id string, modules array<string>")
    books = spark.createDataFrame([("w", "x", "workbook", "j1", ["b", "c"])], "source_uri string, document_id string, kind string, job_id string, modules array<string>")
    got = dispatch.in_request_order(request, docs, books)
    assert [r["document_id"] for r in got.collect()] == ["d1", "x", "d2"]
    m = dispatch.run_metadata(docs.unionByName(books)).first()
    assert (m["document_count"], m["workbook_count"], m["job_ids"], m["completed_modules"]) == (3, 1, ["j1"], ["a", "b", "c"])
    assert dispatch.checked_identifier("run-1") == "run-1"
    with pytest.raises(ValueError):
        dispatch.checked_identifier("a/b")
    a = spark.createDataFrame([("1", "o"), ("2", None)], "document_id string, document string")
    b = spark.createDataFrame([("2", "i"), ("3", "j")], "document_id string, document string")
    assert {r["document_id"]: (r["document"], r["stage"]) for r in dispatch.prefer_output(a, b).collect()} == {"1": ("o", "output"), "2": ("i", "ingested"), "3": ("j", "ingested")}
    orders = spark.createDataFrame([("d", ["b", "none", "a"])], "object_id string, reading_order array<string>")
    blocks = spark.createDataFrame([("d", "a", 0, "A"), ("d", "b", 1, "old"), ("d", "b", 2, "new")], "object_id string, component_id string, arrival int, text string")
    assert [r["text"] for r in dispatch.ordered_blocks(orders, blocks).orderBy("position").collect()] == ["new", "A"]
    shown = spark.createDataFrame([(0, True), (None, True), (1, True), (0, None)], "page int, b boolean")
    assert dispatch.shown_boxes(shown, F.col("b")).count() == 2
    p = dispatch.public_response(spark.createDataFrame([("v", "x")], "contract_version string, name string")).first()[0]
    assert json.loads(p) == {"name": "x"}


def test_chunk_embed_skips_and_appends(spark, tmp_path):
    rows = [("a", None, "One. Two.", None, None, None), ("b", None, "Three.", None, None, None)]
    records = spark.createDataFrame(rows, chunk_embed.RECORDS)
    config = ChunkEmbedConfig(chunker="paragraph", embedder_params={"dimension": 4})
    out = str(tmp_path / "out")
    first = chunk_embed.run(records.limit(1), out, config)
    second = chunk_embed.run(records, out, config)
    assert (first["chunks"], second["chunks"], second["skipped_existing"]) == (1, 1, 1)
    forced = chunk_embed.run(records, out, config, force=True)
    assert forced["chunks"] == 2 and spark.read.parquet(f"{out}/chunk_records").count() == 4
    assert spark.read.parquet(f"{out}/vector_records").filter("embedding_dimension = 4").count() == 4
    other = chunk_embed.run(records, out, ChunkEmbedConfig(chunker="sentence_group", chunker_params={"n": 1}))
    assert other["chunks"] == 3 and other["retrieval_profile"]["rrf_k"] == 60


def test_zip_of_a_run(tmp_path):
    (tmp_path / "stages").mkdir()
    (tmp_path / "stages" / "part-0.json").write_text("{}")
    (tmp_path / "stages" / "_SUCCESS").write_text("")
    with zipfile.ZipFile(io.BytesIO(dispatch.run_zip(str(tmp_path)))) as z:
        assert z.namelist() == ["stages/part-0.json"]
