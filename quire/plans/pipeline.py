"""The document pipeline, end to end: ingestion, cleaning, enrichment, chunking and embedding, integration, artifacts.

Cleaning, enrichment and integration pass their data through. Every step is a plan over DataFrames; actions happen at the writes.
"""

from __future__ import annotations

import argparse
import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.config import ChunkEmbedConfig, input_config, input_mode, load
from quire.functions import ids
from quire.operators import chunking, documents, embedding, retrieval  # noqa: F401 (embedding registers the embedders)
from quire.plans import artifacts
from quire.registry import create_embedder
from quire.session import cut
from quire.sources import files, office

EXTRACTION = "struct<document_type:string,language:string,title:string,main_text:string,main_text_citations:array<string>,tables:array<struct<caption:string,caption_citations:array<string>,content:string,content_citations:array<string>,content_format:string>>,figures:array<struct<caption:string,description:string,source_ref:string>>,formulas:array<string>>"


@dataclass
class Output:
    parsed: DataFrame
    accepted: DataFrame
    quarantined: DataFrame
    chunks: DataFrame
    items: DataFrame
    vectors: DataFrame
    report: DataFrame


def parsed_documents(objects: DataFrame, providers: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Parsed documents in the canonical form, and the failures with their quarantine reason."""
    outcomes = cut(office.parse_files(objects, providers))
    ok = outcomes.filter("status = 'success'")
    none = F.array()
    table = F.transform("tables", lambda t: F.struct(t["name"].alias("caption"), none.cast("array<string>").alias("caption_citations"), F.concat_ws("\n", F.array_join(t["headers"], " | "), F.array_join(F.transform(t["rows"], lambda r: F.array_join(r, " | ")), "\n")).alias("content"), none.cast("array<string>").alias("content_citations"), F.lit(None).cast("string").alias("content_format")))
    cites = F.transform("blocks", lambda b: b["component_id"])
    extraction = F.struct(F.lit("text").alias("document_type"), F.lit(None).cast("string").alias("language"), F.col("title"), F.col("text").alias("main_text"), cites.alias("main_text_citations"), table.alias("tables"), none.alias("figures"), none.alias("formulas")).cast(EXTRACTION)
    row = F.struct(extraction.alias("extraction"), F.transform("blocks", lambda b: F.struct(b["component_id"].alias("component_id"), b["page"].alias("page"), b["block_index"].alias("block_index"), b["type"].alias("type"), b["text"].alias("text"), F.lit(None).cast("array<double>").alias("bbox"))).alias("source_blocks"), cites.alias("reading_order"))
    docs = ok.select("object_id", "source_uri", F.lit("").alias("source_format"), "text", F.array(row).alias("rows"), F.struct(F.lit("local").alias("parser"), F.lit("native").alias("backend"), F.lit("success").alias("status"), F.lit(None).cast("int").alias("page_count")).alias("metadata"))
    bad = outcomes.filter("status <> 'success'").select("object_id", "source_uri", F.array(documents.parse_failure(F.col("status"), F.col("error_message"), F.lit(None).cast("string"))).alias("reasons"))
    return docs, bad


def downloaded(got: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Downloaded entries as objects: those that were loaded, the others (without content), and the quarantine rows of the others."""
    named = got.withColumns({"relative": F.concat(F.lit("s3://"), "bucket", F.lit("/"), "key"), "length": F.length("content").cast("long")})
    ok, lost = named.filter("status = 'loaded'"), named.filter("status <> 'loaded'")
    message = F.coalesce("error", F.concat(F.lit("The download ended as "), "status", F.lit(".")))
    reason = F.struct(F.concat(F.lit("download_"), "status").alias("code"), F.lit("content").alias("field"), message.alias("message"))
    bad = lost.select(ids.document_id(F.col("relative")).alias("document_id"), F.col("relative").alias("source_uri"), F.array(reason).alias("reasons"), F.lit("ingestion").alias("stage"), F.lit("quarantined").alias("status"))
    return files.data_objects(ok, "presigned"), files.data_objects(lost, "presigned"), bad


def run(objects: DataFrame, config: ChunkEmbedConfig, providers: dict | None = None, lost: DataFrame | None = None) -> Output:
    """lost: quarantine rows of objects that could not be read."""
    docs, bad = parsed_documents(objects, providers)
    checked = documents.validated(docs)
    ok = documents.accepted(checked)
    out = documents.quarantined(checked).unionByName(bad.select(F.col("object_id").alias("document_id"), "source_uri", "reasons", F.lit("ingestion").alias("stage"), F.lit("quarantined").alias("status")))
    out = out.unionByName(lost) if lost is not None else out
    first = F.element_at(F.col("rows"), 1)["extraction"]
    fields = ok.filter(first.isNotNull()).select(F.col("object_id").alias("doc_id"), *[first[c].alias(c) for c in ("language", "main_text", "main_text_citations", "tables", "figures", "formulas")])
    chunks = cut(chunking.document_chunks(fields, config))
    embedder = create_embedder(config.embedder, config.embedder_params)
    items, vecs = retrieval.items(chunks), retrieval.vectors(chunks, embedder)
    errors = retrieval.without_records(ok.select(F.col("object_id").alias("source_object_id")), items, retrieval.failures(ok))
    return Output(checked, ok, out, chunks, items, vecs, retrieval.embedding_report(items, vecs, errors, embedder.model, embedder.dimension))


def write(out: Output, objects: DataFrame, folder: str) -> None:
    source = objects.drop("content")
    ingested = artifacts.ingested(source, out.parsed.drop("reasons"), documents.initial_schema(out.accepted).select("source_object_id", "schema_id"), out.quarantined)
    artifacts.write_stage(ingested, folder, "ingested", keep_nulls=True)
    one = F.lit(1).alias("one")  # a row with a row
    counted, done = retrieval.manifest(ingested, "ingested", "document_id", "status"), artifacts.progress(ingested)
    artifacts.write_manifest(counted.select("*", one).join(done.select(F.struct("*").alias("progress"), one), "one").drop("one"), folder, "ingested")
    kept = source.join(out.accepted.select("object_id"), "object_id", "left_semi")
    view = documents.view(out.accepted)
    passed = {}
    for stage in ("cleaned", "enriched"):
        schemas = documents.next_schema(view.select("source_object_id"), stage)
        passed[stage] = documents.pass_through(view, schemas)
        artifacts.write_stage(artifacts.passed_on(kept, passed[stage], schemas, stage), folder, stage)
    nested = retrieval.with_vectors(out.items, out.vectors)
    artifacts.write_stage(artifacts.embedded(kept, nested), folder, "embedded")
    m = kept.withColumn("metadata", F.col("metadata").withField("s3_bucket", F.lit(None).cast("string")).withField("s3_key", F.lit(None).cast("string")).withField("s3_etag", F.lit(None).cast("string")))
    identity = retrieval.document_identity(m, view)
    artifacts.write_stage(artifacts.output(identity, kept, out.accepted.drop("reasons"), passed["cleaned"], passed["enriched"], nested), folder, "output")
    artifacts.write_manifest(out.report.select(F.lit("output").alias("stage"), F.col("eligible_count").alias("document_count"), "status"), folder, "output")


def cli(argv: list[str] | None = None) -> str:
    p = argparse.ArgumentParser(description="Run the document pipeline over local files or an inventory.")
    p.add_argument("--local", help="file or folder")
    p.add_argument("--inventory", help="inventory file of presigned urls")
    p.add_argument("--object-key", help="only this entry of the inventory")
    p.add_argument("--s3-uri", help="address of one object, read by the cluster's own file system client")
    p.add_argument("--config", help="JSON or YAML file; what is given on the command line goes before it")
    p.add_argument("--out", required=True)
    p.add_argument("--chunker")
    p.add_argument("--dimension", type=int)
    a = p.parse_args(argv)
    settings = load(a.config)
    given = settings.get("input") or {}
    mode = input_mode({"local": a.local, "s3_object": a.s3_uri, "inventory": a.inventory}, given.get("mode", "local"))
    a.local, a.inventory, a.s3_uri, a.object_key = a.local or given.get("path"), a.inventory or given.get("inventory"), a.s3_uri or given.get("s3_uri"), a.object_key or given.get("object_key")
    if not {"local": a.local, "inventory": a.inventory, "s3_object": a.s3_uri}[mode]:
        raise ValueError(f"input mode {mode} names no input")
    spark = SparkSession.builder.appName("quire").getOrCreate()
    if mode == "local":
        objects, bad = files.data_objects(files.local_files(spark, input_config(given, a.local))), None
        every = objects
    elif mode == "s3_object":
        objects, bad = files.s3_object(spark, a.s3_uri), None
        every = objects
    else:
        entries = files.inventory(spark, a.inventory)
        got = cut(files.download(files.select_entry(entries, a.object_key) if a.object_key else entries))  # one request an entry
        objects, lost, bad = downloaded(got)
        every = objects.unionByName(lost)
    config = ChunkEmbedConfig.of(settings.get("chunk_embed"))
    config = replace(config, chunker=a.chunker or config.chunker, embedder_params={**config.embedder_params, **({"dimension": a.dimension} if a.dimension else {})})
    run_id = f"run-{ids.config_hash({'t': time.time_ns()})[:12]}"
    write(run(cut(objects), config, lost=bad), every, f"{a.out}/{run_id}")
    return run_id


if __name__ == "__main__":
    print(cli())
