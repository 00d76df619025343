"""Stage artifacts: per-document JSON with run manifests, written by Spark's committers and read back by stage.

A run folder holds stages/{ingested,cleaned,enriched,embedded,output}/ (JSON lines, one document a line) and manifests/.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STAGES = ["ingested", "cleaned", "enriched", "embedded", "output"]
# Audit fields that consumers do not get.
AUDIT, INTERNAL = {"reasoning", "verification", "extraction_status"}, {"contract_version", "lineage", "schema", "schema_id"}


def strip_audit(value, refs_of=None):
    """A JSON value without audit fields; citations become source_refs, each component, page and field once."""
    if isinstance(value, list):
        return [strip_audit(v) for v in value]
    if not isinstance(value, dict):
        return value
    out, refs = {}, {}
    for k, v in value.items():
        if k == "source_refs":
            for r in v if isinstance(v, list) else [v]:
                if isinstance(r, dict) and r.get("component_id"):
                    r = {"component_id": str(r["component_id"]), "page": r.get("page"), "field": r.get("field")}
                    refs.setdefault(tuple(r.values()), r)
        elif k == "citations" or k.endswith("_citations"):
            field = k.removesuffix("_citations") if k != "citations" else None
            for c in v if isinstance(v, list) else [v]:
                if isinstance(c, str) and c.strip():
                    parts = c.strip().split("/")
                    page = int(parts[2]) if len(parts) > 2 and parts[:2] == ["", "page"] and parts[2].isdigit() else None
                    r = {"component_id": c.strip(), "page": page, "field": field}
                    refs.setdefault(tuple(r.values()), r)
        elif k not in AUDIT and not k.endswith("_meta"):
            out[k] = strip_audit(v)
    if refs:
        out["source_refs"] = [{k: v for k, v in r.items() if v is not None} for r in refs.values()]
    return out


def strip_internal(value):
    """A JSON value without contract versions, lineage and schemas, at any depth."""
    if isinstance(value, list):
        return [strip_internal(v) for v in value]
    if isinstance(value, dict):
        return {k: strip_internal(v) for k, v in value.items() if k not in INTERNAL}
    return value


@F.pandas_udf(T.StringType())
def strip_fields_py(s: pd.Series) -> pd.Series:
    """JSON texts without audit and internal fields, keys sorted; null if they are no JSON."""

    def one(v):
        try:
            return json.dumps(strip_internal(strip_audit(json.loads(v))), sort_keys=True, ensure_ascii=False)
        except (TypeError, ValueError, RecursionError):
            return None

    return s.map(one)


def to_json(df: DataFrame, keep_nulls: bool = False) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false" if keep_nulls else "true"}).alias("value"))


def write_stage(df: DataFrame, run: str, stage: str, keep_nulls: bool = False) -> str:
    """Documents of a stage as JSON lines; the committer makes the write atomic."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}")
    path = f"{run}/stages/{stage}"
    to_json(df, keep_nulls).write.mode("overwrite").text(path)
    return path


def append_records(df: DataFrame, path: str) -> None:
    """Records beside those already there."""
    df.write.mode("append").parquet(path)


def write_manifest(summary: DataFrame, run: str, stage: str) -> None:
    """A manifest of few rows."""
    summary.withColumn("written_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").json(f"{run}/manifests/{stage}")


def read_stage(spark: SparkSession, run: str, stage: str, schema: T.StructType | str | None = None) -> DataFrame:
    r = spark.read.schema(schema) if schema else spark.read
    return r.json(f"{run}/stages/{stage}")


CONTRACTS = {"ingested": "ingested-document-v2", "cleaned": "cleaned-document-v1", "enriched": "enriched-document-v1", "embedded": "embedded-document-v3"}  # fixed values


def _record(df: DataFrame, id: str, name: str) -> DataFrame:
    """document_id and everything of a row as one struct."""
    return df.select(F.col(id).alias("document_id"), F.struct(*df.columns).alias(name))


def ingested(objects: DataFrame, parsed: DataFrame, schemas: DataFrame, quarantined: DataFrame) -> DataFrame:
    """Documents of the first stage, succeeded and quarantined: source, parsed data, schema id, and the failure of the quarantined.

    objects and parsed: by object_id; schemas: source_object_id, schema_id; quarantined: document_id, stage, reasons. A document that is
    quarantined keeps its source and what was parsed of it, and has no schema.
    """
    failure = F.struct(F.col("stage"), F.lit("quarantined").alias("disposition"), "reasons")
    bad = quarantined.select("document_id", failure.alias("failure"))
    known = schemas.select(F.col("source_object_id").alias("document_id"), "schema_id")
    named = objects.select(F.col("object_id").alias("document_id")).unionByName(bad.select("document_id")).distinct()
    j = named.join(_record(objects, "object_id", "source"), "document_id", "left").join(_record(parsed, "object_id", "parsed"), "document_id", "left").join(known, "document_id", "left").join(bad, "document_id", "left")
    lost = F.col("failure").isNotNull()
    return j.select(
        F.lit(CONTRACTS["ingested"]).alias("contract_version"), F.lit("ingested").alias("stage"), F.when(lost, "quarantined").otherwise("succeeded").alias("status"), "document_id", "source", "parsed",
        F.when(~lost, F.col("schema_id")).alias("schema_id"), "failure",
    )


def passed_on(objects: DataFrame, data: DataFrame, schemas: DataFrame, stage: str) -> DataFrame:
    """Documents of the cleaned or enriched stage: a row per object, with its data and schema id, or nulls."""
    known = schemas.select(F.col("source_object_id").alias("document_id"), "schema_id")
    j = objects.select(F.col("object_id").alias("document_id")).join(_record(data, "source_object_id", "data"), "document_id", "left").join(known, "document_id", "left")
    return j.select(F.lit(CONTRACTS[stage]).alias("contract_version"), F.lit(stage).alias("stage"), "document_id", "data", "schema_id")


def retrieval_of(items: DataFrame) -> DataFrame:
    """document_id and retrieval: the items in order, and the term statistics of the document over them. items: with_vectors(items(..))."""
    entry = F.struct("retrieval_type", "position_index", "start", F.col("record_id").alias("item_id"), "content", "caption", "lexical.dl", "embeddings")
    counted = F.col("lexical").isNotNull()
    stats = F.struct(F.count_if(counted).alias("N"), F.coalesce(F.round(F.sum("lexical.dl") / F.count_if(counted), 6), F.lit(0.0)).alias("avgdl"))
    return items.groupBy(F.col("source_object_id").alias("document_id")).agg(F.struct(F.sort_array(F.collect_list(entry)).alias("items"), stats.alias("lexical_stats")).alias("retrieval"))


def embedded(objects: DataFrame, items: DataFrame) -> DataFrame:
    """Documents of the embedded stage: every object with its retrieval section, empty if nothing came of it."""
    j = objects.select(F.col("object_id").alias("document_id")).join(retrieval_of(items), "document_id", "left")
    return j.select(F.lit(CONTRACTS["embedded"]).alias("contract_version"), F.lit("embedded").alias("stage"), "document_id", "retrieval")


def output(identity: DataFrame, objects: DataFrame, parsed: DataFrame, cleaned: DataFrame, enriched: DataFrame, items: DataFrame) -> DataFrame:
    """Final documents in five sections: document (its identity), ingest (source and parsed data), clean, enrich and retrieval.

    Six tables meet by document, all on the one key, so each is shuffled once; a section that has nothing is null.
    """
    j = _record(objects, "object_id", "source")
    for df, id, name in ((identity, "document_id", "document"), (parsed, "object_id", "parsed"), (cleaned, "source_object_id", "cleaned"), (enriched, "source_object_id", "enriched")):
        j = j.join(_record(df, id, name), "document_id", "left")
    j = j.join(retrieval_of(items), "document_id", "left")

    return j.select("document_id", "document", F.struct("source", F.col("parsed").alias("data")).alias("ingest"), F.when(F.col("cleaned").isNotNull(), F.struct(F.col("cleaned").alias("data"))).alias("clean"), F.when(F.col("enriched").isNotNull(), F.struct(F.col("enriched").alias("data"))).alias("enrich"), "retrieval")


def progress(ingested_docs: DataFrame, expected: int | None = None) -> DataFrame:
    """Progress of the first stage, one row: running until as many documents are there as are expected."""
    n = ingested_docs.agg(F.count("*").alias("processed_document_count"), F.count_if(F.col("status") == "succeeded").alias("succeeded_document_count"), F.count_if(F.col("status") == "quarantined").alias("quarantined_document_count"))
    want = F.col("processed_document_count") if expected is None else F.lit(expected).cast("long")
    return n.select(F.when(F.col("processed_document_count") >= want, "completed").otherwise("running").alias("status"), "processed_document_count", want.alias("expected_document_count"), "succeeded_document_count", "quarantined_document_count")


def list_documents(output_docs: DataFrame, ingested_docs: DataFrame) -> DataFrame:
    """Documents of either stage; what ingestion says wins where it says something. Ordered by folded name."""
    a = output_docs.select("document_id", F.col("file_name").alias("o_name"), F.lit(True).alias("has_output"))
    b = ingested_docs.select("document_id", F.col("file_name").alias("i_name"), "status")
    j = a.join(b, "document_id", "full")
    return j.select("document_id", F.coalesce("i_name", "o_name").alias("file_name"), "status", F.coalesce("has_output", F.lit(False)).alias("has_output")).orderBy(F.lower("file_name"), "document_id")
