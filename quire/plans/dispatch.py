"""Requests over mixed files: documents go through the pipeline, workbooks to the spreadsheet service, answers come back in order."""

from __future__ import annotations

import io
import os
import re
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators import retrieval
from quire.plans.artifacts import strip_fields_py

IDENTIFIER = re.compile(r"[A-Za-z0-9._-]+")


def checked_identifier(name: str) -> str:
    if not IDENTIFIER.fullmatch(name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def is_identifier(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9._-]+$"), F.lit(False))


def in_request_order(request: DataFrame, documents: DataFrame, workbooks: DataFrame) -> DataFrame:
    """Documents of both ways in the order of the request (source_uri, ordinal); the k-th of equal addresses gets the k-th answer."""
    both = documents.unionByName(workbooks, allowMissingColumns=True)
    return retrieval.restore_order(request, both, "source_uri", "ordinal", "document_id").orderBy("ordinal")


def run_metadata(documents: DataFrame) -> DataFrame:
    """One row over the documents of a run (kind, job_id, modules): counts, job ids, modules each once in order of first use."""
    return documents.agg(
        F.count("*").alias("document_count"), F.count_if(F.col("kind") == "workbook").alias("workbook_count"), F.count_if(F.col("kind") != "workbook").alias("pipeline_count"),
        F.array_compact(F.sort_array(F.collect_set("job_id"))).alias("job_ids"), F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_set(F.struct("kind", "modules"))), lambda x: x["modules"]))).alias("completed_modules"),
    )


def run_summary(quality: DataFrame, report: DataFrame, counts: DataFrame) -> DataFrame:
    """The reports of a run as one row: quality(), embedding_report() and counts_by_type()."""
    c = counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("retrieval_type", "n")))).alias("counts_by_type"))  # a row a type
    parts = [d.withColumn("_k", F.lit(1)) for d in (quality, report, c)]
    return parts[0].join(parts[1], "_k").join(parts[2], "_k").drop("_k").withColumns({"schema_match_count": F.lit(0), "entity_match_count": F.lit(0), "relationship_count": F.lit(0)})


def public_response(documents: DataFrame) -> DataFrame:
    """Documents as JSON without contract versions, lineage and audit fields."""
    return documents.select(strip_fields_py(F.to_json(F.struct(*documents.columns))).alias("document"))


def prefer_output(output: DataFrame, ingested: DataFrame) -> DataFrame:
    """What there is of each document: its output, else what ingestion wrote."""
    a, b = output.select("document_id", F.col("document").alias("o")), ingested.select("document_id", F.col("document").alias("i"))
    return a.join(b, "document_id", "full").select("document_id", F.coalesce("o", "i").alias("document"), F.when(F.col("o").isNotNull(), "output").otherwise("ingested").alias("stage"))


def ordered_blocks(orders: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks in the order of a document's reading_order; names without a block are left out, of equal blocks the last counts."""
    one = blocks.groupBy("object_id", "component_id").agg(F.max_by(F.struct(*[c for c in blocks.columns if c not in ("object_id", "component_id")]), "arrival").alias("b"))
    names = orders.select("object_id", F.posexplode("reading_order").alias("position", "component_id"))
    return names.join(one, ["object_id", "component_id"]).select("object_id", "position", "component_id", "b.*")


def shown_boxes(blocks: DataFrame, box: Column) -> DataFrame:
    """Blocks with a valid box on the first page or without a page."""
    return blocks.filter(box.isNotNull() & (F.col("page").isNull() | (F.col("page") == 0)))


def run_zip(folder: str) -> bytes:
    """The JSON artifacts of one run as a ZIP file, for download."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in sorted(os.walk(folder)):
            for n in sorted(names):
                if n.startswith("part-") or n.endswith(".json"):
                    path = os.path.join(at, n)
                    z.write(path, os.path.relpath(path, folder))
    return out.getvalue()
