"""Parsed documents: one merged view per document, validation, quarantine and schema inference.

Parsed documents have object_id, source_uri, source_format, text, rows (array of structs with extraction, source_blocks,
reading_order), metadata. Redelivered rows are removed by latest().
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import ids
from quire.functions import text as X

SCHEMA_VERSION = "initial-document-schema-v1"  # fixed value


def latest(df: DataFrame, id: str, order: str | None = None) -> DataFrame:
    """One row per id: the one with the greatest order. Ranks are limited within each task before the shuffle, so repeated ids do not pile up."""
    w = W.partitionBy(id).orderBy(F.col(order).desc_nulls_last() if order else F.lit(0))
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def _first_of(rows: Column, field: str) -> Column:
    """First non-empty extraction field over the rows in order."""
    return F.try_element_at(F.filter(F.transform(rows, lambda r: r["extraction"][field]), lambda v: F.length(v) > 0), F.lit(1))


def _flat(rows: Column, field: str) -> Column:
    return F.flatten(F.transform(rows, lambda r: F.coalesce(r["extraction"][field], F.array())))


def view(parsed: DataFrame, *more: Column | str) -> DataFrame:
    """The merged view of each document: first non-empty type, language and title, texts joined by blank lines, components in order.

    more: columns of parsed to keep beside it.
    """
    r = F.col("rows")
    texts = F.filter(F.transform(r, lambda x: X.text_or_null(x["extraction"]["main_text"])), lambda t: t.isNotNull())
    return parsed.select(
        F.col("object_id").alias("source_object_id"), "source_uri", _first_of(r, "document_type").alias("document_type"), _first_of(r, "language").alias("language"), _first_of(r, "title").alias("title"),
        F.array_join(texts, "\n\n").alias("main_text"), _flat(r, "tables").alias("tables"), _flat(r, "figures").alias("figures"), _flat(r, "formulas").alias("formulas"), F.size(r).alias("row_count"), *more,
    )


def is_zero(c: Column) -> Column:
    """Zero as a number or as text; null and booleans are not."""
    return F.coalesce((X.strip(c.cast("string")) == "0") | (c.cast("string").try_cast("double") == 0), F.lit(False))


def _says(value: Column, kind: T.DataType) -> Column:
    """Whether a value says something: text that is not blank, a list that is not empty, anything else that is not null."""
    if isinstance(kind, T.StringType):
        return ~X.blank(value)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(value) > 0, F.lit(False))
    return value.isNotNull()


EXTRACTED = ("main_text", "text", "markdown", "content", "tables", "figures", "formulas")  # fixed values: the fields that are content


def has_content(text: Column, rows: Column, row_type: T.StructType) -> Column:
    """Any text, component or other field of a row; of an extraction only its content fields. row_type: what a row may hold."""

    def row(r: Column) -> Column:
        parts = []
        for f in row_type:
            if f.name != "extraction":
                parts.append(_says(r[f.name], f.dataType))
            elif isinstance(f.dataType, T.StructType):
                parts += [_says(r[f.name][x.name], x.dataType) for x in f.dataType if x.name in EXTRACTED]
        return reduce(or_, parts, F.lit(False))

    return ~X.blank(text) | F.coalesce(F.exists(rows, row), F.lit(False))


def reasons(page_count: Column, text: Column, rows: Column, hosted: Column, row_type: T.StructType, parser: str = "Hosted parser") -> Column:
    """All reasons why a parsed document is unusable: structs code, field, message. hosted: whether the hosted parser, named so, made it."""

    def reason(code: str, field: str, message: str) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), F.lit(message).alias("message"))

    none = ~F.coalesce(F.exists(rows, lambda r: r["extraction"].isNotNull()), F.lit(False))
    found = F.array(
        F.when(is_zero(page_count), reason("zero_page_count", "parsed.metadata.page_count", "Parser returned page_count=0.")),
        F.when(F.coalesce(hosted, F.lit(False)) & none, reason("null_extraction", "parsed.rows[].extraction", f"{parser} returned no extraction object.")),
        F.when(~has_content(text, rows, row_type), reason("empty_parsed_content", "parsed", "Parsed document has no text, structured row, or component.")),
    )
    return F.array_compact(found)


def validated(parsed: DataFrame, hosted: Column | None = None) -> DataFrame:
    """parsed with reasons; accepted() and quarantined() split it."""
    backend = hosted if hosted is not None else F.col("metadata.backend") == "hosted"
    return parsed.withColumn("reasons", reasons(F.col("metadata.page_count"), F.col("text"), F.col("rows"), backend, parsed.schema["rows"].dataType.elementType))


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.size("reasons") == 0)


def quarantined(df: DataFrame, stage: str = "ingestion") -> DataFrame:
    return df.filter(F.size("reasons") > 0).select(F.col("object_id").alias("document_id"), "source_uri", "reasons", F.lit(stage).alias("stage"), F.lit("quarantined").alias("status"))


def outcome(status: Column, has_payload: Column, error_type: Column, error_message: Column, reason: Column) -> Column:
    """A parse outcome in its normal form: success without a payload is failed with missing_parsed_data."""
    missing = (status == "success") & ~has_payload
    return F.struct(
        F.when(missing, "failed").when(status.isin("success", "deferred", "unsupported", "failed"), status).otherwise("failed").alias("status"),
        F.when(missing, "missing_parsed_data").otherwise(reason).alias("reason"),
        F.when(status == "failed", F.struct(error_type.alias("type"), error_message.alias("message"))).alias("error"),
    )


def parse_failure(status: Column, error_message: Column, reason: Column) -> Column:
    """The quarantine reason of an outcome that is no success: code and message (of the error, else the reason, else a default)."""
    code = F.concat(F.lit("parse_"), status)
    return F.when(status != "success", F.struct(code.alias("code"), F.lit("parsed").alias("field"), F.coalesce(X.text_or_null(error_message), X.text_or_null(reason), F.concat(F.lit("Parsing ended as "), status, F.lit("."))).alias("message")))


# The declared fields of the initial schema.
DOCUMENT_FIELDS = {"document.document_id": "string", "document.source_uri": "string", "document.source_format": "string", "document.document_type": "string|null", "document.language": "string|null", "document.title": "string|null", "document.main_text": "string"}
TABLE_FIELDS = {"table.document_id": "string", "table.table_id": "string", "table.table_index": "integer", "table.caption": "string", "table.content": "string"}
FIGURE_FIELDS = {"figure.document_id": "string", "figure.figure_id": "string", "figure.figure_index": "integer", "figure.caption": "string", "figure.description": "string"}
FORMULA_FIELDS = {"formula.document_id": "string", "formula.formula_id": "string", "formula.formula_index": "integer", "formula.text": "string"}


def header_fields(headers: Column) -> Column:
    """table.<header> for every header that is not blank, first occurrences in order. headers: array of arrays."""
    return F.array_distinct(F.transform(F.filter(F.transform(F.flatten(headers), X.strip), lambda h: F.length(h) > 0), lambda h: F.concat(F.lit("table."), h)))


def initial_schema(parsed: DataFrame, headers: Column | None = None) -> DataFrame:
    """Inferred schema of each document: id, component counts, observed fields, relationships and declared fields.

    Tables of a parser (given by their headers) count beside those of the extraction.
    """
    own = [(F.size(headers) if headers is not None else F.lit(0)).alias("own_tables"), (header_fields(headers) if headers is not None else F.array().cast("array<string>")).alias("own_fields")]
    keep = [F.col(c).alias(f"v_{c}") for c in ("document_type", "language", "title", "main_text", "tables", "figures", "formulas", "row_count")]
    j = view(parsed, F.col("object_id"), "text", *own).select("object_id", "text", "own_tables", "own_fields", *keep)
    texts = F.col("v_main_text")
    stripped = X.stripped_or_null(F.col("text"))
    main = F.when(stripped.isNotNull() & (F.length(texts) == 0), stripped).otherwise(texts)
    counts = {"tables": F.size("v_tables") + F.col("own_tables"), "figures": F.size("v_figures"), "formulas": F.size("v_formulas")}
    seen = [F.when(F.length(F.col(f"v_{c}")) > 0, F.lit(f"document.{c}")) for c in ("document_type", "language", "title")] + [F.when(F.length(main) > 0, F.lit("document.main_text"))] + [F.when(n > 0, F.lit(c)) for c, n in counts.items()]
    links = [F.when(n > 0, F.struct(F.lit("document").alias("source_entity"), F.lit(c[:-1]).alias("target_entity"), F.lit(f"has_{c[:-1]}").alias("relationship_type"))) for c, n in counts.items()]
    declared = {**DOCUMENT_FIELDS, **TABLE_FIELDS, **FIGURE_FIELDS, **FORMULA_FIELDS}
    fixed = F.create_map(*[F.lit(x) for kv in declared.items() for x in kv])
    extra = F.map_from_arrays(F.col("own_fields"), F.transform("own_fields", lambda _: F.lit("string")))
    return j.select(
        ids.short_id(F.col("object_id"), F.lit("initial-schema")).alias("schema_id"), F.col("object_id").alias("source_object_id"), F.col("v_row_count").alias("row_count"), *[n.alias(f"{c[:-1]}_count") for c, n in counts.items()],
        F.array_compact(F.array(*seen)).alias("observed_fields"), F.array_compact(F.array(*links)).alias("relationships"), F.map_concat(fixed, F.map_filter(extra, lambda k, _: ~F.array_contains(F.map_keys(fixed), k))).alias("fields"),
        F.lit(SCHEMA_VERSION).alias("contract_version"),
    )


def next_schema(df: DataFrame, kind: str) -> DataFrame:
    """Ids of the cleaned or enriched schema: these stages pass their data through."""
    return df.withColumn("schema_id", ids.short_id(F.col("source_object_id"), F.lit(f"{kind}-schema")))


def pass_through(data: DataFrame, schemas: DataFrame) -> DataFrame:
    """Data left-joined to its schema (one per document); without one the source schema id is ''."""
    one = schemas.select("source_object_id", F.col("schema_id").alias("source_schema_id")).dropDuplicates(["source_object_id"])
    return data.join(one, "source_object_id", "left").withColumns({"source_schema_id": F.coalesce("source_schema_id", F.lit("")), "pass_through": F.lit(True)})
