"""Problem 2: fields that change from file to file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import drift
from quire.session import read

_FILES = ("deployment", "seq_no", "payload")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = drift.changes(read(spark, sf_dir, "artifact_files"), *_FILES)
    return c.select(c.grp.alias("deployment"), c.seq.cast("int").alias("seq_no"), "field_path", "change_kind", "new_path")


def p2_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every readable file with every current path of its deployment, in one type a path."""
    t = drift.table(read(spark, sf_dir, "artifact_files"), *_FILES)
    return t.select(t.grp.alias("deployment"), t.seq.cast("int").alias("seq_no"), "path", "type", "value")


def p2_changes_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_found(spark, sf_dir).groupBy("field_path", "change_kind").agg(F.count("*").alias("files"))


QUERIES = {"p2_found": p2_found, "p2_table": p2_table, "p2_changes_by_kind": p2_changes_by_kind}
SQL: dict[str, str] = {}
