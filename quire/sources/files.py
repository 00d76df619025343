"""Files of a folder, object inventories and stage artifacts as DataFrames."""

from __future__ import annotations

import os
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.config import InputConfig
from quire.functions import ids
from quire.functions import text as X

FILE = "path string, relative string, length long, content binary"


def hidden(relative):
    """Whether any part of a relative path starts with a dot."""
    return relative.rlike(r"(^|/)\.")


def local_files(spark: SparkSession, config: InputConfig, content: bool = True) -> DataFrame:
    """Files in the order of their folded relative paths; sizes above the cap are listed without content.

    Spark lists the files; those it skips (empty ones, and names that start with a dot or underscore) are added by a listing of their own,
    and hidden ones (with a dot) are left out unless they are wanted. Names and sizes alone are put in order, and the cap on the number
    of files comes after the order; the tasks then read the bytes of their part of the list from the shared folder.
    """
    root = os.path.abspath(config.path)
    base = root if os.path.isdir(root) else os.path.dirname(root)
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(config.recursive).lower())
    found = r.load(root).select("path", "length")
    special = _special(base, config) if os.path.isdir(root) else []
    if special:
        found = found.unionByName(spark.createDataFrame([(x, os.path.getsize(x)) for x in special], "path string, length long"))
    path = F.regexp_replace(F.col("path"), r"^file:/+", "/")
    df = found.select(path.alias("path"), X.portable_path(path, base).alias("relative"), "length").dropDuplicates(["path"])
    if not config.include_hidden:
        df = df.filter(~hidden(F.col("relative")))
    if config.extensions:
        df = df.filter(F.concat(F.lit("."), X.file_format(F.col("relative"))).isin(*config.extensions))
    df = df.orderBy(F.lower("relative"), "relative")
    df = df.limit(config.max_files) if config.max_files else df
    return df.mapInArrow(_with_content(config.max_bytes), "path string, relative string, length long, content binary") if content else df.withColumn("content", F.lit(None).cast("binary"))


def _with_content(max_bytes: int):
    """Reads the listed files one by one, in the order of the list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, p in enumerate(b.column(0).to_pylist()):
                body = None
                if b.column(2)[k].as_py() <= max_bytes:
                    with open(p, "rb") as f:
                        body = f.read()
                yield pa.RecordBatch.from_arrays([*(c.slice(k, 1) for c in b.columns), pa.array([body], pa.binary())], names=["path", "relative", "length", "content"])

    return run


def _special(base: str, config: InputConfig) -> list[str]:
    out = []
    for folder, _, names in os.walk(base):
        inside = os.path.relpath(folder, base)
        skipped = any(p.startswith((".", "_")) for p in inside.split(os.sep) if p != ".")
        for n in names:
            path = os.path.join(folder, n)
            if skipped or n.startswith((".", "_")) or os.path.getsize(path) == 0:
                out.append(path)
        if not config.recursive:
            break
    return out


def data_objects(files: DataFrame, provider: str = "local") -> DataFrame:
    """Source identity of files, with checksum and size."""
    uri = F.col("relative")
    return files.select(
        ids.document_id(uri).alias("object_id"), uri.alias("uri"), X.content_type(uri).alias("content_type"),
        F.struct(F.lit(provider).alias("input_provider"), X.safe_file_name(uri).alias("file_name"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), uri.alias("relative_uri"), X.file_format(uri).alias("format")).alias("metadata"), "content",
    )


INVENTORY = "bucket string, files array<struct<key:string,presigned_url:string,size:long,etag:string>>"


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an inventory file in order: bucket, key, url, size, etag. Folder markers are left out; a blank key or a url that is not http(s) or file is an error."""
    raw = spark.read.schema(INVENTORY).option("multiLine", True).json(path)
    e = raw.select(F.assert_true(~X.blank(F.col("bucket")), F.lit("the inventory names no bucket")).alias("_a"), "bucket", F.posexplode("files").alias("ordinal", "f"))
    return checked_entries(e.select("bucket", "ordinal", F.col("f.key").alias("key"), F.col("f.presigned_url").alias("url"), F.col("f.size").alias("size"), X.clean_etag(F.col("f.etag")).alias("etag")))


def checked_entries(e: DataFrame) -> DataFrame:
    bad = F.when(X.blank(F.col("key")), "an entry has no key").when(~F.coalesce(F.col("url").rlike("(?i)^(https?|file)://"), F.lit(False)), "an entry has no valid url").when(F.col("size") < 0, "an entry has a negative size")
    return e.withColumn("_e", bad).filter(F.when(F.col("_e").isNotNull(), F.raise_error(F.concat_ws(": ", "_e", "key")).cast("boolean")).otherwise(True)).drop("_e").filter(~F.col("key").endswith("/"))


def select_entry(entries: DataFrame, key: str | None = None) -> DataFrame:
    """The entry of a key, else the only one."""
    if key is not None:
        return entries.filter(F.col("key") == key).limit(1)
    n = entries.limit(2).count()
    if n != 1:
        raise ValueError("a key must be given for an inventory of several entries" if n else "the inventory is empty")
    return entries


def download(entries: DataFrame, max_bytes: int = 536_870_912, timeout: float = 60.0) -> DataFrame:
    """Entries with their content and status: loaded, too_large, size_mismatch or failed (with the error). One request an entry."""

    def fetch(url: str, size: int | None) -> tuple[str, str | None, bytes | None, str | None]:
        if size is not None and size > max_bytes:
            return "too_large", None, None, None
        try:
            with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310 (schemes are checked)
                kind = (r.headers.get("Content-Type") or "").partition(";")[0].strip() or None
                body = r.read(max_bytes + 1)
        except (OSError, ValueError) as e:
            return "failed", None, None, f"{type(e).__name__}: {e}"
        if len(body) > max_bytes:
            return "too_large", kind, None, None
        return ("size_mismatch", kind, None, None) if size is not None and len(body) != size else ("loaded", kind, body, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ok = urllib.parse.urlparse(row["url"]).scheme.lower() in ("http", "https", "file")
                status, kind, body, error = fetch(row["url"], row["size"]) if ok else ("failed", None, None, "scheme")
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((row["bucket"], pa.string()), (row["ordinal"], pa.int32()), (row["key"], pa.string()), (status, pa.string()), (kind, pa.string()), (body, pa.binary()), (error, pa.string()))], names=["bucket", "ordinal", "key", "status", "response_content_type", "content", "error"])

    return entries.select("bucket", "ordinal", "key", "url", "size").mapInArrow(run, "bucket string, ordinal int, key string, status string, response_content_type string, content binary, error string")


def s3_object(spark: SparkSession, uri: str, max_bytes: int = 536_870_912) -> DataFrame:
    """One object through the s3a connector; objects above the cap are refused before they are read."""
    parts = urllib.parse.urlparse(uri)
    if parts.scheme != "s3" or not parts.netloc or not parts.path.strip("/") or parts.query or parts.fragment:
        raise ValueError(f"not an object address: {uri!r}")
    df = spark.read.format("binaryFile").load(f"s3a://{parts.netloc}{parts.path}")
    return df.filter(F.when(F.col("length") > max_bytes, F.raise_error(F.lit("the object is too large")).cast("boolean")).otherwise(True))


def enriched_records(spark: SparkSession, folder: str, schema=None) -> DataFrame:
    """Enriched records of a run: its list file if there is one, else the data of its document files."""
    r = spark.read.option("multiLine", True)
    r = r.schema(schema) if schema else r
    if os.path.exists(f"{folder}/enriched_data.json"):
        return r.json(f"{folder}/enriched_data.json")
    if not os.path.isdir(f"{folder}/documents"):
        raise FileNotFoundError(f"no enriched records in {folder}")
    return r.json(f"{folder}/documents/*.json").select("data.*")


def runs(spark: SparkSession, root: str) -> DataFrame:
    """Runs with a manifest in any stage, newest first."""
    m = spark.read.option("recursiveFileLookup", "false").json(f"{root}/*/manifests/*", schema="stage string, written_at timestamp, document_count long").withColumn("run_id", F.regexp_extract(F.input_file_name(), r"/([^/]+)/manifests/", 1))
    return m.groupBy("run_id").agg(F.max("written_at").alias("written_at"), F.sort_array(F.collect_set("stage")).alias("stages"), F.max("document_count").alias("documents")).orderBy(F.desc("written_at"), F.desc("run_id"))


def json_rows(df: DataFrame, content: str) -> DataFrame:
    """Rows of JSON texts as variants: the elements of an array, else the one value; scalars as {"value": x}; broken ones give none."""
    v = df.select("*", F.expr(f"try_parse_json({content})").alias("_v")).filter("_v is not null")
    kind = F.expr("schema_of_variant(_v)")
    many = v.withColumn("_k", kind)
    arrays = many.filter("_k like 'ARRAY%'").select(*df.columns, F.expr("explode(cast(_v as array<variant>))").alias("row"))
    return arrays.unionByName(many.filter("_k not like 'ARRAY%'").select(*df.columns, F.col("_v").alias("row"))).withColumn("row", F.expr("case when schema_of_variant(row) like 'OBJECT%' then row else parse_json(concat('{\"value\":', to_json(row), '}')) end"))


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; every value is text."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)
