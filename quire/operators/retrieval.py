"""Retrieval items, vector records, reports, and the joins between stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import chunking, lexical

# Contract versions of the reports.
EMBEDDING_REPORT, QUALITY_REPORT = "embedding-report-v1", "chunk-embed-quality-v1"


def items(chunks: DataFrame) -> DataFrame:
    """Retrieval items of document_chunks(): type, position, content, caption and term statistics."""
    kind = chunking.retrieval_type(F.col("chunk_type"))
    body = F.when(kind == "text_chunk", F.col("content")).otherwise(F.concat_ws("\n", F.when(~X.blank(F.col("content")), F.col("content")), F.when(~X.blank(F.col("caption")), F.col("caption"))))
    return chunks.select(F.col("chunk_id").alias("record_id"), F.col("doc_id").alias("source_object_id"), kind.alias("retrieval_type"), F.replace(kind, F.lit("text_chunk"), F.lit("text")).alias("item_type"), "component_type", "field_path", "position_index", "start", "end", "config_hash", "content", "caption", lexical.payload(body).alias("lexical"))


def vectors(chunks: DataFrame, embedder) -> DataFrame:
    """Vector records of chunks."""
    text = chunks.select(F.col("chunk_id").alias("record_id"), F.col("doc_id").alias("source_object_id"), chunking.retrieval_type(F.col("chunk_type")).alias("retrieval_type"), chunking.embedding_text(F.col("content"), F.col("caption")).alias("_t"))
    return embedder.apply(text, "_t", "embedding").drop("_t").withColumns({"embedding_model": F.lit(embedder.model), "embedding_dimension": F.size("embedding"), "embedding_status": F.lit("embedded")})


def with_vectors(records: DataFrame, vecs: DataFrame) -> DataFrame:
    """Records left-joined to their vectors, nested; a record without any has an empty list."""
    v = vecs.groupBy("source_object_id", "record_id").agg(F.collect_list(F.struct(F.col("embedding_model").alias("model"), F.col("embedding_dimension").alias("dimension"), F.col("embedding").alias("values"))).alias("embeddings"))
    return records.join(v, ["source_object_id", "record_id"], "left").withColumn("embeddings", F.coalesce("embeddings", F.array()))


def asset_of(image_index: Column, assets: Column) -> Column:
    """The asset at an image's place, null beyond the list."""
    return F.try_element_at(assets, image_index + 1)


def unprocessed(docs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Documents whose keys are not among those done."""
    return docs.join(done.select(*keys), keys, "left_anti")


def skipped_count(docs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return docs.join(done.select(*keys), keys, "left_semi").agg(F.count("*").alias("skipped_existing"))


def without_records(docs: DataFrame, records: DataFrame, failures: DataFrame) -> DataFrame:
    """Documents with neither a retrieval record nor a failure."""
    key = ["source_object_id"]
    return docs.join(records.select(*key), key, "left_anti").join(failures.select(*key), key, "left_anti").filter(F.length("source_object_id") > 0)


def failures(docs: DataFrame) -> DataFrame:
    """Documents that cannot be chunked, with the reason: no rows, or no extraction in the first row."""
    first = F.try_element_at(F.col("rows"), F.lit(1))
    why = F.when(F.coalesce(F.size("rows"), F.lit(0)) <= 0, "the document has no rows").when(first["extraction"].isNull(), "the first row has no extraction")
    return docs.select(F.col("object_id").alias("source_object_id"), "source_uri", why.alias("reason")).filter("reason is not null")


def embedding_report(records: DataFrame, vecs: DataFrame, errors: DataFrame, model: str, dimension: int) -> DataFrame:
    """One row: counts, and passed unless there is an error."""
    r, v, e = records.agg(F.count("*").alias("eligible_count")), vecs.agg(F.count("*").alias("generated_count")), errors.agg(F.count("*").alias("skipped_count"))
    one = [x.withColumn("_k", F.lit(1)) for x in (r, v, e)]  # single rows, joined on a constant key
    j = one[0].join(one[1], "_k").join(one[2], "_k").drop("_k")
    return j.select(F.lit(EMBEDDING_REPORT).alias("contract_version"), F.when(F.col("skipped_count") > 0, "failed").otherwise("passed").alias("status"), F.lit(model).alias("model"), F.lit(dimension).alias("dimension"), "eligible_count", "generated_count", "skipped_count")


def quality(chunks: DataFrame) -> DataFrame:
    """Chunk statistics, one row: count, mean length (one decimal), p90 (nearest rank) and the share of text chunks that end within a sentence.

    p90 is the value at sorted place int(0.9 * (n - 1) + 0.5). It comes from counts by length, so what is sorted is the set of lengths.
    """
    text = F.col("chunk_type") == "text_chunk"
    mid = X.mid_sentence(F.col("content"), F.col("end"), F.col("field_chars"))
    base = chunks.select(F.length("content").alias("n"), text.alias("t"), (text & mid).alias("m"))
    by = base.groupBy("n").agg(F.count("*").alias("c"), F.count_if("t").alias("t"), F.count_if("m").alias("m"))
    total = by.agg(F.sum("c").alias("chunks"), F.sum(F.col("n") * F.col("c")).alias("chars"), F.sum("t").alias("text_chunks"), F.sum("m").alias("mid")).withColumn("_k", F.lit(1))
    running = by.withColumn("upto", F.sum("c").over(W.orderBy("n"))).withColumn("_k", F.lit(1)).join(total, "_k")
    place = F.least(F.col("chunks") - 1, F.floor((F.col("chunks") - 1) * 0.9 + 0.5))
    p90 = running.filter(F.col("upto") > place).agg(F.min("n").alias("chars_p90")).withColumn("_k", F.lit(1))
    rate = F.when(F.col("text_chunks") > 0, F.round(F.col("mid") / F.col("text_chunks"), 4)).otherwise(0.0)
    return total.join(p90, "_k").select(F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce(F.round(F.col("chars") / F.col("chunks"), 1), F.lit(0.0)).alias("chars_mean"), F.coalesce(F.col("chars_p90").cast("double"), F.lit(0.0)).alias("chars_p90"), rate.alias("mid_sentence_end_rate"))


def counts_by_type(df: DataFrame, kind: str) -> DataFrame:
    return df.groupBy(kind).agg(F.count("*").alias("n"))


def restore_order(wanted: DataFrame, docs: DataFrame, key: str, order: str, doc_order: str) -> DataFrame:
    """Documents in the order of the requests: the k-th request of a key gets the k-th document of that key."""
    k = "_occurrence"
    left = wanted.withColumn(k, F.row_number().over(W.partitionBy(key).orderBy(order)))
    right = docs.withColumn(k, F.row_number().over(W.partitionBy(key).orderBy(doc_order)))
    return left.join(right, [key, k]).drop(k)


def stage_mode(flags: Column) -> Column:
    """Aggregate: pass-through if there are rows and all are flagged."""
    return F.when((F.count("*") > 0) & F.bool_and(F.coalesce(flags, F.lit(False))), "pass-through").otherwise("implemented")


def manifest(df: DataFrame, stage: str, id: str, status: str) -> DataFrame:
    """Counts of a stage by status, one row."""
    return df.agg(F.lit(stage).alias("stage"), F.count("*").alias("document_count"), F.count_if(F.col(status) == "succeeded").alias("succeeded_count"), F.count_if(F.col(status) != "succeeded").alias("other_count"), F.count_distinct(id).alias("distinct_count")).withColumn("contract_version", F.lit("stage-metadata-v1"))


def document_identity(objects: DataFrame, views: DataFrame) -> DataFrame:
    """Output identity of documents: source fields, view fields and the s3 struct where any part of it is known."""
    m = F.col("metadata")
    s3 = F.struct(m["s3_bucket"].alias("bucket"), m["s3_key"].alias("key"), X.clean_etag(m["s3_etag"]).alias("etag"))
    some = m["s3_bucket"].isNotNull() | m["s3_key"].isNotNull() | m["s3_etag"].isNotNull()
    v = views.select(F.col("source_object_id").alias("object_id"), "title", "document_type", "language")
    return objects.join(v, "object_id", "left").select(F.col("object_id").alias("document_id"), F.col("uri").alias("source_uri"), m["file_name"].alias("file_name"), "content_type", m["size_bytes"].alias("size_bytes"), m["sha256"].alias("sha256"), "title", "document_type", "language", F.when(some, s3).alias("s3"))


def multiset_overlap(a: DataFrame, b: DataFrame, keys: list[str], token: str) -> DataFrame:
    """Tokens two tables of counts share: overlap, precision and recall for each key."""
    x, y = a.groupBy(*keys, token).agg(F.count("*").alias("x")), b.groupBy(*keys, token).agg(F.count("*").alias("y"))
    g = x.join(y, [*keys, token], "full").groupBy(*keys).agg(F.sum(F.least(F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0)))).alias("overlap"), F.sum("x").alias("in_a"), F.sum("y").alias("in_b"))
    return g.select(*keys, "overlap", (F.col("overlap") / F.col("in_b")).alias("precision"), (F.col("overlap") / F.col("in_a")).alias("recall"))
