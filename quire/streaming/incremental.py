"""Incremental ingestion (an extension): documents that arrive as files are chunked once, whatever happens in between.

A Structured Streaming file source feeds foreachBatch; each batch appends the chunks of documents that are not yet there under the
same configuration, keyed by (doc_id, config_hash), so a repeated batch writes nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.config import ChunkEmbedConfig
from quire.operators import chunking, retrieval


def _there(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def process(batch: DataFrame, out: str, config: ChunkEmbedConfig) -> None:
    spark = batch.sparkSession
    done = _there(spark, out, "doc_id string, config_hash string").distinct()
    new = retrieval.unprocessed(batch.dropDuplicates(["doc_id"]).withColumn("config_hash", F.lit(config.hash())), done, ["doc_id", "config_hash"]).drop("config_hash")
    chunking.document_chunks(new, config).write.mode("append").parquet(out)


def start(spark: SparkSession, source: str, schema, out: str, checkpoint: str, config: ChunkEmbedConfig, once: bool = True) -> StreamingQuery:
    """Reads new parquet files of documents and appends their chunks; once: what is there now, then stops."""
    stream = spark.readStream.schema(schema).parquet(source)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: process(df, out, config))
    return (writer.trigger(availableNow=True) if once else writer).start()
