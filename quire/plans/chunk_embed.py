"""Chunking and embedding of enriched records by themselves: only documents that are not done under the configuration, appended.

    python -m quire.plans.chunk_embed --input RUN/stages/enriched --out FOLDER [--chunker NAME] [--embedder NAME] [--force]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.config import ChunkEmbedConfig
from quire.operators import chunking, embedding, retrieval  # noqa: F401 (embedding registers the embedders)
from quire.registry import create_embedder
from quire.session import cut
from quire.streaming.incremental import _there

RECORDS = "source_object_id string, language string, main_text string, tables array<struct<caption:string,caption_citations:array<string>,content:string,content_citations:array<string>,content_format:string>>, figures array<struct<caption:string,description:string,source_ref:string>>, formulas array<string>"
KEYS = ["doc_id", "config_hash"]
# Retrieval settings by profile, reported and not acted on.
PROFILES = {
    "hybrid_default": {
        "boost_fields": {"title": 2.0, "main_text": 1.0, "tables": 1.0, "figures": 0.7},
        "hybrid_weights": {"dense": 0.6, "sparse": 0.4},
        "rrf_k": 60,
        "suggested_top_k": 10,
    },
    "dense_only": {
        "boost_fields": {"main_text": 1.0, "tables": 1.0, "figures": 1.0},
        "hybrid_weights": {"dense": 1.0, "sparse": 0.0},
        "rrf_k": None,
        "suggested_top_k": 10,
    },
}


def run(records: DataFrame, out: str, config: ChunkEmbedConfig, force: bool = False) -> dict:
    """Appends chunk and vector records to out; returns counts and chunk statistics."""
    spark = records.sparkSession
    docs = records.select(F.col("source_object_id").alias("doc_id"), "language", "main_text", F.lit(None).cast("array<string>").alias("main_text_citations"), "tables", "figures", "formulas", F.lit(config.hash()).alias("config_hash")).dropDuplicates(["doc_id"])
    done = cut(_there(spark, f"{out}/chunk_records", "doc_id string, config_hash string").distinct())
    skipped = 0 if force else retrieval.skipped_count(docs, done, KEYS).first()[0]
    new = docs if force else retrieval.unprocessed(docs, done, KEYS)
    chunks = cut(chunking.document_chunks(new.drop("config_hash"), config))
    embedder = create_embedder(config.embedder, config.embedder_params)
    chunks.write.mode("append").parquet(f"{out}/chunk_records")
    retrieval.vectors(chunks, embedder).write.mode("append").parquet(f"{out}/vector_records")
    stats = retrieval.quality(chunks).first()
    profile = {**PROFILES.get(config.retrieval_profile, PROFILES["hybrid_default"]), "model": embedder.model, "dim": embedder.dimension}
    return {"skipped_existing": skipped, "chunks": chunks.count(), "stats": stats.asDict() if stats else {}, "retrieval_profile": profile}


def main(argv: list[str] | None = None) -> dict:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--input", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--chunker", default=ChunkEmbedConfig.chunker)
    p.add_argument("--embedder", default=ChunkEmbedConfig.embedder)
    p.add_argument("--force", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("quire-chunk-embed").getOrCreate()
    return run(spark.read.schema(RECORDS).json(a.input), a.out, ChunkEmbedConfig(chunker=a.chunker, embedder=a.embedder), a.force)


if __name__ == "__main__":
    print(main())
