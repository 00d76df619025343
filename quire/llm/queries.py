"""Queries of the language-model operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm import language, leakage, packing, residue, scannoise, similar, splitting
from quire.session import cut, read


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = scannoise.texts_of(read(spark, sf_dir, "parsed_docs"), "object_id", "text", "parsed_text")
    return parsed.unionByName(scannoise.texts_of(read(spark, sf_dir, "document_views"), "source_object_id", "main_text", "view_main_text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scannoise.defects(_scanned(spark, sf_dir))
    return d.select(F.col("id").alias("object_id"), F.col("field").alias("in_field"), "defect")


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = scannoise.repaired(_scanned(spark, sf_dir))
    return r.select(F.col("id").alias("object_id"), F.col("field").alias("in_field"), "text")


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(
        read(spark, sf_dir, "chunks"), read(spark, sf_dir, "chunk_configs"), id="chunk_id", text="text", key="config_hash",
        is_table=F.col("chunk_type") == "table_chunk", start="char_start", max_rows="max_rows_per_chunk", max_chars="max_chars", overlap="overlap_chars",
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).filter("piece = 0").select(F.col("id").alias("chunk_id"), "limit_kind")


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).withColumnRenamed("id", "chunk_id")


def p6_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the pieces of every oversized chunk: each under its limit, cut from the text where it says, texts with the
    overlap of their configuration, and nothing of the chunk missing."""
    limits = read(spark, sf_dir, "chunk_configs").select("config_hash", "max_rows_per_chunk", "max_chars", "overlap_chars")
    whole = read(spark, sf_dir, "chunks").select("chunk_id", "config_hash", F.col("text").alias("whole")).dropDuplicates(["chunk_id"])
    p = p6_pieces(spark, sf_dir).join(whole, "chunk_id").join(F.broadcast(limits), "config_hash")  # a row a configuration
    w = W.partitionBy("chunk_id").orderBy("piece")  # the pieces of a chunk
    rows = F.col("limit_kind") == "rows"
    step = F.lag("end").over(w) - F.col("start")
    each = p.withColumns({
        "under": F.when(rows, splitting.data_rows(F.col("text")) <= F.col("max_rows_per_chunk")).otherwise(F.length("text") <= F.col("max_chars")),
        "there": rows | (F.col("text") == F.substring("whole", F.col("start") + 1, F.col("end") - F.col("start"))),
        "over": rows | (F.col("piece") == 0) | (step == F.least("overlap_chars", F.floor((F.col("max_chars") - 1) / 2))),
    })
    first, last = F.min("start") == 0, F.max("end") == F.max(F.length("whole"))
    all_rows = F.sum(splitting.data_rows(F.col("text"))) == F.max(splitting.data_rows(F.col("whole")))
    return each.groupBy("chunk_id", "limit_kind").agg(F.bool_and("under").alias("under_limit"), F.bool_and("there").alias("as_in_text"), F.bool_and("over").alias("overlaps"), F.when(F.col("limit_kind") == "rows", all_rows).otherwise(first & last).alias("whole"))


def _limits(spark: SparkSession, sf_dir: str) -> list[dict]:
    rows = read(spark, sf_dir, "pack_limits").collect()  # fixed: a row a packing
    return [{"pack_id": r["pack_id"], "capacity": r["capacity_tokens"], "separator": r["separator_tokens"]} for r in rows]


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.token_counts(read(spark, sf_dir, "documents"), "doc_id", "text", f"{packing.TOKENIZERS}/{packing.VOCABULARY}")


#: Of the instruction packings: segments for each 128 tokens of capacity, and the share of the capacity that may bear loss.
SEGMENT_TOKENS, LOSS_SHARE = 128, 0.8
INSTRUCTION_SHARD = 3_000  # three limits make more kinds of items, and the time for a container grows with them


def _instruction_limits(spark: SparkSession, sf_dir: str) -> list[dict]:
    return [{**x, "max_segments": max(2, x["capacity"] // SEGMENT_TOKENS), "max_loss": int(LOSS_SHARE * x["capacity"])} for x in _limits(spark, sf_dir)]


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its container, under the limits of pack_limits, which are of tokens alone."""
    return packing.pack(_sizes(spark, sf_dir), _limits(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def p8_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as instruction examples (the first paragraph is the prompt and bears no loss), under limits of tokens, segments and loss."""
    return packing.pack(_sizes(spark, sf_dir), _instruction_limits(spark, sf_dir), shard_items=INSTRUCTION_SHARD).withColumnRenamed("id", "doc_id")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each packing, the containers used and the fewest that could hold all tokens."""
    p = p8_containers(spark, sf_dir).groupBy("pack_id", "capacity", "container").agg(F.sum("tokens").alias("t"))
    return p.groupBy("pack_id").agg(F.count("*").alias("containers"), F.ceil(F.sum("t") / F.first("capacity")).alias("at_least"), F.round(F.sum("t") / F.sum("capacity"), 4).alias("fill"))


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of both packings: all texts placed, with all their tokens and once; only those split that fit no container; no limit broken; little room unused."""
    sizes = cut(_sizes(spark, sf_dir))
    out = None
    for name, limits, least, shard in (("tokens", _limits(spark, sf_dir), 0.98, packing.SHARD_ITEMS), ("instructions", _instruction_limits(spark, sf_dir), 0.9, INSTRUCTION_SHARD)):
        p = cut(packing.pack(sizes, limits, shard_items=shard))
        most = spark.createDataFrame([(x["pack_id"], x["separator"], x.get("max_segments", x["capacity"]), x.get("max_loss", x["capacity"])) for x in limits], "pack_id string, separator long, max_segments long, max_loss long")
        own = p.groupBy("pack_id", "id").agg(F.sum("tokens").alias("placed"), F.count("*").alias("pieces"), F.count_distinct("token_start").alias("starts"), F.first("capacity").alias("capacity")).join(sizes, "id").join(F.broadcast(most), "pack_id")  # a row a packing
        texts = own.groupBy("pack_id").agg(
            F.count("*").alias("texts"), F.count_if(F.col("placed") != F.col("tokens")).alias("incomplete"), F.count_if(F.col("starts") != F.col("pieces")).alias("repeated"),
            F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity")) & (F.col("loss") <= F.col("max_loss"))).alias("split_in_vain"),
        )
        c = p.groupBy("pack_id", "capacity", "container").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.sum("loss").alias("l")).join(F.broadcast(most), "pack_id")
        full = F.greatest(F.col("t") / F.col("capacity"), F.col("n") / F.col("max_segments"), F.col("l") / F.col("max_loss"))
        boxes = c.groupBy("pack_id").agg(
            F.count_if(F.col("t") + (F.col("n") - 1) * F.col("separator") > F.col("capacity")).alias("over_tokens"), F.count_if(F.col("n") > F.col("max_segments")).alias("over_segments"), F.count_if(F.col("l") > F.col("max_loss")).alias("over_loss"),
            (F.avg(full) >= least).alias("well_filled"),
        )
        one = texts.join(boxes, "pack_id").withColumn("packing", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def _model(spark: SparkSession, sf_dir: str) -> language.Model:
    return language.train(read(spark, sf_dir, "documents"), id="doc_id", text="text", label="lang")


_VIEWS = {"id": "source_object_id", "text": "main_text", "version": "loaded_at"}


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.issues(read(spark, sf_dir, "document_views"), _model(spark, sf_dir), **_VIEWS, label="language").withColumnRenamed("id", "object_id")


def p4_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(read(spark, sf_dir, "document_views"), _model(spark, sf_dir), **_VIEWS).withColumnRenamed("id", "object_id")


def p4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.segments(read(spark, sf_dir, "document_views"), _model(spark, sf_dir), **_VIEWS).withColumnRenamed("id", "object_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"), id="doc_id", text="text", item_id="item_id", passage="passage")


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold each leaked item."""
    items = read(spark, sf_dir, "eval_items").select("item_id", "suite")
    return p9_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("texts")).join(items, "item_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residues(read(spark, sf_dir, "documents"), id="doc_id", text="text")


def p10_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.clean(read(spark, sf_dir, "documents"), id="doc_id", text="text").select("doc_id", "source", "n_chars")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.unit_vectors(read(spark, sf_dir, "vector_records"), id="record_id", vector="embedding", model="embedding_model", dimension="embedding_dimension", usable=F.col("embedding_status") == "embedded")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.similar_pairs(_records(spark, sf_dir), k=10, least=0.90).select("record_id_a", "record_id_b")


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar records of every usable record, of the same model, with their similarity."""
    return similar.neighbours(_records(spark, sf_dir), k=10).select(F.col("a").alias("record_id"), F.col("b").alias("neighbour_id"), "similarity")


QUERIES = {
    "p1_found": p1_found, "p1_repaired": p1_repaired,
    "p6_found": p6_found, "p6_pieces": p6_pieces, "p6_check": p6_check, "p8_containers": p8_containers, "p8_instructions": p8_instructions, "p8_fill": p8_fill, "p8_check": p8_check,
    "p4_found": p4_found, "p4_languages": p4_languages, "p4_segments": p4_segments, "p3_found": p3_found, "p3_neighbours": p3_neighbours, "p9_found": p9_found, "p9_items": p9_items, "p10_found": p10_found, "p10_clean": p10_clean,
}

SQL = {
    "p8_check": "SELECT packing, pack_id, (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL AND length(text) > 0) AS texts, 0 AS incomplete, 0 AS repeated, 0 AS split_in_vain, 0 AS over_tokens, 0 AS over_segments, 0 AS over_loss, true AS well_filled FROM pack_limits, (VALUES ('tokens'), ('instructions')) AS v(packing)",
    "p6_found": r"""
WITH c AS (SELECT DISTINCT ON (chunk_id) chunk_id, chunk_type, text, max_rows_per_chunk, max_chars FROM chunks JOIN chunk_configs USING (config_hash) WHERE text IS NOT NULL ORDER BY chunk_id),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')) AS lines, string_split(regexp_replace(text, '<[tT][rR]\b', chr(1), 'g'), chr(1)) AS parts FROM c),
n AS (SELECT *, CASE WHEN regexp_matches(text, '^\s*<') THEN len(list_filter(parts[2:], lambda x: regexp_matches(x, '(?i)<td\b')))
  ELSE len(lines) - 1 - CASE WHEN len(lines) > 1 AND regexp_full_match(lines[2], '\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*') THEN 1 ELSE 0 END END AS data_rows FROM l)
SELECT chunk_id, CASE WHEN chunk_type = 'table_chunk' THEN 'rows' ELSE 'chars' END AS limit_kind
FROM n WHERE CASE WHEN chunk_type = 'table_chunk' THEN data_rows > max_rows_per_chunk ELSE length(text) > max_chars END
""",
}
SQL["p6_check"] = f"SELECT chunk_id, limit_kind, true AS under_limit, true AS as_in_text, true AS overlaps, true AS whole FROM ({SQL['p6_found']})"
# All pairs of a model, by brute force: what the index must find.
SQL["p3_found"] = """WITH v AS (SELECT DISTINCT ON (record_id, embedding_model) record_id AS id, embedding_model AS m, len(embedding) AS d, CAST(embedding AS DOUBLE[]) AS e FROM vector_records
WHERE embedding_status = 'embedded' AND len(embedding) = embedding_dimension AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 ORDER BY record_id, embedding_model, loaded_at),
p AS (SELECT a.m, a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.m = b.m AND a.d = b.d AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY m, a ORDER BY s DESC, b) AS k FROM p)
SELECT DISTINCT least(a, b) AS record_id_a, greatest(a, b) AS record_id_b FROM r WHERE k <= 10 AND s >= 0.90"""
