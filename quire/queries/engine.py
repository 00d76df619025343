"""Queries of the document engine's own operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.config import ChunkEmbedConfig
from quire.functions import cells, ids, vectors
from quire.functions import geometry as G
from quire.functions import text as X
from quire.operators import chunking, documents, layout, lexical, retrieval
from quire.operators.embedding import LocalHash
from quire.session import read

CONFIG = ChunkEmbedConfig(chunker="fixed_overlap", chunker_params={"n_words": 512, "overlap": 128})


def _t(name: str):
    return lambda spark, sf_dir: read(spark, sf_dir, name)


_documents, _chunks, _objects, _views = _t("documents"), _t("chunks"), _t("data_objects"), _t("document_views")


def _parsed(spark, sf_dir) -> DataFrame:
    return documents.latest(read(spark, sf_dir, "parsed_docs"), "object_id", "loaded_at")


def doc_ids(spark, sf_dir):
    o = _objects(spark, sf_dir).select("object_id", "uri").distinct()
    return o.select("object_id", ids.document_id(F.col("uri")).alias("document_id"), ids.short_id(F.col("object_id"), F.lit("initial-schema")).alias("schema_id"))


def source_fields(spark, sf_dir):
    u, m = F.col("uri"), F.col("metadata")
    o = documents.latest(_objects(spark, sf_dir), "object_id", "loaded_at")
    return o.select("object_id", X.file_format(u).alias("format"), X.content_type(u).alias("type_by_name"), X.safe_file_name(u).alias("safe_name"), X.s3_bucket(u).alias("bucket"), X.s3_key(u).alias("key"), X.clean_etag(m["s3_etag"]).alias("etag"), X.format_bytes(m["size_bytes"]).alias("size"))


ROUTES = {**dict.fromkeys(["txt", "md", "json", "jsonl", "yaml", "yml"], "text"), **dict.fromkeys(["pdf", "png", "jpg", "jpeg", "gif", "webp", "tif", "tiff"], "document"), "pptx": "presentation", "docx": "word", "doc": "word", "xlsx": "spreadsheet_service", "xls": "spreadsheet_service"}


def route_by_extension(spark, sf_dir):
    from quire.plans.ingest import route

    return _objects(spark, sf_dir).select("object_id", "uri").distinct().select(route(X.file_format(F.col("uri"))).alias("route")).groupBy("route").agg(F.count("*").alias("n"))


VARIANTS = ("as_is", "zero_pages", "no_extraction", "no_content", "text_only")


def _damaged(spark, sf_dir) -> DataFrame:
    """Every parsed document as it is and damaged in the ways validation looks for, so that each of its branches has rows."""
    v, rows, meta = F.col("variant"), F.col("rows"), F.col("metadata")
    bare = F.transform(rows, lambda r: r.withField("extraction", F.lit(None)))
    return _parsed(spark, sf_dir).withColumn("variant", F.explode(F.array(*map(F.lit, VARIANTS)))).withColumns({
        "metadata": meta.withField("page_count", F.when(v == "zero_pages", 0).otherwise(meta["page_count"])).withField("backend", F.when(v == "no_extraction", "hosted").otherwise(meta["backend"])),
        "rows": F.when(v == "no_extraction", bare).when(v.isin("no_content", "text_only"), F.slice(rows, 1, 0)).otherwise(rows),
        "text": F.when(v == "no_content", F.lit(" \n")).when(v == "no_extraction", F.lit(None)).when(v == "text_only", F.lit("x")).otherwise(F.col("text")),
    })


def validation_reasons(spark, sf_dir):
    v = documents.validated(_damaged(spark, sf_dir))
    return v.select("object_id", "variant", F.inline("reasons"))


def quarantine_split(spark, sf_dir):
    v = documents.validated(_damaged(spark, sf_dir))
    one = documents.accepted(v).select("variant", F.lit("succeeded").alias("status"))
    two = documents.quarantined(v.withColumn("object_id", F.col("variant"))).select(F.col("document_id").alias("variant"), "status")
    return one.unionByName(two).groupBy("variant", "status").agg(F.count("*").alias("n"))


def document_view(spark, sf_dir):
    v = documents.view(_parsed(spark, sf_dir))
    return v.select("source_object_id", "document_type", "language", "title", F.md5("main_text").alias("main_text_md5"), F.size("tables").alias("tables"), F.size("figures").alias("figures"), F.size("formulas").alias("formulas"), "row_count")


def schema_inference(spark, sf_dir):
    s = documents.initial_schema(_parsed(spark, sf_dir))
    return s.select("schema_id", "source_object_id", "row_count", "table_count", "figure_count", "formula_count", F.array_join("observed_fields", ",").alias("observed"), F.array_join(F.transform("relationships", lambda r: r["relationship_type"]), ",").alias("relationships"), F.size("fields").alias("declared"))


def reading_order(spark, sf_dir):
    return layout.reading_order(layout.blocks(_parsed(spark, sf_dir))).select("object_id", "position", "component_id", F.col("type").alias("block_type"))


def page_bounds(spark, sf_dir):
    b = layout.page_bounds(layout.blocks(_parsed(spark, sf_dir)))
    return b.select("object_id", "page", *[F.col("bounds")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))], "bounds_source")


def figure_filter(spark, sf_dir):
    p = _parsed(spark, sf_dir)
    f = layout.figure_filter(layout.figures(p), layout.blocks(p))
    return f.select("object_id", "original_index", "source_ref", F.round("area_ratio", 9).alias("area_ratio"), "geometry_reason", "description_length", F.array_join("reasons", ",").alias("reasons"), "kept")


def source_refs(spark, sf_dir):
    r = _parsed(spark, sf_dir).select("object_id", F.posexplode("rows").alias("row_no", "r"))
    return r.select("object_id", "row_no", F.posexplode(X.source_refs(F.col("r.extraction.main_text_citations"), "main_text")).alias("n", "ref")).select("object_id", "row_no", "n", "ref.component_id", "ref.page", "ref.field")


def _doc_rows(spark, sf_dir) -> DataFrame:
    """First row of each document, as the chunker reads it."""
    e = F.element_at(F.col("rows"), 1)["extraction"]
    return _parsed(spark, sf_dir).filter(e.isNotNull()).select(F.col("object_id").alias("doc_id"), *[e[c].alias(c) for c in ("language", "main_text", "main_text_citations", "tables", "figures", "formulas")])


def document_chunks(spark, sf_dir):
    c = chunking.document_chunks(_doc_rows(spark, sf_dir), CONFIG)
    return c.select("chunk_id", "doc_id", "field_path", "chunk_type", "component_type", "start", "end", "page", "field_chars", F.md5("content").alias("content_md5"))


def retrieval_items(spark, sf_dir):
    i = retrieval.items(chunking.document_chunks(_doc_rows(spark, sf_dir), CONFIG))
    return i.select("record_id", "source_object_id", "retrieval_type", "item_type", "component_type", "position_index", F.col("lexical.dl").alias("dl"), F.map_keys("lexical.tf")[0].alias("first_term"), F.size("lexical.tf").alias("terms"))


def retrieval_vectors(spark, sf_dir):
    c = chunking.document_chunks(_doc_rows(spark, sf_dir), CONFIG)
    e = LocalHash(dimension=64)
    r = retrieval.with_vectors(retrieval.items(c), retrieval.vectors(c, e))
    return r.select("record_id", F.col("embeddings")[0]["dimension"].alias("dimension"), F.col("embeddings")[0]["values"][0].alias("first_value"), F.size("embeddings").alias("n"))


def fixed_overlap_chunks(spark, sf_dir):
    s = chunking.spans(_documents(spark, sf_dir).select("doc_id", "text"), "text", "fixed_overlap", {"n_words": 512, "overlap": 128})
    return s.select("doc_id", "piece", "start", "end", F.md5("content").alias("content_md5"))


def sentence_group_chunks(spark, sf_dir):
    s = chunking.spans(_documents(spark, sf_dir).select("doc_id", "text"), "text", "sentence_group", {"n": 5})
    return s.select("doc_id", "piece", "start", "end", F.md5("content").alias("content_md5"))


def paragraph_chunks(spark, sf_dir):
    s = chunking.spans(_documents(spark, sf_dir).select("doc_id", "text"), "text", "paragraph")
    return s.select("doc_id", "piece", "start", "end", F.md5("content").alias("content_md5"))


def recursive_chunks(spark, sf_dir):
    return chunking.spans(_documents(spark, sf_dir).select("doc_id", "text"), "text", "recursive", {"target": 400}).select("doc_id", "piece", "start", "end")


def term_frequency(spark, sf_dir):
    return lexical.term_frequencies(_documents(spark, sf_dir), "doc_id", "text")


def corpus_stats(spark, sf_dir):
    return lexical.corpus_stats(_chunks(spark, sf_dir), "text", ["config_hash"], "chunk_id")


def document_frequency(spark, sf_dir):
    return lexical.document_frequencies(_documents(spark, sf_dir), "text", ["source"])


def hash_embedding(spark, sf_dir):
    v = _documents(spark, sf_dir).select("doc_id", F.posexplode(vectors.rounded(vectors.hash_embedding(X.sanitize(F.col("text")), 64))).alias("k", "value"))
    return v.select("doc_id", "k", "value")


def vector_norms(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding").cast("array<double>")), 6).alias("norm"))


def token_estimate(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", X.token_estimate(F.col("text")).alias("tokens"), F.length(X.sanitize(F.col("text"))).alias("kept_chars"))


def chunk_quality(spark, sf_dir):
    s = chunking.spans(_documents(spark, sf_dir).select("doc_id", F.length("text").alias("field_chars"), "text"), "text", "fixed_overlap", {"n_words": 128, "overlap": 0})
    return retrieval.quality(s.withColumn("chunk_type", F.lit("text_chunk")))


def counts_by_type(spark, sf_dir):
    c = _chunks(spark, sf_dir).dropDuplicates(["chunk_id"])
    return retrieval.counts_by_type(c.select(chunking.retrieval_type(F.col("chunk_type")).alias("retrieval_type")), "retrieval_type")


def embedding_texts(spark, sf_dir):
    c = _chunks(spark, sf_dir).select("chunk_id", F.md5(chunking.embedding_text(F.col("text"), F.col("metadata.caption"))).alias("text_md5"))
    return c.dropDuplicates(["chunk_id"])


def skip_existing(spark, sf_dir):
    """Documents not yet chunked under each configuration."""
    done = _chunks(spark, sf_dir).select("doc_id", "config_hash").distinct()
    docs = _objects(spark, sf_dir).select(F.col("object_id").alias("doc_id"), F.lit(1).alias("one")).distinct()
    hashes = done.groupBy(F.lit(1).alias("one")).agg(F.collect_set("config_hash").alias("h"))  # one row: a fixed set of configurations
    wanted = docs.join(F.broadcast(hashes), "one").select("doc_id", F.explode("h").alias("config_hash"))
    return retrieval.unprocessed(wanted, done, ["doc_id", "config_hash"]).groupBy("config_hash").agg(F.count("*").alias("n"))


def skipped_count(spark, sf_dir):
    done = _chunks(spark, sf_dir).select(F.col("doc_id").alias("object_id")).distinct()
    return retrieval.skipped_count(_objects(spark, sf_dir).select("object_id").distinct(), done, ["object_id"])


def missing_documents(spark, sf_dir):
    docs = _objects(spark, sf_dir).select(F.col("object_id").alias("source_object_id")).distinct()
    vecs = read(spark, sf_dir, "vector_records").filter("embedding_status = 'embedded'").select("source_object_id")
    failed = read(spark, sf_dir, "vector_records").filter("embedding_status = 'failed'").select("source_object_id")
    return retrieval.without_records(docs, vecs, failed)


def chunk_vectors(spark, sf_dir):
    """Chunks left-joined to their vectors."""
    c = _chunks(spark, sf_dir).dropDuplicates(["chunk_id"]).select(F.col("chunk_id").alias("record_id"), F.col("doc_id").alias("source_object_id"))
    v = read(spark, sf_dir, "vector_records").dropDuplicates(["record_id", "embedding_model"])
    return retrieval.with_vectors(c, v).groupBy(F.size("embeddings").alias("vectors")).agg(F.count("*").alias("chunks"))


def request_order(spark, sf_dir):
    wanted = read(spark, sf_dir, "workbook_responses").select("source_uri", F.struct("received_at", "response_id", "loaded_at").alias("o"), F.col("response_id").alias("asked"))
    docs = read(spark, sf_dir, "workbook_responses").select("source_uri", F.struct("job_id", "response_id", "loaded_at").alias("d"), F.col("response_id").alias("answered"))
    return retrieval.restore_order(wanted, docs, "source_uri", "o", "d").select("source_uri", "asked", "answered")


def document_identity(spark, sf_dir):
    o = documents.latest(_objects(spark, sf_dir), "object_id", "loaded_at")
    v = documents.latest(_views(spark, sf_dir), "source_object_id", "loaded_at")
    d = retrieval.document_identity(o, v)
    return d.select("document_id", "file_name", "size_bytes", "title", "language", "s3.bucket", "s3.etag")


def markdown_rows(spark, sf_dir):
    c = _chunks(spark, sf_dir).filter("chunk_type = 'table_chunk' and not text like '<%'")
    counted = vectors.let(cells.markdown_lines(F.col("text")), lambda x: F.struct(F.size(x).alias("lines"), cells.header_lines(x).alias("header_lines")))
    return c.select("chunk_id", counted.alias("n")).select("chunk_id", "n.*").dropDuplicates(["chunk_id"])


def table_groups(spark, sf_dir):
    c = _chunks(spark, sf_dir).filter("chunk_type = 'table_chunk' and not text like '<%'").dropDuplicates(["chunk_id"])
    g = c.select("chunk_id", F.explode(chunking.table_groups(F.col("text"), 20)).alias("g"))
    return g.select("chunk_id", "g.row_group", "g.n_rows", "g.start", "g.end", F.md5("g.text").alias("text_md5"))


def html_table_shapes(spark, sf_dir):
    c = _chunks(spark, sf_dir).filter("chunk_type = 'table_chunk' and text like '<%'")
    s = c.select("chunk_id", X.table_shape_py(F.col("text")).alias("s"), F.size(X.table_tokens_py(F.col("text"))).alias("tokens"), X.span_count(F.col("text"), "rowspan").alias("rowspans"))
    return s.select("chunk_id", "s.n_rows", "s.n_columns", "tokens", "rowspans").dropDuplicates(["chunk_id"])


def table_guard(spark, sf_dir):
    """Tokens that a document's tables share with its texts: precision and recall."""
    c = _chunks(spark, sf_dir).dropDuplicates(["chunk_id"]).select("doc_id", "chunk_type", F.explode(X.analyze(F.col("text"))).alias("token"))
    o = retrieval.multiset_overlap(c.filter("chunk_type = 'table_chunk'"), c.filter("chunk_type = 'text_chunk'"), ["doc_id"], "token")
    return o.select("doc_id", "overlap", F.round("precision", 9).alias("precision_"), F.round("recall", 9).alias("recall_"))


def table_markdown(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    rows = n.groupBy("n_regionkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda r: F.array(r["n_nationkey"].cast("string"), r["n_name"])).alias("rows"))
    return rows.select("n_regionkey", X.markdown_table(F.array(F.lit("key"), F.lit("name")), F.col("rows")).alias("markdown"))


def cell_normalize(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.array_join(cells.cells(li, ["l_quantity", "l_discount", "l_shipdate", "l_returnflag"]), ";").alias("cells"))


def json_props(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.expr("try_variant_get(try_parse_json(props), '$.k', 'int')").alias("k"))


def component_boxes(spark, sf_dir):
    b = layout.first_by_component(layout.blocks(_parsed(spark, sf_dir)))
    box = G.box(F.col("bbox"))
    p = G.percent(box, F.lit(640.0), F.lit(900.0))
    return b.filter(box.isNotNull()).select("object_id", "component_id", F.round(G.area(F.col("bbox")), 6).alias("area"), p["left"].alias("left_pc"), p["width"].alias("width_pc"), G.canvas_edge(box[3]).alias("edge"))


def stage_manifest(spark, sf_dir):
    v = documents.validated(_damaged(spark, sf_dir)).withColumn("status", F.when(F.size("reasons") == 0, "succeeded").otherwise("quarantined"))
    return retrieval.manifest(v, "ingestion", "object_id", "status")


def _stages(spark, sf_dir):
    """Objects, parsed documents, the schemas of the accepted ones and the quarantine rows; documents without a text of their own are emptied, so that some are quarantined."""
    o = documents.latest(_objects(spark, sf_dir), "object_id", "loaded_at")
    p = _parsed(spark, sf_dir)
    v = documents.validated(p.withColumn("rows", F.when(F.col("text").isNull(), F.slice("rows", 1, 0)).otherwise(F.col("rows"))))
    ok = documents.accepted(v)
    return o, v.drop("reasons"), ok, documents.initial_schema(ok).select("source_object_id", "schema_id"), documents.quarantined(v)


def ingested_stage(spark, sf_dir):
    from quire.plans import artifacts

    o, p, _, schemas, bad = _stages(spark, sf_dir)
    i = artifacts.ingested(o, p, schemas, bad)
    return i.select("document_id", "contract_version", "status", "source.uri", F.md5("parsed.text").alias("text_md5"), F.size("parsed.rows").alias("rows"), "schema_id", "failure.disposition", F.array_join("failure.reasons.code", ",").alias("codes"))


def stage_progress(spark, sf_dir):
    from quire.plans import artifacts

    o, p, _, schemas, bad = _stages(spark, sf_dir)
    return artifacts.progress(artifacts.ingested(o, p, schemas, bad))


def output_stage(spark, sf_dir):
    """The five sections of the final documents."""
    from quire.plans import artifacts

    o, p, ok, _, _ = _stages(spark, sf_dir)
    kept = o.join(ok.select("object_id"), "object_id", "left_semi")
    view = documents.view(ok)
    clean, rich = (documents.pass_through(view, documents.next_schema(view.select("source_object_id"), k)) for k in ("cleaned", "enriched"))
    items = retrieval.with_vectors(retrieval.items(chunking.document_chunks(_doc_rows(spark, sf_dir).join(ok.select(F.col("object_id").alias("doc_id")), "doc_id", "left_semi"), CONFIG)), read(spark, sf_dir, "vector_records").limit(0))
    out = artifacts.output(retrieval.document_identity(kept, view), kept, ok.drop("reasons"), clean, rich, items)
    return out.select("document_id", "document.title", "ingest.source.uri", F.md5("ingest.data.text").alias("text_md5"), "clean.data.row_count", F.col("clean.data.source_schema_id").alias("clean_schema"), F.col("enrich.data.source_schema_id").alias("enrich_schema"), F.coalesce(F.size("retrieval.items"), F.lit(0)).alias("items"), "retrieval.lexical_stats.N", "retrieval.lexical_stats.avgdl")


def strip_audit(spark, sf_dir):
    from quire.plans.artifacts import strip_fields_py

    a = read(spark, sf_dir, "artifact_files").dropDuplicates(["artifact_id"])
    return a.select("artifact_id", strip_fields_py(F.col("payload")).alias("payload"))


def document_search(spark, sf_dir):
    """Documents whose name, title or id holds a text, whatever its case."""
    d = documents.latest(_views(spark, sf_dir), "source_object_id", "loaded_at")
    hay = F.lower(F.concat_ws(" ", "source_uri", "title", "source_object_id"))
    return d.filter(F.contains(hay, F.lit("table summary"))).select("source_object_id", "title")


QUERIES = {f.__name__: f for f in (doc_ids, source_fields, route_by_extension, validation_reasons, quarantine_split, document_view, schema_inference, reading_order, page_bounds, figure_filter, source_refs, document_chunks, retrieval_items, retrieval_vectors, fixed_overlap_chunks, sentence_group_chunks, paragraph_chunks, recursive_chunks, term_frequency, corpus_stats, document_frequency, hash_embedding, vector_norms, token_estimate, chunk_quality, counts_by_type, embedding_texts, skip_existing, skipped_count, missing_documents, chunk_vectors, request_order, document_identity, markdown_rows, table_groups, html_table_shapes, table_guard, table_markdown, cell_normalize, json_props, component_boxes, stage_manifest, ingested_stage, stage_progress, output_stage, strip_audit, document_search)}

_P = "p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY loaded_at DESC) AS rn FROM parsed_docs) WHERE rn = 1)"
_O = "o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY loaded_at DESC) AS rn FROM data_objects) WHERE rn = 1)"
_V = "v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_object_id ORDER BY loaded_at DESC) AS rn FROM document_views) WHERE rn = 1)"
_C = "c AS (SELECT DISTINCT ON (chunk_id) * FROM chunks ORDER BY chunk_id)"
_R = "r AS (SELECT object_id, source_format, unnest(range(len(rows))) AS row_no, unnest(rows) AS r FROM p)"
_B = "b AS (SELECT object_id, row_no, unnest(range(len(r.source_blocks))) AS block_no, unnest(r.source_blocks) AS b FROM r), f1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY object_id, b.component_id ORDER BY row_no, block_no) AS k FROM b WHERE length(b.component_id) > 0) WHERE k = 1)"
_BOX = "CASE WHEN len(b.bbox) = 4 AND b.bbox[3] > b.bbox[1] AND b.bbox[4] > b.bbox[2] THEN b.bbox END"
_TOK = "regexp_extract_all(replace(replace(lower(nfc_normalize({})), 'ß', 'ss'), '’', ''''), '[\\p{{L}}\\p{{N}}]+(?:''[\\p{{L}}\\p{{N}}]+)*')"
_SENT = "regexp_replace(regexp_replace(text, '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), '\\n\\n+', chr(1), 'g')"
_STRIPPED = "regexp_replace(regexp_replace({}, '^\\s+', ''), '\\s+$', '')"

# Sentences with their places: marks are put after each gap, so that what is between two marks is a sentence and the gap that ends it.
_SENTENCES = r"""mk AS (SELECT doc_id, text, string_split(regexp_replace(regexp_replace(text, '([.!?。！？])(\s+)', '\1\2' || chr(1), 'g'), '(\n\n+)(' || chr(1) || '?)', '\1' || chr(1), 'g'), chr(1)) AS ps FROM documents),
ml AS (SELECT doc_id, text, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM mk), mo AS (SELECT *, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM ml),
mt AS (SELECT doc_id, text, i, e - length(p) AS a, CASE WHEN regexp_matches(p, '[.!?。！？]\s+$') THEN e - length(p) + length(regexp_replace(p, '\s+$', '')) ELSE e - length(p) + length(regexp_replace(p, '\n\n+$', '')) END AS z, p FROM mo),
snt AS (SELECT doc_id, text, a, z, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM mt WHERE regexp_matches(p, '\S'))"""
_HAS = "(length(regexp_replace(coalesce(text, ''), '\\s', '', 'g')) > 0 OR len(list_filter(rows, lambda r: len(r.source_blocks) > 0 OR len(r.reading_order) > 0 OR (NOT bare AND (length(regexp_replace(coalesce(r.extraction.main_text, ''), '\\s', '', 'g')) > 0 OR len(r.extraction.tables) > 0 OR len(r.extraction.figures) > 0 OR len(r.extraction.formulas) > 0)))) > 0)"
_DAMAGED = f"""WITH {_P}, q AS (SELECT object_id, variant, variant = 'no_extraction' AS bare, CASE WHEN variant = 'zero_pages' THEN 0 ELSE metadata.page_count END AS pages, CASE WHEN variant = 'no_extraction' THEN 'hosted' ELSE metadata.backend END AS backend,
  CASE WHEN variant IN ('no_content', 'text_only') THEN rows[1:0] ELSE rows END AS rows, CASE variant WHEN 'no_content' THEN ' ' WHEN 'no_extraction' THEN NULL WHEN 'text_only' THEN 'x' ELSE text END AS text FROM p, (SELECT unnest({list(VARIANTS)}) AS variant)),
reasons AS (SELECT object_id, variant, 'zero_page_count' AS code, 'parsed.metadata.page_count' AS field, 'Parser returned page_count=0.' AS message FROM q WHERE pages = 0
UNION ALL SELECT object_id, variant, 'null_extraction', 'parsed.rows[].extraction', 'Hosted parser returned no extraction object.' FROM q WHERE backend = 'hosted' AND (bare OR len(list_filter(rows, lambda r: r.extraction IS NOT NULL)) = 0)
UNION ALL SELECT object_id, variant, 'empty_parsed_content', 'parsed', 'Parsed document has no text, structured row, or component.' FROM q WHERE NOT coalesce({_HAS}, false))
"""
# Paragraphs, of those above 800 characters their sentences, of those again pieces of 800; then runs of what may be packed, and packing by recursion.
_RECURSIVE = r"""WITH RECURSIVE pk AS (SELECT doc_id, text, string_split(regexp_replace(text, '(\n\n+)', '\1' || chr(1), 'g'), chr(1)) AS ps FROM documents),
pl AS (SELECT doc_id, text, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM pk), po AS (SELECT *, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) - length(p) AS a FROM pl),
par AS (SELECT doc_id, i, a, regexp_replace(p, '\n\n+$', '') AS p FROM po WHERE regexp_matches(p, '\S')),
sk AS (SELECT doc_id, i, a, string_split(regexp_replace(p, '([.!?。！？])(\s+)', '\1\2' || chr(1), 'g'), chr(1)) AS ss FROM par WHERE length(p) > 800),
sl AS (SELECT doc_id, i, a, unnest(ss) AS s, unnest(range(len(ss))) AS j FROM sk), so AS (SELECT *, a + sum(length(s)) OVER (PARTITION BY doc_id, i ORDER BY j) - length(s) AS b FROM sl),
sen AS (SELECT doc_id, i, j, b, CASE WHEN regexp_matches(s, '[.!?。！？]\s+$') THEN regexp_replace(s, '\s+$', '') ELSE s END AS s FROM so WHERE regexp_matches(s, '\S')),
atom AS (SELECT doc_id, i, -1 AS j, a, a + length(p) AS z, 'p' AS kind FROM par WHERE length(p) <= 800 UNION ALL SELECT doc_id, i, j, b, b + length(s), 's' || i FROM sen WHERE length(s) <= 800
  UNION ALL SELECT doc_id, i, j, b + k * 800, b + least((k + 1) * 800, length(s)), 'h' || i || '/' || j || '/' || k FROM sen, LATERAL (SELECT unnest(range(CAST(ceil(length(s) / 800.0) AS BIGINT))) AS k) WHERE length(s) > 800),
ord AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS n, kind = lag(kind) OVER (PARTITION BY doc_id ORDER BY a) AS same FROM atom),
walk AS (SELECT doc_id, n, a AS start, z AS "end", 0::BIGINT AS piece FROM ord WHERE n = 1
  UNION ALL SELECT o.doc_id, o.n, CASE WHEN o.same AND o.z - w.start <= 400 THEN w.start ELSE o.a END, o.z, CASE WHEN o.same AND o.z - w.start <= 400 THEN w.piece ELSE w.piece + 1 END FROM walk w JOIN ord o ON o.doc_id = w.doc_id AND o.n = w.n + 1)
SELECT doc_id, piece, CAST(min(start) AS BIGINT) AS start, CAST(max("end") AS BIGINT) AS "end" FROM walk GROUP BY doc_id, piece"""

SQL = {
    "doc_ids": "SELECT DISTINCT object_id, substr(sha1('data-object::' || uri), 1, 16) AS document_id, substr(sha1(object_id || '::initial-schema'), 1, 16) AS schema_id FROM data_objects",
    "validation_reasons": _DAMAGED + "SELECT object_id, variant, code, field, message FROM reasons",
    "quarantine_split": _DAMAGED + "SELECT variant, CASE WHEN EXISTS (SELECT 1 FROM reasons r WHERE r.object_id = q.object_id AND r.variant = q.variant) THEN 'quarantined' ELSE 'succeeded' END AS status, count(*) AS n FROM q GROUP BY ALL",
    "document_view": f"""WITH {_P} SELECT object_id AS source_object_id, list_filter([x.extraction.document_type FOR x IN rows], lambda v: length(v) > 0)[1] AS document_type, list_filter([x.extraction.language FOR x IN rows], lambda v: length(v) > 0)[1] AS language,
  list_filter([x.extraction.title FOR x IN rows], lambda v: length(v) > 0)[1] AS title, md5(coalesce(array_to_string(list_filter([x.extraction.main_text FOR x IN rows], lambda v: length(v) > 0), chr(10) || chr(10)), '')) AS main_text_md5,
  CAST(list_sum([len(x.extraction.tables) FOR x IN rows]) AS INT) AS tables, CAST(list_sum([len(x.extraction.figures) FOR x IN rows]) AS INT) AS figures, CAST(list_sum([len(x.extraction.formulas) FOR x IN rows]) AS INT) AS formulas, CAST(len(rows) AS INT) AS row_count FROM p""",
    "reading_order": f"""WITH {_P}, {_R}, {_B}, q AS (SELECT object_id, b, row_no * 1000000000 + block_no AS arrival, TRY_CAST(regexp_extract(b.component_id, '^/page/(\\d+)/([^/]+)/(\\d+)$', 1) AS INT) AS pg, TRY_CAST(regexp_extract(b.component_id, '^/page/(\\d+)/([^/]+)/(\\d+)$', 3) AS INT) AS ix FROM f1)
SELECT object_id, row_number() OVER (PARTITION BY object_id ORDER BY coalesce(pg, 1000000000), coalesce(ix, arrival), arrival) - 1 AS position, b.component_id AS component_id, b.type AS block_type FROM q""",
    "page_bounds": f"""WITH {_P}, {_R}, {_B}, q AS (SELECT object_id, coalesce(b.page, TRY_CAST(regexp_extract(b.component_id, '^/page/(\\d+)/', 1) AS INT)) AS page, {_BOX} AS x FROM b)
SELECT object_id, page, min(x[1]) AS x0, min(x[2]) AS y0, max(x[3]) AS x1, max(x[4]) AS y1, 'inferred_block_union' AS bounds_source FROM q WHERE page IS NOT NULL AND x IS NOT NULL GROUP BY ALL""",
    "figure_filter": f"""WITH {_P}, {_R}, {_B}, q AS (SELECT object_id, b.component_id AS ref, coalesce(b.page, TRY_CAST(regexp_extract(b.component_id, '^/page/(\\d+)/', 1) AS INT)) AS page, {_BOX} AS x FROM f1),
allb AS (SELECT object_id, coalesce(b.page, TRY_CAST(regexp_extract(b.component_id, '^/page/(\\d+)/', 1) AS INT)) AS page, {_BOX} AS x FROM b),
pb AS (SELECT object_id, page, (max(x[3]) - min(x[1])) * (max(x[4]) - min(x[2])) AS a FROM allb WHERE page IS NOT NULL AND x IS NOT NULL GROUP BY ALL),
fig AS (SELECT object_id, lower(source_format) AS fmt, row_no, unnest(range(len(r.extraction.figures))) AS fno, unnest(r.extraction.figures) AS f FROM r),
n AS (SELECT object_id, fmt, row_number() OVER (PARTITION BY object_id ORDER BY row_no, fno) - 1 AS original_index, trim(coalesce(f.source_ref, '')) AS ref, trim(coalesce(f.description, '')) AS d FROM fig),
j AS (SELECT n.*, q.x, pb.a, ((q.x[3] - q.x[1]) * (q.x[4] - q.x[2])) / pb.a AS ratio FROM n LEFT JOIN q ON q.object_id = n.object_id AND q.ref = n.ref LEFT JOIN pb ON pb.object_id = n.object_id AND pb.page = q.page),
w AS (SELECT *, fmt IN ('pdf','png','jpg','jpeg','gif','webp','tif','tiff') AND length(d) <= 120 AS short FROM j),
y AS (SELECT *, concat_ws(',', CASE WHEN ratio < 0.01 THEN 'below_min_page_area_ratio' END, CASE WHEN short AND regexp_matches(d, '(?i)\\blogo\\b') THEN 'short_ocr_logo_description' END, CASE WHEN short AND regexp_matches(d, '(?i)\\bicon\\b') THEN 'short_ocr_icon_description' END) AS reasons FROM w)
SELECT object_id, original_index, ref AS source_ref, round(ratio, 9) AS area_ratio, CASE WHEN x IS NULL THEN 'missing_or_invalid_bbox' WHEN a IS NULL THEN 'missing_or_invalid_page_area' END AS geometry_reason, length(d) AS description_length, reasons, reasons = '' AS kept FROM y""",
    "source_refs": f"""WITH {_P}, {_R}, u AS (SELECT object_id, row_no, unnest(range(len(r.extraction.main_text_citations))) AS k, trim(unnest(r.extraction.main_text_citations)) AS c FROM r), g AS (SELECT object_id, row_no, c, min(k) AS k FROM u WHERE c <> '' GROUP BY ALL)
SELECT object_id, row_no, row_number() OVER (PARTITION BY object_id, row_no ORDER BY k) - 1 AS n, c AS component_id, TRY_CAST(regexp_extract(c, '^/page/(\\d+)(?:/|$)', 1) AS INT) AS page, 'main_text' AS field FROM g""",
    "fixed_overlap_chunks": """WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '\\s*\\S+') AS pieces FROM documents), t AS (SELECT doc_id, text, unnest(pieces) AS p, unnest(range(1, len(pieces) + 1)) AS i, len(pieces) AS n FROM w),
s AS (SELECT doc_id, text, n, i, length(p) - length(regexp_replace(p, '^\\s+', '')) AS gap, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS z, length(p) AS len FROM t), q AS (SELECT *, z - len + gap AS a FROM s),
k AS (SELECT doc_id, piece FROM (SELECT doc_id, max(n) AS n FROM q GROUP BY doc_id), LATERAL (SELECT unnest(range(CAST(1 + greatest(0, ceil((n - 512) / 384.0)) AS BIGINT))) AS piece))
SELECT k.doc_id, k.piece, CAST(a.a AS BIGINT) AS start, CAST(b.z AS BIGINT) AS "end", md5(substr(a.text, CAST(a.a + 1 AS BIGINT), CAST(b.z - a.a AS BIGINT))) AS content_md5 FROM k JOIN q a ON a.doc_id = k.doc_id AND a.i = k.piece * 384 + 1 JOIN q b ON b.doc_id = k.doc_id AND b.i = least(k.piece * 384 + 512, b.n)""",
    "sentence_group_chunks": f"""WITH {_SENTENCES}, g AS (SELECT doc_id, text, CAST(floor((k - 1) / 5) AS BIGINT) AS piece, min(a) AS a, max(z) AS z FROM snt GROUP BY ALL)
SELECT doc_id, piece, CAST(a AS BIGINT) AS start, CAST(z AS BIGINT) AS "end", md5(substr(text, CAST(a + 1 AS BIGINT), CAST(z - a AS BIGINT))) AS content_md5 FROM g""",
    "source_fields": f"""WITH {_O}, x AS (SELECT object_id, uri, metadata AS m, lower(regexp_extract(uri, '[^./][^/]*\\.([^./]+)$', 1)) AS e, regexp_extract(uri, '([^/]*)$', 1) AS base FROM o)
SELECT object_id, coalesce(nullif(e, ''), 'unknown') AS format, CASE e WHEN 'pdf' THEN 'application/pdf' WHEN 'txt' THEN 'text/plain' WHEN 'md' THEN 'text/markdown' WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'tif' THEN 'image/tiff' WHEN 'json' THEN 'application/json' WHEN 'html' THEN 'text/html' WHEN 'csv' THEN 'text/csv'
  WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 'xlsx' THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' WHEN 'pptx' THEN 'application/vnd.openxmlformats-officedocument.presentationml.presentation' ELSE 'application/octet-stream' END AS type_by_name,
  regexp_replace(base, '[^A-Za-z0-9._-]+', '-', 'g') AS safe_name, nullif(regexp_extract(uri, '^s3://([^/?#]+)/[^?#]+$', 1), '') AS bucket, nullif(regexp_extract(uri, '^s3://[^/?#]+/([^?#]+)$', 1), '') AS key, nullif(trim(trim(m.s3_etag), '"'), '') AS etag,
  CASE WHEN m.size_bytes < 1024 THEN m.size_bytes || ' B' WHEN m.size_bytes < 1048576 THEN printf('%.1f KB', m.size_bytes / 1024.0) WHEN m.size_bytes < 1073741824 THEN printf('%.1f MB', m.size_bytes / 1048576.0) WHEN m.size_bytes IS NOT NULL THEN printf('%.1f GB', m.size_bytes / 1073741824.0) END AS size FROM x""",
    "route_by_extension": "WITH u AS (SELECT DISTINCT object_id, lower(regexp_extract(uri, '[^./][^/]*\\.([^./]+)$', 1)) AS e FROM data_objects) SELECT CASE WHEN e IN ('txt','md','json','jsonl','yaml','yml') THEN 'text' WHEN e = 'pptx' THEN 'presentation' WHEN e IN ('docx','doc') THEN 'word' WHEN e IN ('pdf','png','jpg','jpeg','gif','webp','tif','tiff') THEN 'document' WHEN e IN ('xlsx','xls') THEN 'spreadsheet_service' ELSE 'unsupported' END AS route, count(*) AS n FROM u GROUP BY ALL",
    "schema_inference": f"""WITH {_P}, q AS (SELECT *, list_filter([x.extraction.document_type FOR x IN rows], lambda v: length(v) > 0)[1] AS dt, list_filter([x.extraction.language FOR x IN rows], lambda v: length(v) > 0)[1] AS la, list_filter([x.extraction.title FOR x IN rows], lambda v: length(v) > 0)[1] AS ti,
  coalesce(array_to_string(list_filter([x.extraction.main_text FOR x IN rows], lambda v: length(v) > 0), chr(10)), '') || regexp_replace(coalesce(text, ''), '\\s', '', 'g') AS mt, CAST(list_sum([len(x.extraction.tables) FOR x IN rows]) AS INT) AS nt, CAST(list_sum([len(x.extraction.figures) FOR x IN rows]) AS INT) AS nf, CAST(list_sum([len(x.extraction.formulas) FOR x IN rows]) AS INT) AS nm FROM p)
SELECT substr(sha1(object_id || '::initial-schema'), 1, 16) AS schema_id, object_id AS source_object_id, CAST(len(rows) AS INT) AS row_count, nt AS table_count, nf AS figure_count, nm AS formula_count,
  concat_ws(',', CASE WHEN dt IS NOT NULL THEN 'document.document_type' END, CASE WHEN la IS NOT NULL THEN 'document.language' END, CASE WHEN ti IS NOT NULL THEN 'document.title' END, CASE WHEN mt <> '' THEN 'document.main_text' END, CASE WHEN nt > 0 THEN 'tables' END, CASE WHEN nf > 0 THEN 'figures' END, CASE WHEN nm > 0 THEN 'formulas' END) AS observed,
  concat_ws(',', CASE WHEN nt > 0 THEN 'has_table' END, CASE WHEN nf > 0 THEN 'has_figure' END, CASE WHEN nm > 0 THEN 'has_formula' END) AS relationships, 21 AS declared FROM q""",
    "stage_manifest": _DAMAGED + "SELECT 'ingestion' AS stage, count(*) AS document_count, count(*) FILTER (NOT bad) AS succeeded_count, count(*) FILTER (bad) AS other_count, count(DISTINCT object_id) AS distinct_count, 'stage-metadata-v1' AS contract_version FROM (SELECT object_id, (object_id, variant) IN (SELECT (object_id, variant) FROM reasons) AS bad FROM q)",
    "recursive_chunks": _RECURSIVE,
    "html_table_shapes": f"""WITH {_C}, t AS (SELECT chunk_id, text, string_split(regexp_replace(text, '<tr', chr(1), 'gi'), chr(1))[2:] AS rs FROM c WHERE chunk_type = 'table_chunk' AND text LIKE '<%'),
w AS (SELECT chunk_id, text, rs, list_max([list_sum([CAST(coalesce(nullif(regexp_extract(d, 'colspan=.?([0-9]+)', 1), ''), '1') AS BIGINT) FOR d IN regexp_extract_all(r, '(?i)<t[dh][^>]*>')]) FOR r IN rs]) AS width FROM t)
SELECT chunk_id, CASE WHEN len(rs) > 0 THEN CAST(len(rs) AS INT) END AS n_rows, CASE WHEN len(rs) > 0 THEN CAST(coalesce(width, 0) AS INT) END AS n_columns, CAST(len(regexp_extract_all(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')) AS INT) AS tokens, CAST(len(regexp_extract_all(text, '(?i)\\browspan\\s*=')) AS INT) AS rowspans FROM w""",
    "paragraph_chunks": r"""WITH s AS (SELECT doc_id, text, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS p, ps FROM (SELECT doc_id, text, string_split(regexp_replace(text, '

+', chr(1), 'g'), chr(1)) AS ps, regexp_extract_all(text, '

+') AS gs FROM documents)),
g AS (SELECT doc_id, unnest(range(1, len(gs) + 1)) AS i, unnest(gs) AS g FROM (SELECT doc_id, regexp_extract_all(text, '

+') AS gs FROM documents)),
q AS (SELECT s.doc_id, s.text, s.i, s.p, coalesce(sum(length(s.p) + coalesce(length(g.g), 0)) OVER (PARTITION BY s.doc_id ORDER BY s.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM s LEFT JOIN g ON g.doc_id = s.doc_id AND g.i = s.i)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS piece, CAST(a AS BIGINT) AS start, CAST(a + length(p) AS BIGINT) AS "end", md5(p) AS content_md5 FROM q WHERE regexp_matches(p, '\S')""",
    "table_groups": f"""WITH {_C}, l AS (SELECT chunk_id, text, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS x FROM (SELECT chunk_id, text, string_split(text, chr(10)) AS ls FROM c WHERE chunk_type = 'table_chunk' AND NOT text LIKE '<%')),
o AS (SELECT *, sum(length(x) + 1) OVER (PARTITION BY chunk_id ORDER BY i) - length(x) - 1 AS a FROM l), k AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY i) AS n FROM o WHERE regexp_matches(x, '\\S')),
h AS (SELECT chunk_id, max(CASE WHEN n = 2 AND regexp_full_match(x, '\\s*\\|?[\\s:|-]+\\|?\\s*') THEN 2 ELSE 1 END) AS head, count(*) AS total FROM k GROUP BY ALL),
e AS (SELECT chunk_id, max(a + length(x)) AS z FROM k JOIN h USING (chunk_id) WHERE n <= head GROUP BY ALL),
r AS (SELECT k.chunk_id, k.text, h.total - h.head AS body, CASE WHEN h.total - h.head <= 20 THEN 0 ELSE CAST(floor((n - head - 1) / 20) AS INT) END AS g, a, a + length(x) AS z FROM k JOIN h USING (chunk_id) WHERE n > head),
s AS (SELECT chunk_id, text, body, g, count(*) AS n_rows, min(a) AS a, max(z) AS z FROM r GROUP BY ALL)
SELECT chunk_id, g AS row_group, CAST(n_rows AS INT) AS n_rows, CAST(CASE WHEN body <= 20 THEN 0 ELSE a END AS BIGINT) AS start, CAST(CASE WHEN body <= 20 THEN length(text) ELSE s.z END AS BIGINT) AS "end", md5(CASE WHEN body <= 20 THEN text ELSE substr(text, 1, CAST(e.z AS BIGINT)) || chr(10) || substr(text, CAST(a + 1 AS BIGINT), CAST(s.z - a AS BIGINT)) END) AS text_md5 FROM s JOIN e USING (chunk_id)
UNION ALL SELECT c.chunk_id, 0, 0, 0, length(c.text), md5(c.text) FROM c LEFT JOIN h USING (chunk_id) WHERE chunk_type = 'table_chunk' AND NOT c.text LIKE '<%' AND coalesce(total - head, 0) = 0""",
    "chunk_quality": """WITH w AS (SELECT doc_id, text, length(text) AS fc, regexp_extract_all(text, '\\s*\\S+') AS ps FROM documents), t AS (SELECT doc_id, text, fc, unnest(ps) AS p, unnest(range(0, len(ps))) AS i FROM w), o AS (SELECT *, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS z FROM t),
s AS (SELECT doc_id, text, fc, CAST(min(z - length(p) + length(p) - length(regexp_replace(p, '^\\s+', ''))) AS BIGINT) AS a, CAST(max(z) AS BIGINT) AS z FROM (SELECT *, i // 128 AS k FROM o) GROUP BY doc_id, text, fc, k), q AS (SELECT z - a AS n, substr(text, z, 1) AS last, z < fc AS inner_end FROM s), r AS (SELECT *, row_number() OVER (ORDER BY n) - 1 AS place, count(*) OVER () AS total FROM q)
SELECT count(*) AS chunks, round(avg(n), 1) AS chars_mean, CAST(max(n) FILTER (place = least(total - 1, CAST(floor((total - 1) * 0.9 + 0.5) AS BIGINT))) AS DOUBLE) AS chars_p90, round(count(*) FILTER (inner_end AND position(last IN '.!?。！？:"'')') = 0) / count(*), 4) AS mid_sentence_end_rate FROM r""",
    "term_frequency": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK.format('text')}) AS term FROM documents) GROUP BY ALL",
    "corpus_stats": f"WITH {_C} SELECT config_hash, count(*) AS n_items, round(sum(n) / count(*), 6) AS avgdl FROM (SELECT config_hash, len({_TOK.format('text')}) AS n FROM c) WHERE n > 0 GROUP BY ALL",
    "document_frequency": f"SELECT source, term, count(DISTINCT doc_id) AS df FROM (SELECT source, doc_id, unnest({_TOK.format('text')}) AS term FROM documents) GROUP BY ALL",
    "vector_norms": "SELECT vec_id, round(sqrt(list_sum([CAST(x AS DOUBLE) * x FOR x IN embedding])), 6) AS norm FROM embeddings",
    "token_estimate": "SELECT doc_id, greatest(1, CAST(floor(length(text) * 0.5) AS INT) + 1) AS tokens, least(length(text), 24000) AS kept_chars FROM documents",
    "counts_by_type": f"WITH {_C} SELECT CASE chunk_type WHEN 'table_chunk' THEN 'table' WHEN 'figure_chunk' THEN 'image' ELSE 'text_chunk' END AS retrieval_type, count(*) AS n FROM c GROUP BY ALL",
    "embedding_texts": f"WITH {_C} SELECT chunk_id, md5(CASE WHEN length(metadata.caption) > 0 AND NOT contains(text, metadata.caption) THEN metadata.caption || chr(10) || text ELSE text END) AS text_md5 FROM c",
    "skip_existing": "WITH d AS (SELECT DISTINCT doc_id, config_hash FROM chunks), h AS (SELECT DISTINCT config_hash FROM chunks), o AS (SELECT DISTINCT object_id FROM data_objects) SELECT h.config_hash, count(*) AS n FROM o, h WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id = o.object_id AND d.config_hash = h.config_hash) GROUP BY ALL",
    "skipped_count": "SELECT count(DISTINCT object_id) AS skipped_existing FROM data_objects WHERE object_id IN (SELECT doc_id FROM chunks)",
    "missing_documents": "SELECT DISTINCT object_id AS source_object_id FROM data_objects WHERE object_id NOT IN (SELECT source_object_id FROM vector_records WHERE embedding_status IN ('embedded', 'failed'))",
    "chunk_vectors": "WITH c AS (SELECT DISTINCT chunk_id, doc_id FROM chunks), v AS (SELECT DISTINCT record_id, source_object_id, embedding_model FROM vector_records), j AS (SELECT c.chunk_id, count(v.record_id) AS vectors FROM c LEFT JOIN v ON v.record_id = c.chunk_id AND v.source_object_id = c.doc_id GROUP BY ALL) SELECT vectors, count(*) AS chunks FROM j GROUP BY ALL",
    "request_order": "WITH a AS (SELECT source_uri, response_id AS asked, row_number() OVER (PARTITION BY source_uri ORDER BY received_at, response_id, loaded_at) AS k FROM workbook_responses), b AS (SELECT source_uri, response_id AS answered, row_number() OVER (PARTITION BY source_uri ORDER BY job_id NULLS FIRST, response_id, loaded_at) AS k FROM workbook_responses) SELECT source_uri, asked, answered FROM a JOIN b USING (source_uri, k)",
    "document_identity": f"WITH {_O}, {_V} SELECT o.object_id AS document_id, o.metadata.file_name AS file_name, o.metadata.size_bytes AS size_bytes, v.title, v.language, o.metadata.s3_bucket AS bucket, nullif(trim(trim(o.metadata.s3_etag), '\"'), '') AS etag FROM o LEFT JOIN v ON v.source_object_id = o.object_id",
    "markdown_rows": f"WITH {_C}, l AS (SELECT chunk_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')) AS ls FROM c WHERE chunk_type = 'table_chunk' AND NOT text LIKE '<%') SELECT chunk_id, len(ls) AS lines, CASE WHEN len(ls) = 0 THEN 0 WHEN len(ls) > 1 AND regexp_full_match(ls[2], '\\s*\\|?[\\s:|-]+\\|?\\s*') THEN 2 ELSE 1 END AS header_lines FROM l",
    "table_guard": f"WITH {_C}, t AS (SELECT doc_id, chunk_type = 'table_chunk' AS a, unnest({_TOK.format('text')}) AS token FROM c WHERE chunk_type IN ('table_chunk', 'text_chunk')), g AS (SELECT doc_id, token, count(*) FILTER (a) AS x, count(*) FILTER (NOT a) AS y FROM t GROUP BY ALL) SELECT doc_id, CAST(sum(least(x, y)) AS BIGINT) AS overlap, CASE WHEN sum(y) > 0 THEN round(sum(least(x, y)) / sum(y), 9) END AS precision_, CASE WHEN sum(x) > 0 THEN round(sum(least(x, y)) / sum(x), 9) END AS recall_ FROM g GROUP BY ALL",
    "table_markdown": "SELECT n_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY ALL",
    "json_props": "SELECT event_id, TRY_CAST(json_extract_string(CASE WHEN json_valid(props) THEN props END, '$.k') AS INT) AS k FROM events",
    "component_boxes": f"WITH {_P}, {_R}, {_B}, q AS (SELECT object_id, b.component_id AS component_id, {_BOX} AS x FROM f1) SELECT object_id, component_id, round((x[3] - x[1]) * (x[4] - x[2]), 6) AS area, printf('%.5f', x[1] / 640.0 * 100.0) AS left_pc, printf('%.5f', (x[3] - x[1]) / 640.0 * 100.0) AS width_pc, greatest(1536, CAST(ceil(x[4] / 128) * 128 AS INT)) AS edge FROM q WHERE x IS NOT NULL",
    "document_search": f"WITH {_V} SELECT source_object_id, title FROM v WHERE contains(lower(concat_ws(' ', source_uri, title, source_object_id)), 'table summary')",
    "cell_normalize": "SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ';' || CASE WHEN l_discount = floor(l_discount) THEN CAST(CAST(l_discount AS BIGINT) AS VARCHAR) ELSE CAST(l_discount AS VARCHAR) END || ';' || CASE WHEN CAST(l_shipdate AS TIME) = TIME '00:00:00' THEN strftime(l_shipdate, '%Y-%m-%d') ELSE strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') END || ';' || l_returnflag AS cells FROM lineitem",
    "hash_embedding": """WITH t AS (SELECT doc_id, CASE WHEN regexp_matches(text, '\\S') THEN substr(text, 1, 24000) ELSE ' ' END AS s FROM documents), h AS (SELECT doc_id, sha256('0:' || s) || sha256('1:' || s) AS x FROM t), b AS (SELECT doc_id, k, CAST('0x' || substr(x, k * 2 + 1, 2) AS INT) / 127.5 - 1.0 AS v FROM h, LATERAL (SELECT unnest(range(64)) AS k)), n AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM b GROUP BY ALL) SELECT b.doc_id, b.k, round(v / n, 6) AS value FROM b JOIN n USING (doc_id)""",
}

_PAGE1 = "CASE WHEN len(list_distinct(list_filter([TRY_CAST(regexp_extract(q, '^/page/(\\d+)/', 1) AS INT) FOR q IN {c}], lambda v: v IS NOT NULL))) = 1 THEN list_distinct(list_filter([TRY_CAST(regexp_extract(q, '^/page/(\\d+)/', 1) AS INT) FOR q IN {c}], lambda v: v IS NOT NULL))[1] END"
_S = "regexp_replace(regexp_replace(coalesce({}, ''), '^\\s+', ''), '\\s+$', '')"
_CHUNKS = f"""WITH {_P}, e AS (SELECT object_id AS doc_id, rows[1].extraction AS x FROM p WHERE rows[1].extraction IS NOT NULL),
m AS (SELECT doc_id, x.main_text AS text, {_PAGE1.format(c='x.main_text_citations')} AS page, regexp_extract_all(x.main_text, '\\s*\\S+') AS ps FROM e WHERE regexp_matches(x.main_text, '\\S')),
mw AS (SELECT doc_id, text, page, len(ps) AS n, unnest(ps) AS w, unnest(range(1, len(ps) + 1)) AS i FROM m), mo AS (SELECT *, sum(length(w)) OVER (PARTITION BY doc_id ORDER BY i) AS z FROM mw), mq AS (SELECT doc_id, text, page, n, i, z - length(regexp_replace(w, '^\\s+', '')) AS a, z FROM mo),
mk AS (SELECT doc_id, piece FROM (SELECT doc_id, max(n) AS n FROM mq GROUP BY doc_id), LATERAL (SELECT unnest(range(CAST(1 + greatest(0, ceil((n - 512) / 384.0)) AS BIGINT))) AS piece)),
mc AS (SELECT mk.doc_id, 0 AS route, 0 AS fi, mk.piece, 'main_text' AS path, 'text_chunk' AS kind, 'main_text' AS comp, substr(a.text, CAST(a.a + 1 AS BIGINT), CAST(b.z - a.a AS BIGINT)) AS content, CAST(a.a AS BIGINT) AS s, CAST(b.z AS BIGINT) AS t, a.page, length(a.text) AS fc, NULL AS caption FROM mk JOIN mq a ON a.doc_id = mk.doc_id AND a.i = mk.piece * 384 + 1 JOIN mq b ON b.doc_id = mk.doc_id AND b.i = least(mk.piece * 384 + 512, b.n)),
tu AS (SELECT doc_id, unnest(range(len(x.tables))) AS fi, unnest(x.tables) AS t FROM e), tt AS (SELECT doc_id, fi, t.content AS text, nullif({_S.format('t.caption')}, '') AS caption, CASE WHEN len(t.content_citations) > 0 THEN {_PAGE1.format(c='t.content_citations')} ELSE {_PAGE1.format(c='t.caption_citations')} END AS page FROM tu WHERE regexp_matches(t.content, '\\S')),
tl AS (SELECT doc_id, fi, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS x FROM (SELECT doc_id, fi, string_split(text, chr(10)) AS ls FROM tt)), tp AS (SELECT *, sum(length(x) + 1) OVER (PARTITION BY doc_id, fi ORDER BY i) - length(x) - 1 AS a FROM tl), tk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, fi ORDER BY i) AS n FROM tp WHERE regexp_matches(x, '\\S')),
th AS (SELECT doc_id, fi, max(CASE WHEN n = 2 AND regexp_full_match(x, '\\s*\\|?[\\s:|-]+\\|?\\s*') THEN 2 ELSE 1 END) AS head, count(*) AS total FROM tk GROUP BY ALL), te AS (SELECT doc_id, fi, max(a + length(x)) AS hz FROM tk JOIN th USING (doc_id, fi) WHERE n <= head GROUP BY ALL),
tg AS (SELECT doc_id, fi, CAST(floor((n - head - 1) / 20) AS BIGINT) AS g, min(a) AS a, max(a + length(x)) AS z FROM tk JOIN th USING (doc_id, fi) WHERE n > head AND total - head > 20 GROUP BY ALL),
tc AS (SELECT doc_id, 1 AS route, fi, g AS piece, 'tables[' || fi || ']' AS path, 'table_chunk' AS kind, 'table' AS comp, substr(text, 1, CAST(hz AS BIGINT)) || chr(10) || substr(text, CAST(a + 1 AS BIGINT), CAST(z - a AS BIGINT)) AS content, CAST(a AS BIGINT) AS s, CAST(z AS BIGINT) AS t, page, length(text) AS fc, caption FROM tg JOIN te USING (doc_id, fi) JOIN tt USING (doc_id, fi)
  UNION ALL SELECT doc_id, 1, fi, 0, 'tables[' || fi || ']', 'table_chunk', 'table', text, 0, length(text), page, length(text), caption FROM tt JOIN th USING (doc_id, fi) WHERE total - head <= 20),
fu AS (SELECT doc_id, unnest(range(len(x.figures))) AS fi, unnest(x.figures) AS f FROM e), fx AS (SELECT doc_id, fi, concat_ws(chr(10) || chr(10), nullif({_S.format('f.caption')}, ''), nullif({_S.format('f.description')}, '')) AS content FROM fu),
fc AS (SELECT doc_id, 2 AS route, fi, 0 AS piece, 'figures[' || fi || ']' AS path, 'figure_chunk' AS kind, 'figure' AS comp, content, 0 AS s, length(content) AS t, NULL::INT AS page, length(content) AS fc, NULL AS caption FROM fx WHERE content <> ''),
ou AS (SELECT doc_id, unnest(range(len(x.formulas))) AS fi, unnest(x.formulas) AS content FROM e), oc AS (SELECT doc_id, 3 AS route, fi, 0 AS piece, 'formulas[' || fi || ']' AS path, 'text_chunk' AS kind, 'formula' AS comp, content, 0 AS s, length(content) AS t, NULL::INT AS page, length(content) AS fc, NULL AS caption FROM ou WHERE regexp_matches(content, '\\S')),
ch AS (SELECT *, sha256(doc_id || path || s || ':' || t) AS id FROM (SELECT * FROM mc UNION ALL SELECT * FROM tc UNION ALL SELECT * FROM fc UNION ALL SELECT * FROM oc))
"""
SQL["document_chunks"] = _CHUNKS + 'SELECT id AS chunk_id, doc_id, path AS field_path, kind AS chunk_type, comp AS component_type, s AS start, t AS "end", page, fc AS field_chars, md5(content) AS content_md5 FROM ch'
SQL["retrieval_items"] = _CHUNKS + f""", ix AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY route, fi, piece) - 1 AS k, {_TOK.format("CASE WHEN kind = 'text_chunk' THEN content ELSE concat_ws(chr(10), content, caption) END")} AS tk FROM ch)
SELECT id AS record_id, doc_id AS source_object_id, CASE kind WHEN 'table_chunk' THEN 'table' WHEN 'figure_chunk' THEN 'image' ELSE 'text_chunk' END AS retrieval_type, CASE kind WHEN 'table_chunk' THEN 'table' WHEN 'figure_chunk' THEN 'image' ELSE 'text' END AS item_type, comp AS component_type,
CAST(CASE WHEN kind = 'text_chunk' THEN k ELSE fi END AS INT) AS position_index, CASE WHEN len(tk) > 0 THEN CAST(len(tk) AS INT) END AS dl, list_sort(tk)[1] AS first_term, CASE WHEN len(tk) > 0 THEN CAST(len(list_distinct(tk)) AS INT) END AS terms FROM ix"""
SQL["retrieval_vectors"] = _CHUNKS + """, tx AS (SELECT id, CASE WHEN caption <> '' AND NOT contains(content, caption) THEN caption || chr(10) || content ELSE content END AS s0 FROM ch), t AS (SELECT id, CASE WHEN regexp_matches(s0, '\\S') THEN substr(s0, 1, 24000) ELSE ' ' END AS x FROM tx), h AS (SELECT id, sha256('0:' || x) || sha256('1:' || x) AS x FROM t), b AS (SELECT id, k, CAST('0x' || substr(x, k * 2 + 1, 2) AS INT) / 127.5 - 1.0 AS v FROM h, LATERAL (SELECT unnest(range(64)) AS k)), n AS (SELECT id, sqrt(sum(v * v)) AS n FROM b GROUP BY ALL)
SELECT b.id AS record_id, 64 AS dimension, round(v / n, 6) AS first_value, 1 AS n FROM b JOIN n USING (id) WHERE k = 0"""
_STAGE = f"""{_CHUNKS}, so AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY loaded_at DESC) AS rn FROM data_objects) WHERE rn = 1),
sv AS (SELECT *, CASE WHEN text IS NULL THEN [] ELSE rows END AS rs, NOT coalesce(length(regexp_replace(text, '\\s', '', 'g')) > 0 OR (text IS NOT NULL AND len(list_filter(rows, lambda r: len(r.source_blocks) > 0 OR len(r.reading_order) > 0 OR length(regexp_replace(coalesce(r.extraction.main_text, ''), '\\s', '', 'g')) > 0 OR len(r.extraction.tables) > 0 OR len(r.extraction.figures) > 0 OR len(r.extraction.formulas) > 0)) > 0), false) AS bad FROM p),
sj AS (SELECT so.object_id AS id, so.uri, sv.text, len(sv.rs) AS n_rows, coalesce(bad, false) AS bad, sv.object_id IS NOT NULL AS there, sv.metadata.backend AS backend FROM so LEFT JOIN sv USING (object_id) UNION ALL SELECT sv.object_id, NULL, sv.text, len(sv.rs), true, true, sv.metadata.backend FROM sv WHERE bad AND object_id NOT IN (SELECT object_id FROM so)),
"""
SQL["ingested_stage"] = _STAGE + "z AS (SELECT 1) SELECT id AS document_id, 'ingested-document-v2' AS contract_version, CASE WHEN bad THEN 'quarantined' ELSE 'succeeded' END AS status, uri, md5(text) AS text_md5, CAST(n_rows AS INT) AS rows, CASE WHEN there AND NOT bad THEN substr(sha1(id || '::initial-schema'), 1, 16) END AS schema_id, CASE WHEN bad THEN 'quarantined' END AS disposition, CASE WHEN bad THEN concat_ws(',', CASE WHEN backend = 'hosted' THEN 'null_extraction' END, 'empty_parsed_content') END AS codes FROM sj"
SQL["stage_progress"] = _STAGE + "z AS (SELECT 1) SELECT 'completed' AS status, count(*) AS processed_document_count, count(*) AS expected_document_count, count(*) FILTER (NOT bad) AS succeeded_document_count, count(*) FILTER (bad) AS quarantined_document_count FROM sj"
SQL["output_stage"] = _STAGE + f"""ti AS (SELECT doc_id, {_TOK.format("CASE WHEN kind = 'text_chunk' THEN content ELSE concat_ws(chr(10), content, caption) END")} AS tk FROM ch), tt2 AS (SELECT doc_id, count(*) AS items, count(*) FILTER (len(tk) > 0) AS n, coalesce(round(sum(len(tk)) / nullif(count(*) FILTER (len(tk) > 0), 0), 6), 0) AS a FROM ti GROUP BY ALL),
tv AS (SELECT object_id, list_filter([x.extraction.title FOR x IN rs], lambda v: length(v) > 0)[1] AS title FROM sv)
SELECT id AS document_id, title, uri, md5(text) AS text_md5, CAST(n_rows AS INT) AS row_count, substr(sha1(id || '::cleaned-schema'), 1, 16) AS clean_schema, substr(sha1(id || '::enriched-schema'), 1, 16) AS enrich_schema, coalesce(items, 0) AS items, n AS N, a AS avgdl FROM sj JOIN tv ON tv.object_id = id LEFT JOIN tt2 ON tt2.doc_id = id WHERE there AND NOT bad AND uri IS NOT NULL"""
