"""Layout blocks: reading order, page bounds, and the figure filter."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import geometry as G
from quire.functions import text as X

NATIVE_SOURCE, CITED_SOURCE = "parser_json", "structured_extraction_citations"  # fixed values
LAST = 10**9


def blocks(parsed: DataFrame) -> DataFrame:
    """Blocks of all rows of each document with their arrival number."""
    r = parsed.select("object_id", F.posexplode("rows").alias("row_no", "row")).select("object_id", "row_no", F.posexplode("row.source_blocks").alias("block_no", "b"))
    return r.select("object_id", (F.col("row_no").cast("long") * LAST + F.col("block_no")).alias("arrival"), "row_no", "b.*")


def first_by_component(b: DataFrame) -> DataFrame:
    """Blocks with a component id, each once: the first to arrive."""
    w = W.partitionBy("object_id", "component_id").orderBy("arrival")
    return b.filter(F.length("component_id") > 0).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def reading_order(b: DataFrame) -> DataFrame:
    """Blocks in order of page, block and arrival as their component paths say; other ids last. position counts from 0."""
    one = first_by_component(b).withColumn("_p", X.path_parts(F.col("component_id")))
    w = W.partitionBy("object_id").orderBy(F.coalesce("_p.page", F.lit(LAST)), F.coalesce(F.col("_p.index").cast("long"), F.col("arrival")), "arrival")
    return one.withColumn("position", F.row_number().over(w) - 1).drop("_p")


def provenance(b: DataFrame) -> DataFrame:
    """Source of each document's order: native only if every block of every row is."""
    return b.groupBy("object_id").agg(F.count_distinct("component_id").alias("block_count"), F.bool_and(F.coalesce(F.col("source") == NATIVE_SOURCE, F.lit(False))).alias("complete")).withColumn("source", F.when(F.col("complete"), NATIVE_SOURCE).otherwise(CITED_SOURCE)) if "source" in b.columns else b.groupBy("object_id").agg(F.count_distinct("component_id").alias("block_count"))


def cited_blocks(docs: DataFrame) -> DataFrame:
    """Blocks rebuilt from citations: paragraphs zipped with main-text citations if there are as many, then figures, tables, title."""
    p, c = X.paragraphs(F.col("main_text")), X.citations(F.col("main_text_citations"))
    pairs = F.when(F.size(p) == F.size(c), F.arrays_zip(c.alias("component_id"), p.alias("text"))).otherwise(F.array())
    main = docs.select("object_id", F.posexplode(pairs).alias("n", "x")).select("object_id", F.lit(0).alias("k"), "n", F.col("x.component_id").alias("component_id"), F.col("x.text").alias("text"))
    t = docs.select("object_id", F.posexplode("tables").alias("n", "t"))
    parts = [t.select("object_id", F.lit(k).alias("k"), "n", F.explode(X.citations(F.col(f"t.{f}_citations"))).alias("component_id"), F.col(f"t.{f}").alias("text")).filter(F.length("text") > 0) for k, f in ((2, "caption"), (3, "content"))]
    every = main
    for x in parts:
        every = every.unionByName(x)
    return every.withColumn("_p", X.path_parts(F.col("component_id"))).filter("_p.page is not null").select("object_id", (F.col("k").cast("long") * LAST + F.col("n")).alias("arrival"), "component_id", F.col("_p.page").alias("page"), F.col("_p.index").alias("block_index"), F.col("_p.type").alias("type"), "text", F.lit(CITED_SOURCE).alias("source"))


def merged_blocks(native: DataFrame, cited: DataFrame) -> DataFrame:
    """Native blocks with the text cited for them where they have none; cited blocks that no native one has are appended."""
    c = first_by_component(cited).select("object_id", "component_id", F.col("text").alias("cited_text"))
    kept = native.join(c, ["object_id", "component_id"], "left").withColumn("text", F.coalesce(X.text_or_null(F.col("text")), "cited_text")).drop("cited_text")
    more = cited.join(native.select("object_id", "component_id"), ["object_id", "component_id"], "left_anti").withColumn("arrival", F.col("arrival") + LAST * LAST // 4)
    return kept.unionByName(more, allowMissingColumns=True)


def page_bounds(b: DataFrame) -> DataFrame:
    """Bounds of each page: the union of explicit page boxes if there are any, else of the blocks."""
    rows = b.withColumn("_page", G.page_number(F.col("page"), F.col("component_id"))).filter("_page is not null")
    explicit = G.union_agg(F.col("page_bbox")) if "page_bbox" in b.columns else F.max(F.lit(None).cast("array<double>"))
    g = rows.groupBy("object_id", F.col("_page").alias("page")).agg(explicit.alias("e"), G.union_agg(F.col("bbox")).alias("i"))
    return g.filter("e is not null or i is not null").select("object_id", "page", F.coalesce("e", "i").alias("bounds"), F.when(F.col("e").isNotNull(), "page_bbox").otherwise("inferred_block_union").alias("bounds_source"))


# Fixed values of the figure filter.
MIN_AREA_RATIO, MAX_LOGO_CHARS = 0.01, 120
OCR_FORMATS = ["pdf", "png", "jpg", "jpeg", "gif", "webp", "tif", "tiff"]


def source_ref(figure: Column, kind: T.StructType) -> Column:
    """The block a figure stands in: the first citation of its description, else of its caption, else source_ref, else the first of
    source_refs (paths, or objects with a component_id); '' if none says any. kind: what a figure may hold."""
    has = {f.name: f.dataType for f in kind}

    def first(name: str) -> Column:
        paths = F.coalesce(figure[name], F.array().cast(has[name]))
        if isinstance(has[name].elementType, T.StructType):
            paths = F.transform(paths, lambda x: x["component_id"])
        return F.try_element_at(X.citations(paths), F.lit(1))

    found = [first(n) for n in ("description_citations", "caption_citations") if n in has]
    found += [X.stripped_or_null(figure["source_ref"])] if "source_ref" in has else []
    found += [first("source_refs")] if "source_refs" in has else []
    return F.coalesce(*found, F.lit(""))


def figures(parsed: DataFrame) -> DataFrame:
    """Figures of all rows with their number in the document and the reference to their block."""
    kind = parsed.schema["rows"].dataType.elementType["extraction"].dataType["figures"].dataType.elementType
    f = parsed.select("object_id", F.lower("source_format").alias("source_format"), F.posexplode("rows").alias("row_no", "row")).select("object_id", "source_format", "row_no", F.posexplode("row.extraction.figures").alias("figure_no", "f"))
    n = F.row_number().over(W.partitionBy("object_id").orderBy("row_no", "figure_no")) - 1
    return f.select("object_id", "source_format", n.alias("original_index"), "row_no", "figure_no", source_ref(F.col("f"), kind).alias("source_ref"), X.strip(F.coalesce("f.description", F.lit(""))).alias("description"), F.col("f.caption").alias("caption"))


def figure_filter(figs: DataFrame, b: DataFrame) -> DataFrame:
    """Every figure with its share of the page, the reasons to drop it and whether it is kept."""
    at = first_by_component(b).select("object_id", F.col("component_id").alias("source_ref"), G.box(F.col("bbox")).alias("box"), G.page_number(F.col("page"), F.col("component_id")).alias("page"))
    j = figs.join(at, ["object_id", "source_ref"], "left").join(page_bounds(b), ["object_id", "page"], "left")
    ratio = G.area(F.col("box")) / G.area(F.col("bounds"))
    short = F.col("source_format").isin(OCR_FORMATS) & (F.length("description") <= MAX_LOGO_CHARS)
    why = F.array_compact(F.array(F.when(ratio < MIN_AREA_RATIO, "below_min_page_area_ratio"), *[F.when(short & F.col("description").rlike(rf"(?i)\b{k}\b"), f"short_ocr_{k}_description") for k in ("logo", "icon")]))
    gap = F.when(F.col("box").isNull(), "missing_or_invalid_bbox").when(F.col("bounds").isNull(), "missing_or_invalid_page_area")
    return j.select("object_id", "original_index", "source_ref", ratio.alias("area_ratio"), gap.alias("geometry_reason"), F.col("bounds_source").alias("page_area_source"), F.length("description").alias("description_length"), why.alias("reasons"), (F.size(why) == 0).alias("kept"))


def filter_report(filtered: DataFrame) -> DataFrame:
    return filtered.groupBy("object_id").agg(F.count("*").alias("before_count"), F.count_if("kept").alias("kept_count"), F.count_if(~F.col("kept")).alias("dropped_count"), F.count_if(F.col("geometry_reason").isNotNull()).alias("geometry_unavailable_count"))


def match_assets(figs: DataFrame, assets: DataFrame) -> DataFrame:
    """Figures with the asset each gets: the first unused one of its reference, else, if there are as many of both, the unused one at its place.

    figs: object_id, original_index, source_ref; assets: object_id, asset_index, source_ref. A document's figures are matched in order,
    in one group, since each match takes an asset from the next; groups are single documents.
    """
    f = figs.groupBy("object_id").agg(F.sort_array(F.collect_list(F.struct("original_index", "source_ref"))).alias("figs"))
    a = assets.groupBy("object_id").agg(F.sort_array(F.collect_list(F.struct("asset_index", "source_ref"))).alias("assets"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, fs, xs in zip(*(c.to_pylist() for c in b.columns)):
                xs, used = xs or [], set()
                for fig in fs:
                    ref = (fig["source_ref"] or "").strip()
                    got = next((x["asset_index"] for x in xs if ref and (x["source_ref"] or "").strip() == ref and x["asset_index"] not in used), None)
                    place = fig["original_index"]
                    if got is None and len(xs) == len(fs) and place < len(xs) and place not in used:
                        got = place
                    used.add(got)
                    out.append((doc, place, got))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.int32()))], names=["object_id", "original_index", "asset_index"])

    return f.join(a, "object_id", "left").select(F.col("object_id").cast("string"), "figs", "assets").mapInArrow(run, "object_id string, original_index int, asset_index int")


_MARKDOWN_IMAGE = re.compile(r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)")


def markdown_images(text: Column) -> Column:
    """Images of a Markdown text: structs alt, target."""
    p = r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)"
    return F.transform(F.arrays_zip(F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(p), F.lit(2)).alias("t")), lambda x: F.struct(x["a"].alias("alt"), x["t"].alias("target")))


def rewrite_images(text: Column, names: Column) -> Column:
    """Image targets replaced by a map of old to new names."""
    return F.aggregate(F.map_entries(names), text, lambda t, e: F.replace(t, F.concat(F.lit("]("), e["key"]), F.concat(F.lit("]("), e["value"])))


def captions(b: DataFrame, types: list[str], caption_type: str = "Caption") -> DataFrame:
    """Blocks of the types with the text of the caption next to them on their page (the one after first), each caption used once."""
    w = W.partitionBy("object_id", "page").orderBy("block_index", "component_id")
    near = b.select("object_id", "page", "component_id", "type", "text", *[F.struct(f(c, 1).over(w).alias("v")).alias(n) for n, f, c in (("nt", F.lead, "type"), ("nx", F.lead, "text"), ("ni", F.lead, "component_id"), ("pt", F.lag, "type"), ("px", F.lag, "text"), ("pi", F.lag, "component_id"))])
    want = near.filter(F.col("type").isin(types)).select("object_id", "page", "component_id", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("nt.v").alias("t"), F.col("nx.v").alias("x"), F.col("ni.v").alias("i")), F.struct(F.lit(1).alias("rank"), F.col("pt.v").alias("t"), F.col("px.v").alias("x"), F.col("pi.v").alias("i")))).alias("c")).filter(F.col("c.t") == caption_type)
    once = want.withColumn("_n", F.row_number().over(W.partitionBy("object_id", "c.i").orderBy("c.rank", "component_id"))).filter("_n = 1")
    best = once.withColumn("_m", F.row_number().over(W.partitionBy("object_id", "component_id").orderBy("c.rank"))).filter("_m = 1")
    return best.select("object_id", "component_id", F.col("c.x").alias("caption"), F.col("c.i").alias("caption_id"))


_COMPONENT = re.compile(r"/page/(\d+)/([^/]+)/(\d+)")
_TAGS = re.compile(r"<!--.*?-->|<[^>]*>", re.S)


class _Found(list):
    """Components found within an object, itself first."""


def _within(values) -> _Found:
    return _Found(c for v in values if isinstance(v, list) for c in (v if isinstance(v, _Found) else _within(v)))


def _component(node: dict) -> _Found:
    """What one object of the tree comes to, once all objects within it have come to theirs: the components of its part of the tree.

    A page hands its box down to the components within it that have none from a nearer page.
    """
    inner = _within(node.values())
    name = next((x for x in (node.get("id"), node.get("component_id")) if x), None)
    path = _COMPONENT.fullmatch(name) if isinstance(name, str) else None
    kind = next((str(x) for x in (node.get("block_type"), node.get("type")) if x), path[2] if path else "")
    box, sort = node.get("bbox"), kind.casefold()
    if sort == "page" and isinstance(box, list) and len(box) == 4:
        for c in inner:
            c["page_bbox"] = c["page_bbox"] or box
    if not path or sort in ("page", "document"):
        return inner
    texts = [v.strip() for v in (node.get(k) for k in ("text", "raw_text", "markdown", "content")) if isinstance(v, str)]
    markup = node.get("html") if isinstance(node.get("html"), str) else ""
    rest = " ".join(x for x in (html.unescape(t).strip() for t in _TAGS.split(markup)) if x)
    own = {"component_id": name, "page": int(path[1]), "block_index": int(path[3]), "type": kind, "text": next(filter(None, texts), rest), "bbox": box, "page_bbox": None}
    return _Found([own, *inner])


def walk_blocks(document: object) -> list[dict]:
    """Components of a parser's JSON tree (an object or its text) in the order found, with the box of the page they stand in.

    The tree is folded from its leaves up while it is read; text that is no JSON, or nested too deeply to be read, has none.
    """
    try:
        tree = json.loads(document if isinstance(document, str) else json.dumps(document), object_hook=_component)
    except (ValueError, TypeError, RecursionError):
        return []
    return list(_within([tree]))


def blocks_of_json(df: DataFrame, id: str, document: str) -> DataFrame:
    """walk_blocks over a table: object_id, arrival and the block columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = pa.list_(pa.float64())
        for b in batches:
            rows = [(i, k, *x.values()) for i, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, x in enumerate(walk_blocks(d or ""))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), box, box))], names=["object_id", "arrival", "component_id", "page", "block_index", "type", "text", "bbox", "page_bbox"])

    return df.select(F.col(id).cast("string"), F.col(document).cast("string")).mapInArrow(run, "object_id string, arrival long, component_id string, page int, block_index int, type string, text string, bbox array<double>, page_bbox array<double>")
