"""Images of documents: assets, names, references in Markdown, and the guard of table refinement."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators.layout import markdown_images

_TABLE = re.compile(r"<table\b[^>]*>.*?</table\s*>", re.I | re.S)


def decoded(encoded: Column) -> Column:
    """Bytes of a base64 text, with or without a data-URI head; null if it is none."""
    return F.try_to_binary(F.regexp_replace(encoded, r"^data:[^,]*,", ""), F.lit("base64"))


def save_status(data: Column) -> Column:
    return F.when(data.isNull(), "decode_failed").otherwise("saved")


def data_uri_suffix(uri: Column) -> Column:
    kind = F.lower(F.regexp_extract(uri, r"^data:image/([A-Za-z0-9.+-]+)", 1))
    return F.when(kind == "jpeg", ".jpg").when(kind == "svg+xml", ".svg").when(F.length(kind) > 0, F.concat(F.lit("."), kind)).otherwise(".png")


def safe_image_name(name: Column, index: Column, encoded: Column) -> Column:
    """A file name from a given one, else from the number; the suffix of the data where the name has none."""
    base = F.coalesce(X.text_or_null(F.regexp_replace(F.regexp_replace(F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/\\]*)$", 1), r"[^A-Za-z0-9._-]+", "-"), r"^[-.]+|[-.]+$", "")), F.concat(F.lit("image-"), index.cast("string")))
    return F.when(base.rlike(r"\.[A-Za-z0-9]{2,5}$"), base).otherwise(F.concat(base, data_uri_suffix(encoded)))


def unique_names(images: DataFrame, group: str, name: str, order: str) -> DataFrame:
    """Names that differ by more than case within a group: the first keeps its name, later ones get 8 hex digits of their content or place."""
    w = W.partitionBy(group, F.lower(name)).orderBy(order)
    n = F.row_number().over(w)
    stem, suffix = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    tag = F.substring(F.sha1(F.concat_ws(":", F.col(name), F.col(order).cast("string"))), 1, 8)
    return images.withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat(stem, F.lit("-"), tag, suffix)))


def numbered_names(files: DataFrame, group: str, name: str, order: str) -> DataFrame:
    """Names with -2, -3 before the suffix where they repeat but for case."""
    n = F.row_number().over(W.partitionBy(group, F.lower(name)).orderBy(order))
    stem, suffix = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return files.withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat(stem, F.lit("-"), n.cast("string"), suffix)))


def content_addressed(images: DataFrame, data: str) -> DataFrame:
    """Images once each, named by their SHA-256."""
    return images.filter(F.col(data).isNotNull()).withColumn("sha256", F.sha2(data, 256)).dropDuplicates(["sha256"])


def write_images(images: DataFrame, folder: str) -> DataFrame:
    """Writes columns sha256, content once each to a shared folder and returns sha256, path, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.makedirs(folder, exist_ok=True)
        for b in batches:
            rows = []
            for name, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                path = os.path.join(folder, name)
                if not os.path.exists(path):
                    part = f"{path}.{os.getpid()}.part"
                    with open(part, "wb") as f:
                        f.write(body)
                    os.replace(part, path)
                rows.append((name, path, len(body)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], names=["sha256", "path", "bytes"])

    return images.select("sha256", "content").mapInArrow(run, "sha256 string, path string, bytes long")


def match_markdown_images(docs: DataFrame) -> DataFrame:
    """Images of Markdown texts with the asset and the block each gets, first unused ones in order.

    docs: object_id, markdown, assets (structs asset_index, name), blocks (structs component_id, type, text). An asset fits if its file
    name is the target's but for case; a block if it is an image and its text holds the target's name or the alternative text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, found, assets, blocks in zip(*(c.to_pylist() for c in b.columns)):
                used_a, used_b = set(), set()
                for i, im in enumerate(found or []):
                    base = im["target"].rpartition("/")[2].casefold()
                    a = next((x["asset_index"] for x in assets or [] if (x["name"] or "").rpartition("/")[2].casefold() == base and x["asset_index"] not in used_a), None)
                    alt = (im["alt"] or "").strip()
                    ref = next((x["component_id"] for x in blocks or [] if (x["type"] or "").casefold() in ("picture", "figure", "image") and x["component_id"] not in used_b and (base in (x["text"] or "").casefold() or (alt and alt in (x["text"] or "")))), None)
                    used_a.add(a)
                    used_b.add(ref)
                    out.append((doc, i, im["alt"], im["target"], a, ref))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string()))], names=["object_id", "image", "alt", "target", "asset_index", "component_id"])

    some = docs.select(F.col("object_id").cast("string"), markdown_images(F.col("markdown")).alias("found"), "assets", "blocks")
    return some.mapInArrow(run, "object_id string, image int, alt string, target string, asset_index int, component_id string")


def replace_tables(text: str, replacements: dict[int, str]) -> str:
    """The n-th HTML tables of a text replaced, counted from 0."""
    n = -1

    def one(m: re.Match) -> str:
        nonlocal n
        n += 1
        return replacements.get(n, m[0])

    return _TABLE.sub(one, text)


def refinement_accepted(before: str, after: str, floor: float = 0.99) -> bool:
    """Whether a second reading of a table may replace the first: no columns added, and nearly all tokens shared both ways.

    A table that gets smaller may lose tokens, as long as what is left is shared.
    """
    import html as html_lib
    import unicodedata
    from collections import Counter

    a, b = X.table_shape(before), X.table_shape(after)
    if a is None or b is None or b[1] > a[1]:
        return False
    words = lambda t: Counter(re.findall(r"\w+|[^\w\s]", unicodedata.normalize("NFKC", html_lib.unescape(re.sub(r"<[^>]+>", " ", t))).casefold()))
    x, y = words(before), words(after)
    shared = sum((x & y).values())
    precision, recall = shared / max(1, sum(y.values())), shared / max(1, sum(x.values()))
    smaller = b[0] < a[0] or b[1] < a[1]
    return precision >= floor and (recall >= floor or smaller)


FIGURE_BLOCKS = ("Image", "Figure", "Diagram")  # fixed values


def _file(path: Column) -> Column:
    return F.lower(F.element_at(F.split(F.coalesce(path, F.lit("")), "/"), -1))


def candidate_names(block_images: Column, page_images: Column, block_type: Column) -> Column:
    """File names a figure's picture may have: those its block shows, those its page shows with the same alternative text, and for a
    picture block without any, all its page shows. Images are structs src, alt."""

    def names(images: Column) -> Column:
        return F.filter(F.transform(images, lambda i: _file(i["src"])), lambda n: F.length(n) > 0)

    block, page = (F.coalesce(c, F.array().cast("array<struct<src:string,alt:string>>")) for c in (block_images, page_images))
    alts = F.filter(F.transform(block, lambda i: F.lower(X.collapse(F.coalesce(i["alt"], F.lit(""))))), lambda a: F.length(a) > 0)
    like = F.filter(page, lambda i: F.array_contains(alts, F.lower(X.collapse(F.coalesce(i["alt"], F.lit(""))))))
    own = F.array_union(names(block), names(like))
    return F.when((F.size(own) == 0) & block_type.isin(*FIGURE_BLOCKS), F.array_distinct(names(page))).otherwise(own)


def align_images(figures: DataFrame, images: DataFrame) -> DataFrame:
    """Figures with the saved image each gets: the first unused one of its page with one of its names; then the images left over.

    figures: object_id, figure_index, component_id, page, names; images: object_id, image_index, page, name, original_name. Without an
    image a figure is unavailable. A document's matches depend on each other, so they are made within its row; groups are documents.
    """
    f = figures.groupBy("object_id").agg(F.sort_array(F.collect_list(F.struct("figure_index", "component_id", "page", "names"))).alias("figs"))
    i = images.groupBy("object_id").agg(F.sort_array(F.collect_list(F.struct("image_index", "page", F.array(_file(F.col("name")), _file(F.col("original_name"))).alias("names")))).alias("images"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, figs, pictures in zip(*(c.to_pylist() for c in b.columns)):
                free: dict[tuple, list[int]] = {}
                for x in pictures or []:
                    for n in set(x["names"]) - {""}:
                        free.setdefault((x["page"], n), []).append(x["image_index"])
                left = {x["image_index"] for x in pictures or []}
                for x in figs or []:
                    fits = [k for n in x["names"] or [] for k in free.get((x["page"] or 0, n), ()) if k in left]
                    got = min(fits, default=None)
                    left.discard(got)
                    out.append((doc, x["figure_index"], got, "unavailable" if got is None else "matched", x["component_id"] or f"figure:{x['figure_index']}"))
                out += [(doc, None, k, "unused", None) for k in sorted(left)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()))], names=["object_id", "figure_index", "image_index", "status", "source_ref"])

    return f.join(i, "object_id", "full").select(F.col("object_id").cast("string"), "figs", "images").mapInArrow(run, "object_id string, figure_index int, image_index int, status string, source_ref string")
