"""Term statistics for BM25: frequencies and lengths of items, document frequencies and mean length of a scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import analyze
from quire.functions.vectors import let

ANALYZER, LEXICAL_VERSION, STATS_VERSION = "unicode_word_v1", "lexical-v1", "bm25-corpus-v1"  # fixed values


def term_frequencies(items: DataFrame, id: str, text: str) -> DataFrame:
    """One row per item and term: id, term, tf. Terms are counted within the item before anything is shuffled by item."""
    return items.select(F.col(id), F.explode(analyze(F.col(text))).alias("term")).groupBy(id, "term").agg(F.count("*").alias("tf"))


def payload(text: Column) -> Column:
    """struct tf (map, keys in order) and dl of one text without a shuffle; null without terms."""
    # equal neighbours of the sorted tokens are counted in one fold
    start = F.struct(F.array().cast("array<struct<key:string,value:int>>").alias("done"), F.lit("").alias("term"), F.lit(0).alias("n"))

    def closed(a: Column) -> Column:
        return F.when(a["n"] > 0, F.concat(a["done"], F.array(F.struct(a["term"].alias("key"), a["n"].alias("value"))))).otherwise(a["done"])

    def add(a: Column, t: Column) -> Column:
        same = (a["term"] == t) & (a["n"] > 0)
        return F.struct(F.when(same, a["done"]).otherwise(closed(a)).alias("done"), t.alias("term"), F.when(same, a["n"] + 1).otherwise(1).alias("n"))

    def counted(tokens: Column) -> Column:
        return F.when(F.size(tokens) > 0, F.struct(F.map_from_entries(F.aggregate(F.sort_array(tokens), start, add, closed)).alias("tf"), F.size(tokens).alias("dl")))

    return let(analyze(text), counted)


def lengths(items: DataFrame, id: str, text: str) -> DataFrame:
    return items.select(F.col(id), F.size(analyze(F.col(text))).alias("dl"))


def corpus_stats(items: DataFrame, text: str, scope: list[str] | None = None, id: str | None = None) -> DataFrame:
    """n_items with terms and their mean length (six decimals, 0.0 without items) of each scope. id: repeated items count once.

    Texts are reduced to lengths before anything is shuffled.
    """
    dl = items.select(*(scope or []), *([id] if id else []), F.size(analyze(F.col(text))).alias("dl")).filter("dl > 0")
    dl = dl.dropDuplicates([id]) if id else dl
    aggs = [F.count("*").alias("n_items"), F.coalesce(F.round(F.sum("dl") / F.count("*"), 6), F.lit(0.0)).alias("avgdl")]
    return dl.groupBy(*scope).agg(*aggs) if scope else dl.agg(*aggs)


def document_frequencies(items: DataFrame, text: str, scope: list[str] | None = None) -> DataFrame:
    """Items that hold each term, in each scope."""
    each = items.select(*(scope or []), F.explode(F.array_distinct(analyze(F.col(text)))).alias("term"))
    return each.groupBy(*(scope or []), "term").agg(F.count("*").alias("df"))
