"""Problem 7: spreadsheet-service responses to flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import nested
from quire.operators.nested import Rule
from quire.session import read

RULES = [
    Rule("structure", "", ("structures", "*?")),
    Rule("column", "structure", ("structure?", "columns", "*")),
    Rule("column", "column", ("children", "*")),
    Rule("item", "", ("retrieval_items", "*")),
    Rule("item", "", ("retrieval", "items", "*")),
    Rule("embedding", "item", ("embeddings", "*")),
    Rule("embedding", "item", ("embedding",)),
]
FIELDS = {
    "structure": {"workbook": "$.workbook", "sheet": "$.sheet", "status": "$.status", "header_rows": ("$.structure", "$.header_rows")},
    "column": {"name": "$.name", "type": "$.type", "unit": "$.unit", "nulls": "$.stats.nulls", "distinct_values": "$.stats.distinct"},
    "item": {"item_id": "$.item_id", "type": "$.type", "position": "$.position.index", "caption": "$.content.caption", "content": "$.content"},
    "embedding": {"model": "$.model", "dimension": "$.dimension", "values": "$.values", "embedding": "$.embedding"},
}


def _shredded(spark: SparkSession, sf_dir: str, inline: bool = False, content: bool = True) -> DataFrame:
    return nested.shred(read(spark, sf_dir, "workbook_responses"), "response_id", "body", RULES, inline=inline, content=content)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = nested.occurrences(_shredded(spark, sf_dir, inline=True, content=False))
    return o.select(o.record_id.alias("response_id"), "node_path", "parent_path", "node_kind")


def p7_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.objects(_shredded(spark, sf_dir))


def p7_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of every object: its record, parent and ordinal, and the object's identity in p7_objects."""
    return nested.occurrences(_shredded(spark, sf_dir))


def p7_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structures and items put together again from p7_objects and p7_bridge alone: the values they hold, and their characters."""
    every = _shredded(spark, sf_dir)
    r = nested.rebuilt(nested.objects(every), nested.occurrences(every))
    return r.select(F.col("record_id").alias("response_id"), "node_path", "leaves", "leaf_chars")


def p7_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each kind that a rule names, the places and the records they stand in."""
    o = nested.occurrences(_shredded(spark, sf_dir)).filter(F.col("node_kind") != nested.INNER)
    return o.groupBy("node_kind").agg(F.count("*").alias("places"), F.count_distinct("record_id").alias("records"), (F.count_distinct("node_hash") <= F.count("*")).alias("shared"))


def _flat(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = nested.flat(_shredded(spark, sf_dir, inline=True), kind, FIELDS[kind])
        return f.withColumnRenamed("record_id", "response_id").drop("node_hash", "parent_hash")

    return query


QUERIES = {"p7_found": p7_found, "p7_objects": p7_objects, "p7_bridge": p7_bridge, "p7_rebuilt": p7_rebuilt, "p7_shared": p7_shared} | {f"p7_{k}s": _flat(k) for k in FIELDS}

_TREE = """
WITH RECURSIVE r AS (
  SELECT DISTINCT ON (response_id) response_id, CASE WHEN json_valid(body) AND json_type(body::JSON) = 'OBJECT' THEN body::JSON END AS b FROM workbook_responses ORDER BY response_id
), el AS (
  SELECT response_id, i, json_extract(json_extract(b, '$.structures'), '$[' || i || ']') AS raw FROM r, LATERAL (SELECT unnest(range(json_array_length(json_extract(b, '$.structures'))::BIGINT)) AS i) WHERE json_type(json_extract(b, '$.structures')) = 'ARRAY'
), st AS (
  SELECT response_id, 'structures[' || i || ']' AS path, CASE WHEN json_type(raw) = 'OBJECT' THEN raw WHEN json_type(raw) = 'VARCHAR' AND json_valid(json_extract_string(raw, '$')) AND json_type((json_extract_string(raw, '$'))::JSON) = 'OBJECT' THEN (json_extract_string(raw, '$'))::JSON END AS o FROM el
), inner_st AS (
  SELECT response_id, path, CASE WHEN json_type(json_extract(o, '$.structure')) = 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string(o, '$.structure')) THEN (json_extract_string(o, '$.structure'))::JSON END ELSE json_extract(o, '$.structure') END AS s FROM st WHERE o IS NOT NULL
), col AS (
  SELECT response_id, path AS parent, path || '.structure.columns' AS base, json_extract(s, '$.columns') AS cs FROM inner_st
  UNION ALL
  SELECT response_id, path AS parent, path || '.children' AS base, json_extract(o, '$.children') AS cs FROM (
    SELECT c.response_id, c.base || '[' || i || ']' AS path, json_extract(c.cs, '$[' || i || ']') AS o FROM col c, LATERAL (SELECT unnest(range(json_array_length(c.cs)::BIGINT)) AS i) WHERE json_type(c.cs) = 'ARRAY'
    UNION ALL
    SELECT c.response_id, c.base || '.' || k AS path, json_extract(c.cs, '$."' || k || '"') AS o FROM col c, LATERAL (SELECT unnest(json_keys(c.cs)) AS k) WHERE json_type(c.cs) = 'OBJECT'
  ) WHERE json_type(o) = 'OBJECT' AND json_extract(o, '$.children') IS NOT NULL
), items AS (
  SELECT response_id, 'retrieval_items' AS base, json_extract(b, '$.retrieval_items') AS xs FROM r UNION ALL SELECT response_id, 'retrieval.items', json_extract(b, '$.retrieval.items') FROM r
), it AS (
  SELECT response_id, base || '[' || i || ']' AS path, json_extract(xs, '$[' || i || ']') AS o FROM items, LATERAL (SELECT unnest(range(json_array_length(xs)::BIGINT)) AS i) WHERE json_type(xs) = 'ARRAY'
), cols AS (
  SELECT c.response_id, c.base || '[' || i || ']' AS path, c.parent, json_extract(c.cs, '$[' || i || ']') AS o FROM col c, LATERAL (SELECT unnest(range(json_array_length(c.cs)::BIGINT)) AS i) WHERE json_type(c.cs) = 'ARRAY'
  UNION ALL
  SELECT c.response_id, c.base || '.' || k, c.parent, json_extract(c.cs, '$."' || k || '"') FROM col c, LATERAL (SELECT unnest(json_keys(c.cs)) AS k) WHERE json_type(c.cs) = 'OBJECT'
)
SELECT response_id, path AS node_path, '' AS parent_path, 'structure' AS node_kind, o FROM st WHERE o IS NOT NULL
UNION ALL SELECT response_id, path, parent, 'column', o FROM cols WHERE json_type(o) = 'OBJECT'
UNION ALL SELECT response_id, path, '', 'item', o FROM it WHERE json_type(o) = 'OBJECT'
UNION ALL SELECT response_id, path || '.embedding', path, 'embedding', json_extract(o, '$.embedding') FROM it WHERE json_type(o) = 'OBJECT' AND json_type(json_extract(o, '$.embedding')) = 'OBJECT'
UNION ALL SELECT response_id, path || '.embeddings[' || i || ']', path, 'embedding', json_extract(o, '$.embeddings[' || i || ']') FROM it, LATERAL (SELECT unnest(range(json_array_length(json_extract(o, '$.embeddings'))::BIGINT)) AS i) WHERE json_type(o) = 'OBJECT' AND json_type(json_extract(o, '$.embeddings')) = 'ARRAY' AND json_type(json_extract(o, '$.embeddings[' || i || ']')) = 'OBJECT'
"""

_HEAD, _, _LAST = _TREE.rpartition("\nSELECT response_id, path AS node_path")
_NODES = _HEAD + ", nodes AS (SELECT response_id, path AS node_path" + _LAST.rstrip() + ")\n"
# Keys of objects are ordinals in their order; the structure a JSON string holds counts as decoded.
_ORDINAL = "CASE WHEN node_path LIKE '%]' THEN CAST(regexp_extract(node_path, '\\[(\\d+)\\]$', 1) AS INT) WHEN node_kind = 'embedding' THEN 0 ELSE CAST(list_position(json_keys(holder), regexp_extract(node_path, '\\.([^.]+)$', 1)) - 1 AS INT) END"
_INNER = "CASE WHEN json_type(o, '$.structure') = 'VARCHAR' THEN CASE WHEN json_valid(o->>'$.structure') THEN (o->>'$.structure')::JSON END ELSE o->'$.structure' END"


def _text(path: str, of: str = "o") -> str:
    return f"CASE json_type({of}, '{path}') WHEN 'NULL' THEN NULL WHEN 'OBJECT' THEN CAST(json({of}->'{path}') AS VARCHAR) WHEN 'ARRAY' THEN CAST(json({of}->'{path}') AS VARCHAR) ELSE {of}->>'{path}' END"


_FLAT = {
    "structure": f"{_text('$.workbook')} AS workbook, {_text('$.sheet')} AS sheet, {_text('$.status')} AS status, {_text('$.header_rows', 's')} AS header_rows",
    "column": f"{_text('$.name')} AS name, {_text('$.type')} AS type, {_text('$.unit')} AS unit, {_text('$.stats.nulls')} AS nulls, {_text('$.stats.distinct')} AS distinct_values",
    "item": f"{_text('$.item_id')} AS item_id, {_text('$.type')} AS type, {_text('$.position.index')} AS position, {_text('$.content.caption')} AS caption, {_text('$.content')} AS content",
    "embedding": f"{_text('$.model')} AS model, {_text('$.dimension')} AS dimension, {_text('$.values')} AS values, {_text('$.embedding')} AS embedding",
}
_WITH_ORDINAL = _NODES + f", held AS (SELECT n.*, {_INNER} AS s, CASE WHEN n.node_kind = 'column' THEN (SELECT any_value(c.cs) FROM col c WHERE c.response_id = n.response_id AND c.base = regexp_extract(n.node_path, '^(.*)\\.[^.]+$', 1) AND json_type(c.cs) = 'OBJECT') END AS holder FROM nodes n)\n"
SQL = {
    "p7_found": _NODES + "SELECT response_id, node_path, parent_path, node_kind FROM nodes",
    "p7_shared": _NODES + "SELECT node_kind, count(*) AS places, count(DISTINCT response_id) AS records, true AS shared FROM nodes GROUP BY ALL",
    "p7_rebuilt": _NODES + "SELECT n.response_id, n.node_path, count(*) AS leaves, coalesce(sum(length(t.value->>'$')), 0) AS leaf_chars FROM nodes n, json_tree(n.o) t WHERE n.parent_path = '' AND n.node_kind <> 'column' AND n.node_kind <> 'embedding' AND t.type NOT IN ('OBJECT', 'ARRAY') GROUP BY ALL",
} | {f"p7_{k}s": _WITH_ORDINAL + f"SELECT response_id, node_path, parent_path, {_ORDINAL} AS ordinal, {fields} FROM held WHERE node_kind = '{k}'" for k, fields in _FLAT.items()}
