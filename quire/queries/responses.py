"""Queries of the spreadsheet-service responses and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import workbook
from quire.session import read

_FROM = {"id": "response_id", "uri": "source_uri", "body": "body"}


def workbook_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workbook.normalize(read(spark, sf_dir, "workbook_responses"), **_FROM)
    return w.select("response_id", "document_id", "document_type", "title", "main_text", "size_bytes", "job_id", "stage", "tables", "items", "embeddings", "avgdl")


def workbook_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = workbook.items(read(spark, sf_dir, "workbook_responses"), **_FROM)
    return i.select("response_id", "item_index", "item_id", "type", "component_type", "n_embeddings", F.get("embeddings.dimension", F.lit(0)).alias("first_dimension"), "dl", F.size("tf").alias("terms"))


def workbook_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = workbook.annotations(read(spark, sf_dir, "workbook_responses"), **_FROM)
    kind = F.when(F.col("value").startswith("{"), "object").when(F.col("value").startswith("["), "array").otherwise("value")
    return a.select("response_id", "place", "key", kind.alias("kind"), F.when(kind == "value", F.col("value")).alias("value"))


QUERIES = {f.__name__: f for f in (workbook_documents, workbook_items, workbook_annotations)}

_BASE = r"""WITH w AS (SELECT DISTINCT ON (response_id) response_id, source_uri, body::JSON AS j FROM workbook_responses WHERE json_valid(body) ORDER BY response_id),
d AS (SELECT *, coalesce(list_filter([trim(x) FOR x IN json_extract_string(j, '$.workbooks[*]')], lambda x: x <> '')[1], nullif(regexp_extract(source_uri, '([^/]*)$', 1), ''), 'workbook') AS name FROM w WHERE json_type(j, '$.structures') = 'ARRAY'),
s AS (SELECT response_id, name, x, row_number() OVER (PARTITION BY response_id ORDER BY k) - 1 AS i FROM (SELECT response_id, name, unnest(json_extract(j, '$.structures[*]')) AS x, unnest(range(CAST(json_array_length(j, '$.structures') AS BIGINT))) AS k FROM d) WHERE json_type(x) = 'OBJECT'),
q AS (SELECT response_id, CASE WHEN json_type(j, '$.retrieval_items') = 'ARRAY' THEN json_extract(j, '$.retrieval_items[*]') WHEN json_type(j, '$.retrieval.items') = 'ARRAY' THEN json_extract(j, '$.retrieval.items[*]') ELSE [] END AS xs FROM d),
u AS (SELECT * FROM (SELECT response_id, unnest(xs) AS x, unnest(range(len(xs))) AS k FROM q) WHERE json_type(x) = 'OBJECT'),
i1 AS (SELECT response_id, row_number() OVER (PARTITION BY response_id ORDER BY k) - 1 AS item_index, coalesce(nullif(x->>'$.item_id', ''), nullif(x->>'$.id', ''), CAST(k AS VARCHAR)) AS item_id, coalesce(nullif(x->>'$.type', ''), 'table') AS type, coalesce(nullif(x->>'$.component_type', ''), nullif(x->>'$.type', ''), 'table') AS component_type,
  CASE WHEN json_type(x, '$.content') = 'OBJECT' THEN x->'$.content' ELSE json_object('a', x->'$.retrieval_card', 'b', x->'$.metadata', 'c', x->'$.table_id', 'd', x->'$.table_name') END AS content,
  list_filter(CASE WHEN json_type(x, '$.embeddings') = 'ARRAY' THEN json_extract(x, '$.embeddings[*]') ELSE [x->'$.embedding'] END, lambda e: json_type(e) = 'OBJECT' AND CASE WHEN coalesce(json_type(e, '$.values'), 'NULL') = 'NULL' THEN json_type(e, '$.embedding') ELSE json_type(e, '$.values') END = 'ARRAY') AS es FROM u),
i2 AS (SELECT response_id, i AS item_index, concat_ws(':', coalesce(nullif(x->>'$.workbook', ''), name), nullif(x->>'$.sheet', ''), CAST(i AS VARCHAR)) AS item_id, 'table' AS type, 'table' AS component_type, json_object('x', x, 'name', CASE WHEN coalesce(x->>'$.workbook', '') = '' THEN name END) AS content, [] AS es FROM s WHERE response_id NOT IN (SELECT response_id FROM u)),
it AS (SELECT *, row_number() OVER () AS n FROM (SELECT * FROM i1 UNION ALL SELECT * FROM i2)),
tk AS (SELECT it.n, unnest(regexp_extract_all(replace(replace(lower(nfc_normalize(t.value->>'$')), 'ß', 'ss'), '’', ''''), '[\p{L}\p{N}]+(?:''[\p{L}\p{N}]+)*')) AS term FROM it, json_tree(it.content) t WHERE t.type IN ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE')),
tn AS (SELECT n, count(*) AS dl, count(DISTINCT term) AS terms FROM tk GROUP BY ALL),
items AS (SELECT it.*, coalesce(dl, 0) AS dl, coalesce(terms, 0) AS terms FROM it LEFT JOIN tn USING (n)),
m AS (SELECT *, list_filter(json_extract(j, '$.metadata_artifacts[*]'), lambda a: json_type(a, '$.metadata') = 'OBJECT') AS ms FROM d),
meta AS (SELECT *, coalesce(list_filter(ms, lambda a: coalesce(a->>'$.workbook', '') = name)[1], list_filter(ms, lambda a: len(json_keys(a, '$.metadata')) > 0)[1])->'$.metadata' AS v FROM m)
"""
_KNOWN = {n: "(" + ", ".join(f"'{k}'" for k in v) + ")" for n, v in (("r", workbook.RESPONSE_KEYS), ("m", workbook.METADATA_KEYS))}
SQL = {
    "workbook_items": _BASE + "SELECT response_id, item_index, item_id, type, component_type, len(es) AS n_embeddings, CASE WHEN len(es) > 0 THEN CAST(coalesce(nullif(CAST(es[1]->>'$.dimension' AS INT), 0), json_array_length(es[1], CASE WHEN coalesce(json_type(es[1], '$.values'), 'NULL') = 'NULL' THEN '$.embedding' ELSE '$.values' END)) AS INT) END AS first_dimension, dl, terms FROM items",
    "workbook_documents": _BASE + """, n AS (SELECT response_id, count(*) AS items, sum(len(es)) AS embeddings, round(avg(dl) FILTER (dl > 0), 6) AS avgdl FROM items GROUP BY ALL)
SELECT response_id, substr(sha1('data-object::' || source_uri), 1, 16) AS document_id, 'spreadsheet' AS document_type, coalesce(nullif(v->>'$.name', ''), name) AS title, coalesce(v->>'$.description', '') AS main_text, CAST(v->>'$.size_bytes' AS BIGINT) AS size_bytes, j->>'$.job_id' AS job_id, j->>'$.stage' AS stage,
  (SELECT count(*) FROM s WHERE s.response_id = meta.response_id) AS tables, coalesce(items, 0) AS items, coalesce(embeddings, 0) AS embeddings, coalesce(avgdl, 0) AS avgdl FROM meta LEFT JOIN n USING (response_id)""",
    "workbook_annotations": _BASE + f""", e AS (SELECT response_id, 'extensions' AS place, t.key AS key, t.value AS value, t.type AS type FROM d, json_each(d.j) t WHERE t.type <> 'NULL' AND t.key NOT IN {_KNOWN['r']}
UNION ALL SELECT response_id, 'extensions', 'retrieval.' || t.key, t.value, t.type FROM d, json_each(CASE WHEN json_type(d.j, '$.retrieval') = 'OBJECT' THEN d.j->'$.retrieval' ELSE '{{}}'::JSON END) t WHERE t.type <> 'NULL' AND t.key <> 'items'
UNION ALL SELECT response_id, 'extensions', 'additional_workbooks[' || (CAST(t.key AS INT) - 1) || ']', t.value, t.type FROM d, json_each(CASE WHEN json_type(d.j, '$.workbooks') = 'ARRAY' THEN d.j->'$.workbooks' ELSE '[]'::JSON END) t WHERE CAST(t.key AS INT) > 0
UNION ALL SELECT response_id, 'answers', CAST(t.key AS VARCHAR), t.value, t.type FROM d, json_each(CASE WHEN json_type(d.j, '$.answers') = 'ARRAY' THEN d.j->'$.answers' ELSE '[]'::JSON END) t
UNION ALL SELECT response_id, 'artifacts', CAST(t.key AS VARCHAR), t.value, t.type FROM d, json_each(CASE WHEN json_type(d.j, '$.artifacts') = 'ARRAY' THEN d.j->'$.artifacts' ELSE '[]'::JSON END) t
UNION ALL SELECT response_id, 'workbook_metadata[' || coalesce(nullif(a->>'$.workbook', ''), name) || ']', 'metadata.' || t.key, t.value, t.type FROM (SELECT response_id, name, unnest(ms) AS a FROM m), json_each(a->'$.metadata') t WHERE t.type <> 'NULL' AND t.key NOT IN {_KNOWN['m']}
UNION ALL SELECT response_id, 'workbook_metadata[' || coalesce(nullif(a->>'$.workbook', ''), name) || ']', t.key, t.value, t.type FROM (SELECT response_id, name, unnest(json_extract(j, '$.metadata_artifacts[*]')) AS a FROM d), json_each(CASE WHEN json_type(a) = 'OBJECT' THEN a ELSE '{{}}'::JSON END) t WHERE t.type <> 'NULL' AND t.key NOT IN ('workbook', 'metadata'))
SELECT response_id, place, key, CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'value' END AS kind, CASE WHEN type NOT IN ('OBJECT', 'ARRAY') THEN CAST(value AS VARCHAR) END AS value FROM e""",
}
