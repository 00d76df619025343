"""Problem 5: parent-child links of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import hierarchy
from quire.session import read

_LINKS = {"id": "chunk_id", "parent": "parent_id", "group": "doc_id"}


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "chunks")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.faults(_chunks(spark, sf_dir), **_LINKS, children="children", level="level").withColumnRenamed("id", "chunk_id")


def p5_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = hierarchy.nodes(_chunks(spark, sf_dir), **_LINKS, children="children", level="level")
    return n.select(F.col("id").alias("chunk_id"), "state", "depth", "root", F.when(F.col("state") != hierarchy.CYCLE, F.col("subtree_size") - 1).alias("descendants"))  # on a cycle every node is below itself


def p5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.paths(_chunks(spark, sf_dir), **_LINKS).select(F.col("id").alias("chunk_id"), F.array_join("path", "/").alias("path"))


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendants(_chunks(spark, sf_dir), **_LINKS)


QUERIES = {"p5_found": p5_found, "p5_hierarchy": p5_hierarchy, "p5_paths": p5_paths, "p5_descendants": p5_descendants}

_WALK = """
WITH RECURSIVE n AS (
  SELECT DISTINCT ON (chunk_id) chunk_id, nullif(trim(parent_id), '') AS parent, level, children FROM chunks ORDER BY chunk_id
), l AS (
  SELECT a.chunk_id, a.parent, a.level, a.children, p.chunk_id IS NOT NULL AS held FROM n a LEFT JOIN n p ON a.parent = p.chunk_id
), down AS (
  SELECT chunk_id, CASE WHEN parent IS NULL THEN 'tree' ELSE 'orphan' END AS state, 0 AS depth, chunk_id AS root, chunk_id AS path FROM l WHERE NOT held
  UNION ALL SELECT l.chunk_id, d.state, d.depth + 1, d.root, d.path || '/' || l.chunk_id FROM down d JOIN l ON l.parent = d.chunk_id
), lost AS (SELECT * FROM l WHERE chunk_id NOT IN (SELECT chunk_id FROM down)
), walk AS (
  SELECT chunk_id AS start, parent AS at FROM lost UNION SELECT w.start, lost.parent FROM walk w JOIN lost ON lost.chunk_id = w.at
), lost_state AS (
  SELECT chunk_id, CASE WHEN EXISTS (SELECT 1 FROM walk w WHERE w.start = lost.chunk_id AND w.at = lost.chunk_id) THEN 'cycle' ELSE 'below_cycle' END AS state FROM lost
), said AS (SELECT DISTINCT chunk_id AS p, c FROM (SELECT chunk_id, unnest(children) AS c FROM n) WHERE trim(c) <> ''
), truly AS (SELECT parent AS p, chunk_id AS c FROM n WHERE parent IS NOT NULL
), odd AS (SELECT DISTINCT coalesce(s.p, t.p) AS chunk_id FROM said s FULL JOIN truly t ON s.p = t.p AND s.c = t.c WHERE s.p IS NULL OR t.p IS NULL)
"""

SQL = {
    "p5_found": _WALK
    + """
SELECT chunk_id, state AS issue FROM lost_state
UNION ALL SELECT chunk_id, 'orphan' FROM l WHERE parent IS NOT NULL AND NOT held
UNION ALL SELECT d.chunk_id, 'level' FROM down d JOIN n USING (chunk_id) WHERE state = 'tree' AND level IS DISTINCT FROM depth
UNION ALL SELECT chunk_id, 'children' FROM odd WHERE chunk_id IN (SELECT chunk_id FROM n)
""",
    "p5_hierarchy": _WALK
    + """
, below AS (SELECT a.at AS chunk_id, count(DISTINCT a.start) AS n FROM walk a WHERE a.start <> a.at GROUP BY ALL),
up AS (SELECT d.chunk_id AS start, d.chunk_id AS node FROM down d UNION ALL SELECT up.start, l.parent FROM up JOIN l ON l.chunk_id = up.node WHERE l.held), under AS (SELECT node AS chunk_id, count(*) - 1 AS n FROM up GROUP BY ALL)
SELECT d.chunk_id, d.state, d.depth, d.root, u.n AS descendants FROM down d JOIN under u USING (chunk_id)
UNION ALL SELECT s.chunk_id, s.state, NULL, NULL, CASE WHEN s.state = 'below_cycle' THEN coalesce(b.n, 0) END FROM lost_state s LEFT JOIN below b USING (chunk_id)
""",
    "p5_descendants": _WALK
    + """
, free AS (SELECT * FROM l WHERE chunk_id NOT IN (SELECT chunk_id FROM lost_state WHERE state = 'cycle')),
up AS (SELECT chunk_id AS descendant, parent AS ancestor, 1 AS distance FROM free WHERE parent IN (SELECT chunk_id FROM free) UNION ALL SELECT up.descendant, f.parent, distance + 1 FROM up JOIN free f ON f.chunk_id = up.ancestor WHERE f.parent IN (SELECT chunk_id FROM free))
SELECT ancestor, descendant, distance FROM up
""",
    "p5_paths": _WALK + "SELECT chunk_id, path FROM down",
}
