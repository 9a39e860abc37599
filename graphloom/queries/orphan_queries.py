"""Queries on references to missing records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import orphans
from graphloom.queries.registry import query
from graphloom.session import table


@query("""
WITH e AS (SELECT upper(trim(id)) AS id, min(created_at) AS created FROM entities WHERE trim(id) <> '' GROUP BY 1),
d AS (SELECT upper(trim(id)) AS id, min(deleted_at) AS deleted FROM entity_deletions GROUP BY 1),
r AS (
  SELECT edge_no, 'source' AS side, upper(trim(source)) AS id, created_at FROM relationships
  UNION ALL SELECT edge_no, 'target', upper(trim(target)), created_at FROM relationships)
SELECT * FROM (
  SELECT edge_no, side, CASE WHEN e.id IS NULL THEN 'missing' WHEN e.created > created_at THEN 'late' WHEN d.deleted <= created_at THEN 'deleted' END AS why,
    strftime(created_at, '%Y-%m') AS edge_month
  FROM r LEFT JOIN e USING (id) LEFT JOIN d USING (id) WHERE r.id <> '')
WHERE why IS NOT NULL
""")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    tracker = orphans.track(table(spark, d, "relationships"), table(spark, d, "entities"), table(spark, d, "entity_deletions"))
    return tracker.found().select(F.col("ref_no").alias("edge_no"), "side", "why", F.col("month").alias("edge_month"))


@query("""
WITH p AS (SELECT upper(trim(id)) AS id, min(created_at) AS created FROM entities WHERE trim(id) <> '' GROUP BY 1),
g AS (SELECT upper(trim(id)) AS id, min(deleted_at) AS deleted FROM entity_deletions WHERE trim(id) <> '' GROUP BY 1),
r AS (SELECT 'source' AS side, upper(trim(source)) AS id, created_at AS made FROM relationships UNION ALL SELECT 'target', upper(trim(target)), created_at FROM relationships),
s AS (
  SELECT side, CASE WHEN p.id IS NULL THEN 'missing' WHEN created > made THEN 'late' WHEN deleted <= made THEN 'deleted' END AS why, strftime(made, '%Y-%m') AS month, (p.id IS NULL OR g.id IS NOT NULL) AS still
  FROM r LEFT JOIN p ON p.id = r.id LEFT JOIN g ON g.id = r.id WHERE r.id <> '' AND made IS NOT NULL
)
SELECT side, why, month, count(*) AS n, sum(still::BIGINT)::BIGINT AS open FROM s WHERE why IS NOT NULL GROUP BY side, why, month
""")
def p7_report(spark: SparkSession, d: str) -> DataFrame:
    tracker = orphans.track(table(spark, d, "relationships"), table(spark, d, "entities"), table(spark, d, "entity_deletions"))
    return tracker.snapshot().select("side", "why", "month", "n", "open")
