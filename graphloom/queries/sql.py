"""SQL fragments shared by the oracles: the graphs the queries run on."""

TRADE = """
nodes AS (
  SELECT 'R' || r_regionkey AS id, r_name AS name, 'Region' AS label FROM region
  UNION ALL SELECT 'N' || n_nationkey, n_name, 'Nation' FROM nation
  UNION ALL SELECT 'C' || c_custkey, c_name, 'Customer' FROM customer
  UNION ALL SELECT 'S' || s_suppkey, s_name, 'Supplier' FROM supplier
  UNION ALL SELECT 'P' || p_partkey, p_name, 'Part' FROM part
), raw_edges AS (
  SELECT 'N' || n_nationkey AS src, 'R' || n_regionkey AS dst, 'PART_OF' AS rel, NULL::VARCHAR AS t_announce FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'LOCATED_IN', NULL FROM customer
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'LOCATED_IN', NULL FROM supplier
  UNION ALL SELECT 'S' || l_suppkey, 'P' || l_partkey, 'SUPPLIES', strftime(min(l_shipdate), '%Y-%m-%d') FROM lineitem GROUP BY l_suppkey, l_partkey
  UNION ALL SELECT 'C' || o_custkey, 'P' || l_partkey, 'ORDERED', strftime(min(o_orderdate), '%Y-%m-%d') FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_partkey
), edges AS (SELECT src || '|' || rel || '|' || dst AS eid, * FROM raw_edges),
adj AS (SELECT eid, src AS a, dst AS b, rel, t_announce FROM edges UNION ALL SELECT eid, dst, src, rel, t_announce FROM edges WHERE src <> dst),
degree AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id)
"""

KNOWLEDGE = r"""
nodes AS (
  SELECT id, coalesce(min(name), '') AS name, min(entity_type) AS label, arg_max(confidence, updated_at) AS confidence FROM entities WHERE id IS NOT NULL GROUP BY id
), edges AS (
  SELECT edge_no, edge_no::VARCHAR AS eid, upper(trim(source)) AS src, upper(trim(target)) AS dst,
    CASE WHEN s = '' THEN 'RELATED_TO' ELSE upper(s) END AS rel, strftime(temporal.t_announce, '%Y-%m-%d') AS t_announce, strftime(temporal.t_effective, '%Y-%m-%d') AS t_effective,
    props.sentiment AS sentiment, props.sentiment_label AS sentiment_label, props.confidence AS confidence
  FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(predicate, '^\s+|\s+$', '', 'g'), '[\s\-]+', '_', 'g'), '[^A-Za-z0-9_]', '', 'g') AS s FROM relationships)
)
"""


def trade(select: str) -> str:
    return f"WITH RECURSIVE {TRADE} {select}"


def knowledge(select: str) -> str:
    return f"WITH RECURSIVE {KNOWLEDGE} {select}"
