"""Queries on the graph: lookups, neighbours, paths, scores and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph, paths, search, stats
from graphloom.queries.registry import query
from graphloom.queries.sql import knowledge, trade
from graphloom.session import Cuts, table


def _trade(spark: SparkSession, d: str) -> graph.Graph:
    return graph.trade_graph(spark, d)


def _kg(spark: SparkSession, d: str) -> graph.Graph:
    return graph.knowledge_graph(table(spark, d, "entities"), table(spark, d, "relationships"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Search nation 1, expand trails of up to two edges, score and keep the best three."""
    g = _trade(spark, d)
    found = paths.find_paths(g, ["N1"], max_hops=2, top_k=9)
    best = paths.score_paths(found, 0.9, words=["nation", "customer"])
    return best.select("path_id", "hops", F.array_join("node_names", " -> ").alias("path"), "score")


@query(trade("SELECT id, name, label, coalesce(degree, 0)::BIGINT AS degree FROM nodes LEFT JOIN degree USING (id) WHERE contains(lower(name), 'nation_1') ORDER BY degree DESC, id LIMIT 5"))
def f1_search_nodes(spark: SparkSession, d: str) -> DataFrame:
    return search.search_nodes(_trade(spark, d), "NATION_1")


@query(knowledge("""SELECT id, name, label, degree::BIGINT AS degree FROM (
  SELECT n.id, name, label, coalesce(g.degree, 0) AS degree FROM nodes n LEFT JOIN (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id) g USING (id)
  WHERE contains(lower(name), 'finance') ORDER BY degree DESC, id LIMIT 10) WHERE NOT regexp_matches(trim(name), '(?i)^(joint\\s+venture|trade\\s+spotlight|final\\s+dividend)$')"""))
def f2_search_entities(spark: SparkSession, d: str) -> DataFrame:
    return search.search_entities(_kg(spark, d), "Finance")


@query(knowledge("""SELECT id, name, label, coalesce(degree, 0)::BIGINT AS degree FROM nodes LEFT JOIN (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id) USING (id)
  WHERE lower(name) = 'power' OR lower(name) LIKE 'power %' OR lower(name) LIKE '% power' OR lower(name) LIKE '% power %' ORDER BY degree DESC, id LIMIT 10"""))
def f3_whole_word_search(spark: SparkSession, d: str) -> DataFrame:
    return search.search_words(_kg(spark, d), "Power")


@query(knowledge("SELECT id, name, label FROM nodes WHERE contains(name, 'Steel') ORDER BY id LIMIT 100"))
def f4_case_sensitive_search(spark: SparkSession, d: str) -> DataFrame:
    return search.search_case_sensitive(_kg(spark, d).nodes, "Steel").select("id", "name", "label")


@query(trade("SELECT eid, src, dst, rel FROM edges WHERE rel IN ('PART_OF', 'LOCATED_IN')"))
def f7_relation_filter(spark: SparkSession, d: str) -> DataFrame:
    return _trade(spark, d).edges.where(F.upper("rel").isin("PART_OF", "LOCATED_IN")).select("eid", "src", "dst", "rel")


@query(knowledge("SELECT edge_no, rel, t_announce, t_effective FROM edges WHERE (t_announce >= '2023-01-01' OR t_effective >= '2023-01-01') AND (t_announce <= '2023-06-30' OR t_effective <= '2023-06-30')"))
def f8_temporal_filter(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.functions.temporal import temporal_filter

    return _kg(spark, d).edges.where(temporal_filter("2023-01-01", "2023-06-30")).select("edge_no", "rel", "t_announce", "t_effective")


@query(trade("SELECT 'id' AS by_what, id, name, label FROM nodes WHERE id = 'N7' UNION ALL SELECT 'name', id, name, label FROM nodes WHERE lower(trim(name)) = 'nation_7' UNION ALL SELECT 'type', id, name, label FROM nodes WHERE label = 'Region'"))
def f17_lookups(spark: SparkSession, d: str) -> DataFrame:
    n = _trade(spark, d).nodes
    by = lambda what, df: df.select(F.lit(what).alias("by_what"), "id", "name", "label")
    return by("id", search.by_id(n, "N7")).unionByName(by("name", search.by_name(n, " Nation_7 "))).unionByName(by("type", search.by_type(n, "Region")))


@query(trade("SELECT 'out' AS way, eid FROM edges WHERE src = 'N3' UNION ALL SELECT 'in', eid FROM edges WHERE dst = 'N3' UNION ALL SELECT 'both', eid FROM edges WHERE src = 'N3' OR dst = 'N3'"))
def f18_incident_edges(spark: SparkSession, d: str) -> DataFrame:
    e = _trade(spark, d).edges
    parts = [search.incident(e, "N3", way).select(F.lit(way).alias("way"), "eid") for way in ("out", "in", "both")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


NEAR = """SELECT x.a AS from_id, n.name AS from_name, x.rel, x.b AS to_id, m.name AS to_name, m.label AS to_label, CASE WHEN e.src = x.a THEN 'outgoing' ELSE 'incoming' END AS direction, x.t_announce
  FROM (SELECT * FROM adj WHERE a = '{id}' {where} ORDER BY eid LIMIT {limit}) x JOIN edges e USING (eid) JOIN nodes n ON n.id = x.a JOIN nodes m ON m.id = x.b"""
NEAR_COLUMNS = ("from_id", "from_name", "rel", "to_id", "to_name", "to_label", "direction", "t_announce")


@query(trade(NEAR.format(id="N1", where="", limit=30)))
def j1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return search.neighbours(_trade(spark, d), ["N1"]).select(*NEAR_COLUMNS)


@query(trade(NEAR.format(id="P5", where="AND rel = 'ORDERED' AND t_announce >= '1996-01-01'", limit=30)))
def j1_neighbours_filtered(spark: SparkSession, d: str) -> DataFrame:
    return search.neighbours(_trade(spark, d), ["P5"], ["ordered"], after="1996-01-01").select(*NEAR_COLUMNS)


@query(trade(NEAR.format(id="S2", where="", limit=20)))
def j2_neighbours_by_id(spark: SparkSession, d: str) -> DataFrame:
    return search.neighbours(_trade(spark, d), ["S2"], limit=20).select(*NEAR_COLUMNS)


TRAILS = """, h1 AS (SELECT a AS s, b AS last, [a, b] AS nodes, [eid] AS eids FROM adj WHERE a = '{start}' AND a <> b {rel}),
h2 AS (SELECT s, x.b AS last, list_append(nodes, x.b) AS nodes, list_append(eids, x.eid) AS eids FROM h1 JOIN adj x ON x.a = h1.last WHERE x.b <> s AND NOT list_contains(eids, x.eid) {xrel}),
h2all AS (SELECT s, x.b AS last, list_append(nodes, x.b) AS nodes, list_append(eids, x.eid) AS eids FROM h1 JOIN adj x ON x.a = h1.last WHERE NOT list_contains(eids, x.eid) {xrel}),
h3 AS (SELECT s, x.b AS last, list_append(nodes, x.b) AS nodes, list_append(eids, x.eid) AS eids FROM h2all JOIN adj x ON x.a = h2all.last WHERE x.b <> s AND x.b <> nodes[2] AND NOT list_contains(eids, x.eid) {xrel})
"""


def _trails(start: str, rel: str | None = None) -> str:
    return TRAILS.format(start=start, rel=f"AND rel = '{rel}'" if rel else "", xrel=f"AND x.rel = '{rel}'" if rel else "")


@query(trade(_trails("N1") + "SELECT 1::BIGINT AS hops, count(*)::BIGINT AS n FROM h1 UNION ALL SELECT 2, count(*) FROM h2 UNION ALL SELECT 3, count(*) FROM h3"))
def j3_trail_counts(spark: SparkSession, d: str) -> DataFrame:
    hops = paths.trails(_trade(spark, d).store(Cuts(spark, "trails")), ["N1"])
    parts = [h.groupBy().agg(F.count("*").alias("n")).select(F.lit(i).cast("long").alias("hops"), "n") for i, h in enumerate(hops, 1)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(trade(_trails("N1") + """SELECT hops, list_aggregate(nodes, 'string_agg', '>') AS nodes FROM (SELECT 1::BIGINT AS hops, nodes, eids FROM h1 UNION ALL SELECT 2, nodes, eids FROM h2)
ORDER BY hops, list_aggregate(eids, 'string_agg', chr(1)), list_aggregate(nodes, 'string_agg', chr(1)) LIMIT 100"""))
def g2_find_paths(spark: SparkSession, d: str) -> DataFrame:
    return paths.find_paths(_trade(spark, d), ["N1"], max_hops=2, top_k=100).select(F.col("hops").cast("long").alias("hops"), F.array_join("node_ids", ">").alias("nodes"))


@query(trade(_trails("S3") + """SELECT hops, list_aggregate(nodes, 'string_agg', '>') AS nodes FROM (SELECT 1::BIGINT AS hops, nodes, eids, last FROM h1 UNION ALL SELECT 2, nodes, eids, last FROM h2 UNION ALL SELECT 3, nodes, eids, last FROM h3)
WHERE last IN ('R0', 'R1', 'R2', 'R3', 'R4') ORDER BY hops, list_aggregate(eids, 'string_agg', chr(1)), list_aggregate(nodes, 'string_agg', chr(1)) LIMIT 5"""))
def g2_paths_to_targets(spark: SparkSession, d: str) -> DataFrame:
    ends = [f"R{i}" for i in range(5)]
    return paths.find_paths(_trade(spark, d), ["S3"], ends, top_k=5).select(F.col("hops").cast("long").alias("hops"), F.array_join("node_ids", ">").alias("nodes"))


@query(trade(_trails("C1", "LOCATED_IN") + """SELECT hops, list_aggregate(nodes, 'string_agg', '>') AS nodes FROM (SELECT 1::BIGINT AS hops, nodes, eids FROM h1 UNION ALL SELECT 2, nodes, eids FROM h2 UNION ALL SELECT 3, nodes, eids FROM h3)
ORDER BY hops, list_aggregate(eids, 'string_agg', chr(1)), list_aggregate(nodes, 'string_agg', chr(1)) LIMIT 50"""))
def g2_paths_by_relation(spark: SparkSession, d: str) -> DataFrame:
    return paths.find_paths(_trade(spark, d), ["C1"], rel_types=["located_in"], top_k=50).select(F.col("hops").cast("long").alias("hops"), F.array_join("node_ids", ">").alias("nodes"))


@query(trade(""", walk(nodes, last, hops) AS (
  SELECT ['C1'], 'C1', 0 UNION ALL SELECT list_append(nodes, dst), dst, hops + 1 FROM walk JOIN edges ON src = last WHERE hops < 3 AND NOT list_contains(nodes, dst))
SELECT DISTINCT hops::BIGINT AS hops, list_aggregate(nodes, 'string_agg', '>') AS nodes FROM walk WHERE hops > 0"""))
def g3_simple_paths(spark: SparkSession, d: str) -> DataFrame:
    return paths.simple_paths(_trade(spark, d), ["C1"], max_hops=3).select(F.col("hops").cast("long").alias("hops"), F.array_join("node_ids", ">").alias("nodes"))


@query(trade("""SELECT a || '>' || b AS nodes, n.name || ' -' || rel || '- ' || m.name || ' @' || coalesce(t_announce, '?') AS said FROM (SELECT * FROM adj WHERE a = 'P7' ORDER BY eid LIMIT 30) JOIN nodes n ON n.id = a JOIN nodes m ON m.id = b"""))
def g4_neighbour_paths(spark: SparkSession, d: str) -> DataFrame:
    p = paths.neighbour_paths(search.neighbours(_trade(spark, d), ["P7"]))
    t = F.col("triples")[0]
    return p.select(F.array_join("node_ids", ">").alias("nodes"), F.concat(t["subj"], F.lit(" -"), t["rel"], F.lit("- "), t["obj"], F.lit(" @"), F.coalesce(t["time"], F.lit("?"))).alias("said"))


@query(trade(_trails("C2", None) + """, p AS (SELECT 1 AS hops, nodes, eids FROM h1 UNION ALL SELECT 2, nodes, eids FROM h2),
f AS (SELECT * FROM p ORDER BY hops, list_aggregate(eids, 'string_agg', chr(1)), list_aggregate(nodes, 'string_agg', chr(1)) LIMIT 200),
t AS (SELECT *, EXISTS (SELECT 1 FROM edges WHERE list_contains(f.eids, edges.eid) AND edges.t_announce >= '1996-01-01') AS late FROM f)
SELECT list_aggregate(nodes, 'string_agg', '>') AS nodes, round(least(1, greatest(0, 0.35 * 0.75 + 0.25 * 0.9 + 0.20 * (CASE WHEN late THEN 1.0 ELSE 0.2 END) - 0.20 * 0.08 * (hops - 1))), 4)::DOUBLE AS score FROM t"""))
def g6_path_scores(spark: SparkSession, d: str) -> DataFrame:
    found = paths.find_paths(_trade(spark, d), ["C2"], max_hops=2, top_k=200)
    return paths.score_paths(found, 0.9, after="1996-01-01", top_k=None).select(F.array_join("node_ids", ">").alias("nodes"), "score")


@query(trade(_trails("N2") + """, f AS (SELECT nodes, eids FROM h1 ORDER BY list_aggregate(eids, 'string_agg', chr(1)) LIMIT 40),
w AS (SELECT nodes, rel, n.name AS x, m.name AS y FROM f JOIN edges ON eid = eids[1] JOIN nodes n ON n.id = nodes[1] JOIN nodes m ON m.id = nodes[2]),
tok AS (SELECT nodes, unnest(string_split_regex(lower(x || ' ' || y || ' ' || replace(rel, '_', ' ')), '\\s+')) AS t FROM w),
hit AS (SELECT nodes, k, bool_or(contains(t, k) OR contains(k, t)) AS h FROM tok, (SELECT unnest(['located', 'region', 'customer', 'absent']) AS k) WHERE t <> '' GROUP BY nodes, k)
SELECT list_aggregate(nodes, 'string_agg', '>') AS nodes, (sum(h::INT) / 4.0)::DOUBLE AS bonus FROM hit GROUP BY nodes"""))
def g8_relevance(spark: SparkSession, d: str) -> DataFrame:
    found = paths.find_paths(_trade(spark, d), ["N2"], max_hops=1, top_k=40)
    return found.select(F.array_join("node_ids", ">").alias("nodes"), paths.relevance(F.col("node_names"), F.col("triples"), ["located", "region", "customer", "absent"]).alias("bonus"))


@query(trade("""SELECT label, rank, id FROM (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY degree DESC, id)::BIGINT AS rank FROM nodes JOIN degree USING (id)) WHERE rank <= 3"""))
def w1_top_per_label(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    g = _trade(spark, d)
    rows = search.degrees(g.edges).join(g.nodes, "id")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("degree"), "id"))
    return rows.withColumn("rank", rank.cast("long")).where("rank <= 3").select("label", "rank", "id")


@query(trade("SELECT id, degree::BIGINT AS degree FROM degree"))
def a1_degrees(spark: SparkSession, d: str) -> DataFrame:
    return search.degrees(_trade(spark, d).edges)


@query(knowledge("SELECT coalesce(label, '?') AS label, count(*)::BIGINT AS n FROM nodes GROUP BY 1"))
def a2_label_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.label_histogram(_kg(spark, d).nodes)


@query(knowledge("SELECT rel, count(*)::BIGINT AS n FROM edges GROUP BY rel ORDER BY n DESC, rel LIMIT 15"))
def a3_relation_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.relation_histogram(_kg(spark, d).edges)


@query(knowledge("SELECT sentiment_label, count(*)::BIGINT AS n FROM edges WHERE sentiment_label IS NOT NULL GROUP BY 1"))
def a4_sentiment_distribution(spark: SparkSession, d: str) -> DataFrame:
    return stats.sentiment_distribution(_kg(spark, d).edges)


@query(knowledge("""SELECT (SELECT count(*) FROM nodes)::BIGINT AS n_nodes, (SELECT count(DISTINCT label) FROM nodes)::BIGINT AS n_labels, count(*)::BIGINT AS n_edges, count(DISTINCT rel)::BIGINT AS n_rels, 1::BIGINT AS n_sources,
  round(avg(sentiment), 4)::DOUBLE AS avg_sentiment FROM edges"""))
def a5_graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.graph_stats(_kg(spark, d)).withColumn("avg_sentiment", F.round("avg_sentiment", 4))


@query(trade("SELECT (SELECT count(*) FROM nodes)::BIGINT AS n_nodes, (SELECT count(DISTINCT label) FROM nodes)::BIGINT AS n_labels, count(*)::BIGINT AS n_edges FROM edges"))
def a6_builder_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.graph_stats(_trade(spark, d)).select("n_nodes", "n_labels", "n_edges")


@query(trade("SELECT id, name, label, degree::BIGINT AS degree FROM (SELECT * FROM degree ORDER BY degree DESC, id LIMIT 10) LEFT JOIN nodes USING (id)"))
def w2_top_by_degree(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_by_degree(_trade(spark, d)).select("id", "name", "label", "degree")


@query(knowledge("SELECT DISTINCT 'label' AS kind, label AS value FROM nodes UNION SELECT DISTINCT 'rel', rel FROM edges"))
def s18_schema_overview(spark: SparkSession, d: str) -> DataFrame:
    return stats.schema_overview(_kg(spark, d))


@query(knowledge("SELECT src AS s, rel AS p, dst AS o, coalesce(t_announce, '.') AS t_start, coalesce(t_effective, '.') AS t_end FROM edges"))
def g17_quintuples(spark: SparkSession, d: str) -> DataFrame:
    return graph.quintuples(_kg(spark, d).edges)


@query(knowledge("SELECT src, dst, arg_max(rel, edge_no) AS rel, max(edge_no) AS edge_no FROM edges GROUP BY src, dst"))
def q7_simple_graph(spark: SparkSession, d: str) -> DataFrame:
    return _kg(spark, d).simple("edge_no").edges.select("src", "dst", "rel", "edge_no")


@query("SELECT id, list_aggregate(list_sort(list_distinct(flatten(list(sources)))), 'string_agg', ',') AS sources FROM entities WHERE sources IS NOT NULL AND len(sources) > 0 GROUP BY id")
def a11_source_union(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.operators.merge import add_sources

    return add_sources(table(spark, d, "entities"), ["id"]).select("id", F.array_join("sources", ",").alias("sources"))


@query("""SELECT edge_no, CASE WHEN props.sentiment NOT BETWEEN -1 AND 1 THEN 'sentiment' WHEN props.impact_magnitude NOT BETWEEN 0 AND 1 THEN 'impact_magnitude' WHEN props.confidence NOT BETWEEN 0 AND 1 THEN 'confidence' ELSE 'prominence' END AS out_of_range
FROM relationships WHERE props.sentiment NOT BETWEEN -1 AND 1 OR props.impact_magnitude NOT BETWEEN 0 AND 1 OR props.confidence NOT BETWEEN 0 AND 1 OR props.prominence NOT BETWEEN 0 AND 1""")
def m0_range_errors(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_property_errors(table(spark, d, "relationships")).select("edge_no", "out_of_range")


@query("SELECT DISTINCT entity_type AS label, unnest(map_keys(props)) AS key FROM entities WHERE props IS NOT NULL")
def s18_property_keys(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entities").where("props is not null").select(F.col("entity_type").alias("label"), F.col("props").alias("properties"))
    return stats.property_keys(e)


@query(trade(_trails("N1") + ", g1 AS (SELECT a AS s, b AS last FROM adj WHERE a = 'N2' AND a <> b), g2 AS (SELECT x.b AS last FROM g1 JOIN adj x ON x.a = g1.last WHERE x.b <> 'N2') SELECT DISTINCT id, name FROM nodes WHERE id IN (SELECT last FROM h2) AND id IN (SELECT last FROM g2)"))
def u6_shared_ends(spark: SparkSession, d: str) -> DataFrame:
    g = _trade(spark, d)
    return paths.shared_ends(*[paths.describe(g, paths.trails(g, [n], max_hops=2)[1]) for n in ("N1", "N2")])


@query(trade(_trails("C1", "LOCATED_IN") + """, p AS (SELECT 1 AS hops, nodes, eids FROM h1 UNION ALL SELECT 2, nodes, eids FROM h2), f AS (SELECT *, row_number() OVER (ORDER BY hops, list_aggregate(eids, 'string_agg', chr(1)), list_aggregate(nodes, 'string_agg', chr(1))) AS rank FROM p QUALIFY rank <= 60),
t AS (SELECT rank, i, n.name AS subj, m.name AS obj FROM f, unnest(range(1, len(nodes))) AS u(i) JOIN nodes n ON n.id = nodes[i] JOIN nodes m ON m.id = nodes[i + 1])
SELECT subj, 'LOCATED_IN' AS rel, obj, min(rank)::BIGINT AS rank FROM t GROUP BY subj, obj"""))
def w11_distinct_triples(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.operators.series import ranked

    found = paths.find_paths(_trade(spark, d), ["C1"], rel_types=["LOCATED_IN"], max_hops=2, top_k=60)
    order = [F.col("hops"), F.array_join("eids", "\x01"), F.array_join("node_ids", "\x01")]
    return paths.distinct_triples(ranked(found, *order)).select("subj", "rel", "obj", F.col("rank").cast("long").alias("rank"))


@query(knowledge("""SELECT DISTINCT id, name, label, 0.85::DOUBLE AS score, 'alias' AS match_type FROM (SELECT n.id, name, label, coalesce(g.degree, 0) AS degree FROM nodes n LEFT JOIN (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id) g USING (id)
  WHERE contains(lower(name), 'pharmaceutical') OR contains(lower(name), 'sun pharmaceutical') OR contains(lower(name), 'cipla') ORDER BY degree DESC, id LIMIT 5)"""))
def t4_resolve_alias(spark: SparkSession, d: str) -> DataFrame:
    return search.resolve(_kg(spark, d), "the pharma", 5).withColumn("score", F.col("score").cast("double"))


@query()
def t3_resolve_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return search.resolve(_kg(spark, d), "Horekebru Papr Mlls")


@query()
def t2_close_names(spark: SparkSession, d: str) -> DataFrame:
    return search.close_names(_kg(spark, d).nodes, "Horekebru Paper Mils Limited")


FACTS = """(SELECT source AS s, CASE WHEN edge_no % 3 = 0 THEN 'Company' WHEN edge_no % 3 = 1 THEN 'Thing' ELSE 'Person' END AS kind, target AS o, predicate, props.confidence AS confidence FROM relationships
  WHERE source IS NOT NULL AND target IS NOT NULL AND lower(trim(source)) NOT IN ('', 'none', 'null', 'n/a', 'unknown') AND lower(trim(target)) NOT IN ('', 'none', 'null', 'n/a', 'unknown'))"""


def _facts(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "relationships")
    kind = F.when(F.col("edge_no") % 3 == 0, "Company").when(F.col("edge_no") % 3 == 1, "Thing").otherwise("Person")
    time = F.lit(None).cast("struct<t_announce:string,t_effective:string,t_observe:string,t_impact:string>")
    return r.select(
        F.col("source").alias("subject"), kind.alias("subject_type"), "predicate", F.col("target").alias("object"), F.lit("Company").alias("object_type"), F.col("props.confidence").alias("confidence"),
        F.col("props.sentiment").alias("sentiment"), time.alias("temporal"), F.lit(None).cast("string").alias("source_text"),
    )


@query(f"""WITH f AS (SELECT trim(s) AS s, CASE WHEN kind = 'Thing' THEN 'Indicator' ELSE kind END AS kind, trim(o) AS o, coalesce(confidence, 0.8) AS c FROM {FACTS}), n AS (SELECT s AS name, kind AS label, c FROM f UNION ALL SELECT o, 'Company', c FROM f)
SELECT replace(replace(upper(name), ' ', '_'), '-', '_')[:32] || '_' || sha256(lower(name) || '::' || lower(label))[:8] AS id, min(name) AS name, label, round(max(c), 4)::DOUBLE AS confidence FROM n GROUP BY 1, label""")
def g16_facts_to_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.facts_to_graph(_facts(spark, d)).nodes.select("id", "name", "label", F.round("confidence", 4).alias("confidence"))


@query(f"""WITH f AS (SELECT trim(s) AS s, CASE WHEN kind = 'Thing' THEN 'indicator' ELSE lower(kind) END AS kind, trim(o) AS o, coalesce(confidence, 0.8) AS c,
  regexp_replace(regexp_replace(regexp_replace(predicate, '^\\s+|\\s+$', '', 'g'), '[\\s\\-]+', '_', 'g'), '[^A-Za-z0-9_]', '', 'g') AS p FROM {FACTS}),
e AS (SELECT replace(replace(upper(s), ' ', '_'), '-', '_')[:32] || '_' || sha256(lower(s) || '::' || kind)[:8] AS src, replace(replace(upper(o), ' ', '_'), '-', '_')[:32] || '_' || sha256(lower(o) || '::company')[:8] AS dst, CASE WHEN coalesce(p, '') = '' THEN 'RELATED_TO' ELSE upper(p) END AS rel, c FROM f)
SELECT src, dst, rel, count(*)::BIGINT AS n, round(sum(c), 3)::DOUBLE AS confidence FROM e GROUP BY src, dst, rel""")
def g16_facts_to_edges(spark: SparkSession, d: str) -> DataFrame:
    e = graph.facts_to_graph(_facts(spark, d)).edges
    return e.groupBy("src", "dst", "rel").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 3).alias("confidence"))



@query(trade("SELECT from_id, to_id, rel FROM (SELECT a AS from_id, b AS to_id, rel FROM adj WHERE a = (SELECT n.id FROM nodes n LEFT JOIN degree g USING (id) WHERE contains(lower(name), 'nation_1') ORDER BY coalesce(g.degree, 0) DESC, n.id LIMIT 1) ORDER BY eid, a LIMIT 20)"))
def j2_neighbours_by_name(spark: SparkSession, d: str) -> DataFrame:
    return search.neighbours_of(_trade(spark, d), "Nation_1").select("from_id", "to_id", "rel")


@query(trade(_trails("N1") + """, f AS (SELECT nodes, eids FROM h1 UNION ALL SELECT nodes, eids FROM h2), k AS (SELECT list_aggregate(nodes, 'string_agg', '>') AS nodes, list_aggregate(eids, 'string_agg', chr(1)) AS key FROM f
  ORDER BY len(eids), key LIMIT 80) SELECT nodes, count(DISTINCT key)::BIGINT AS n FROM k GROUP BY nodes"""))
def w10_distinct_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of two searches that overlap, each once by its id."""
    g = _trade(spark, d).store(Cuts(spark, "w10"))
    both = paths.find_paths(g, ["N1"], max_hops=1, top_k=30).unionByName(paths.find_paths(g, ["N1"], max_hops=2, top_k=80))
    return paths.first_seen(both.withColumn("seq", F.lit(0)), "seq").groupBy(F.array_join("node_ids", ">").alias("nodes")).agg(F.count("*").alias("n"))


@query(trade("SELECT 'S' || s_suppkey || '|OPERATES_IN|N' || min(n_nationkey) AS eid FROM supplier, nation WHERE s_nationkey = n_nationkey GROUP BY s_suppkey"))
def j11_operates_in(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers by name to nations by name; names that are no nodes' give no edge."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    known = s.join(n, s.s_nationkey == n.n_nationkey).select(F.concat(F.lit(" "), F.lower("s_name")).alias("name"), F.col("n_name").alias("group"))
    odd = n.select(F.lit("No such supplier").alias("name"), F.col("n_name").alias("group")).unionByName(s.select(F.col("s_name").alias("name"), F.lit("nowhere").alias("group")))
    return graph.mapping_edges(known.unionByName(known).unionByName(odd), _trade(spark, d).nodes.where("label in ('Supplier', 'Nation')")).select("eid")


#: A small graph with known answers (names and relations as in the questions below).
TOY = (
    [("infosys", "Infosys", "Company"), ("wipro", "Wipro", "Company"), ("sebi", "SEBI", "Regulator"), ("it_sector", "IT Sector", "Sector"), ("salil_parekh", "Salil Parekh", "Person")],
    [("e0", "infosys", "CEO_OF", "salil_parekh", "2018-01-02"), ("e1", "infosys", "OPERATES_IN", "it_sector", None), ("e2", "wipro", "OPERATES_IN", "it_sector", None), ("e3", "sebi", "REGULATES", "infosys", None), ("e4", "sebi", "REGULATES", "wipro", None)],
)


def toy(spark: SparkSession) -> graph.Graph:
    nodes = spark.createDataFrame(TOY[0], "id string, name string, label string")
    edges = spark.createDataFrame([(*e, None, "toy") for e in TOY[1]], "eid string, src string, rel string, dst string, t_announce string, t_effective string, source string")
    return graph.Graph(nodes, edges, stored=True)


#: Paths of equal score are in order of their ids, which are hashes (fixed values).
@query("""SELECT * FROM (VALUES ('Which sector does Infosys operate in?', 0::BIGINT, 'infosys>it_sector', 'e1'), ('Which sector does Infosys operate in?', 1, 'infosys>it_sector>wipro', 'e1 e2'), ('What about Wipro?', 0, 'wipro>sebi', 'e4'), ('What about Wipro?', 1, 'wipro>it_sector', 'e2'),
  ('What about Wipro?', 2, 'wipro>sebi>infosys', 'e4 e3')) t(question, place, nodes, edges)""")
def g9_step_paths(spark: SparkSession, d: str) -> DataFrame:
    """Best paths of questions on a fixed graph: linked, searched, scored."""
    from graphloom.plans.engine import Engine

    engine = Engine(toy(spark))
    rows = []
    for q in ("Which sector does Infosys operate in?", "What about Wipro?"):
        rows += [(q, i, ">".join(r["node_ids"]), " ".join(r["eids"])) for i, r in enumerate(engine.ask(q, session=q).paths)]
    return spark.createDataFrame(rows, "question string, place long, nodes string, edges string")


@query("""SELECT * FROM (VALUES ('connection between Infosys and Wipro', 'multi_hop_chain', 2::BIGINT, 'wipro'), ('Which sector does Infosys operate in?', 'single_hop', 1, 'infosys')) t(question, kind, steps, start)""")
def g10_plan_run(spark: SparkSession, d: str) -> DataFrame:
    """How plans run on the fixed graph: kind, steps and where the best path starts."""
    from graphloom.plans.engine import Engine

    engine = Engine(toy(spark))
    rows = []
    for q in ("connection between Infosys and Wipro", "Which sector does Infosys operate in?"):
        a = engine.ask(q, session=q)
        rows.append((q, a.plan.kind, len(a.plan.steps), a.paths[0]["node_ids"][0] if a.paths else None))
    return spark.createDataFrame(rows, "question string, kind string, steps long, start string")
