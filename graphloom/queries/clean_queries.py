"""Queries on cleaning, upserts and entity resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import vocab
from graphloom.functions import text
from graphloom.operators import clean, components, graph, merge
from graphloom.queries.registry import query
from graphloom.queries.sql import knowledge, trade
from graphloom.session import table


def _kg(spark: SparkSession, d: str) -> graph.Graph:
    return graph.knowledge_graph(table(spark, d, "entities"), table(spark, d, "relationships"))


@query(knowledge("SELECT edge_no FROM edges WHERE src <> dst"))
def f9_without_loops(spark: SparkSession, d: str) -> DataFrame:
    return clean.without_loops(_kg(spark, d).edges).select("edge_no")


NOISE = " OR ".join(f"(label = '{label}' AND lower(trim(name)) IN ({', '.join(repr(n) for n in names)}))" for label, names in vocab.LABEL_NOISE.items())


@query(f"""WITH n AS (SELECT id, name, label FROM (SELECT id, coalesce(min(name), '') AS name, min(entity_type) AS label FROM entities WHERE id IS NOT NULL GROUP BY id)
UNION ALL SELECT label || name, upper(name) || ' ', label FROM (VALUES {", ".join(f"('{n}')" for n in sorted({n for ns in vocab.LABEL_NOISE.values() for n in ns}))}) a(name), (VALUES ('Company'), ('Indicator'), ('Policy'), ('Person')) b(label))
SELECT id FROM n WHERE NOT ({NOISE})""")
def f10_without_noise(spark: SparkSession, d: str) -> DataFrame:
    """The stored nodes, and a node of each noise name under each label, most of which are noise under another label only."""
    g = _kg(spark, d)
    names = sorted({n for ns in vocab.LABEL_NOISE.values() for n in ns})
    odd = spark.createDataFrame([(label + n, n.upper() + " ", label) for n in names for label in ("Company", "Indicator", "Policy", "Person")], "id string, name string, label string")
    return clean.without_noise(graph.Graph(g.nodes.select("id", "name", "label").unionByName(odd), g.edges)).nodes.select("id")


@query(knowledge("SELECT edge_no FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)"))
def f16_without_broken(spark: SparkSession, d: str) -> DataFrame:
    return clean.without_broken(_kg(spark, d)).edges.select("edge_no")


@query(knowledge("SELECT id FROM nodes WHERE id IN (SELECT src FROM edges WHERE src IS NOT NULL UNION SELECT dst FROM edges WHERE dst IS NOT NULL)"))
def j9_without_orphans(spark: SparkSession, d: str) -> DataFrame:
    return clean.without_orphans(_kg(spark, d)).nodes.select("id")


@query(knowledge("SELECT edge_no FROM edges WHERE coalesce(src NOT IN (SELECT upper(trim(id)) FROM entity_deletions), true) AND coalesce(dst NOT IN (SELECT upper(trim(id)) FROM entity_deletions), true)"))
def j10_without_deleted(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "entity_deletions").select(F.upper(F.trim("id")).alias("id")).distinct()
    return clean.without_ends(_kg(spark, d).edges, gone).select("edge_no")


@query(knowledge("SELECT src, rel, dst, min(edge_no) AS edge_no FROM edges GROUP BY src, rel, dst"))
def w6_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return clean.keep_first(_kg(spark, d).edges, ["src", "rel", "dst"], "edge_no").select("src", "rel", "dst", "edge_no")


CLEANED = f"""
, once AS (SELECT src, rel, dst, min(edge_no) AS edge_no FROM edges WHERE src <> dst GROUP BY src, rel, dst),
quiet_nodes AS (SELECT * FROM nodes WHERE NOT ({NOISE})),
quiet AS (SELECT * FROM once WHERE src NOT IN (SELECT id FROM nodes WHERE {NOISE}) AND dst NOT IN (SELECT id FROM nodes WHERE {NOISE})),
placed AS (SELECT * FROM quiet_nodes WHERE id IN (SELECT src FROM quiet UNION SELECT dst FROM quiet)),
whole AS (SELECT * FROM quiet WHERE src IN (SELECT id FROM placed) AND dst IN (SELECT id FROM placed))
"""


@query(knowledge(CLEANED + "SELECT 'edge' AS kind, edge_no::VARCHAR AS key FROM whole UNION ALL SELECT 'node', id FROM placed"))
def g15_clean(spark: SparkSession, d: str) -> DataFrame:
    g = clean.clean(_kg(spark, d), "edge_no")
    return g.edges.select(F.lit("edge").alias("kind"), F.col("edge_no").cast("string").alias("key")).unionByName(g.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("key")))


@query(knowledge(CLEANED + """SELECT (SELECT count(*) FROM edges WHERE src = dst)::BIGINT AS loops, ((SELECT count(*) FROM edges) - (SELECT count(*) FROM edges WHERE src = dst) - (SELECT count(*) FROM once))::BIGINT AS repeated,
  ((SELECT count(*) FROM quiet_nodes) - (SELECT count(*) FROM placed))::BIGINT AS orphans, ((SELECT count(*) FROM quiet) - (SELECT count(*) FROM whole))::BIGINT AS broken, (SELECT count(*) FROM placed)::BIGINT AS nodes_left, (SELECT count(*) FROM whole)::BIGINT AS edges_left"""))
def a16_audit(spark: SparkSession, d: str) -> DataFrame:
    g = _kg(spark, d)
    return clean.audit(g, "edge_no").select("loops", "repeated", "orphans", "broken", "nodes_left", "edges_left")


@query("""SELECT id, name, confidence FROM (SELECT id, name, round(confidence, 4) AS confidence, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, confidence DESC) AS rn FROM entities WHERE id IS NOT NULL) WHERE rn = 1""")
def w7_last_write(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entities").where("id is not null").select("id", "name", F.round("confidence", 4).alias("confidence"), F.struct("updated_at", "confidence").alias("version"))
    return merge.last_write(e, ["id"], "version").select("id", "name", "confidence")


@query("""WITH v AS (SELECT id, name, label, round(confidence, 4) AS confidence, updated_at, created_at FROM entities WHERE id IS NOT NULL),
a AS (SELECT id, arg_min(struct_pack(name, label, confidence), (updated_at, coalesce(confidence, -1), coalesce(label, ''), coalesce(name, ''))) AS r FROM v GROUP BY id), b AS (SELECT id, arg_max(struct_pack(name, label, confidence), (updated_at, coalesce(confidence, -1), coalesce(label, ''), coalesce(name, ''))) AS r FROM v WHERE updated_at > created_at GROUP BY id)
SELECT id, coalesce(b.r.name, a.r.name) AS name, coalesce(b.r.label, a.r.label) AS label, coalesce(b.r.confidence, a.r.confidence)::DOUBLE AS confidence FROM a LEFT JOIN b USING (id)""")
def k4_upsert(spark: SparkSession, d: str) -> DataFrame:
    """First versions of all entities, and onto them all later ones."""
    v = table(spark, d, "entities").where("id is not null").select("id", "name", "label", F.round("confidence", 4).alias("confidence"), "created_at", F.struct("updated_at", F.coalesce("confidence", F.lit(-1.0)).alias("c"), F.coalesce("label", F.lit("")).alias("l"), F.coalesce("name", F.lit("")).alias("n")).alias("version"))
    old = v.groupBy("id").agg(F.min_by(F.struct("name", "label", "confidence"), "version").alias("r")).select("id", "r.*")
    return merge.upsert(old, v.where("version.updated_at > created_at").select("id", "name", "label", "confidence", "version"), ["id"], "version")


@query(trade("""SELECT count(*)::BIGINT AS n, sum((k = 'new')::INT)::BIGINT AS replaced, sum((k = 'old')::INT)::BIGINT AS kept FROM (SELECT eid, CASE WHEN rel IN ('PART_OF', 'SUPPLIES') THEN 'new' ELSE 'old' END AS k FROM edges)"""))
def k5_upsert_edges(spark: SparkSession, d: str) -> DataFrame:
    """All edges, and again those of two relations from another source; a null there leaves what is stored."""
    from graphloom.sources.sinks import upsert_edges

    e = graph.trade_graph(spark, d).edges
    new = e.where("rel in ('PART_OF', 'SUPPLIES')").withColumns({"source": F.lit("again"), "t_announce": F.lit(None).cast("string")})
    out = upsert_edges(e, new, by_relation_id=True)
    return out.agg(F.count("*").alias("n"), F.sum((F.col("source") == "again").cast("long")).alias("replaced"), F.sum((F.col("source") == "trade").cast("long")).alias("kept"))


@query("""SELECT coalesce(count(*), 0)::BIGINT AS skipped FROM relationships WHERE NOT (coalesce(upper(trim(source)) IN (SELECT id FROM entities), false) AND coalesce(upper(trim(target)) IN (SELECT id FROM entities), false))""")
def k7_skipped_edges(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.sources.sinks import loadable_edges

    return loadable_edges(_kg(spark, d))[1]


@query("""SELECT 'node' AS kind, 'N' || n_nationkey AS key, 'again ' || n_name AS said FROM nation UNION ALL SELECT 'node', 'S' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'node', 'R' || r_regionkey, r_name FROM region
UNION ALL SELECT 'edge', 'N' || n_nationkey || '|PART_OF|R' || n_regionkey, 'second' FROM nation UNION ALL SELECT 'edge', 'S' || s_suppkey || '|LOCATED_IN|N' || s_nationkey, 'first' FROM supplier""")
def u1_merge_graphs(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers in nations, and nations in regions: both have the nations and their edges, the second under other names and another source."""
    g = graph.trade_graph(spark, d)
    pick = lambda labels, rels, name, source: graph.Graph(g.nodes.where(F.col("label").isin(*labels)).withColumn("name", name), g.edges.where(F.substring("src", 1, 1).isin(*rels)).where("rel in ('PART_OF', 'LOCATED_IN')").withColumn("source", F.lit(source)))
    first = pick(["Supplier", "Nation"], ["S", "N"], F.col("name"), "first")
    second = pick(["Nation", "Region"], ["N"], F.when(F.col("label") == "Nation", F.concat(F.lit("again "), "name")).otherwise(F.col("name")), "second")
    out = merge.merge_graphs(first, second)
    return out.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("key"), F.col("name").alias("said")).unionByName(out.edges.select(F.lit("edge").alias("kind"), F.col("eid").alias("key"), F.col("source").alias("said")))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT left_id AS a, right_id AS b FROM entity_matches WHERE left_id IS NOT NULL AND right_id IS NOT NULL), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(id, seen) AS (SELECT a, a FROM s UNION SELECT r.id, s.b FROM reach r JOIN s ON s.a = r.seen) SELECT id, min(seen) AS component FROM reach GROUP BY id""")
def a10_components(spark: SparkSession, d: str) -> DataFrame:
    return components.components(table(spark, d, "entity_matches"), "left_id", "right_id")


NORM = "regexp_replace(trim(lower(name)), '\\s+', ' ', 'g')"


def _stripped(expression: str) -> str:
    from graphloom import vocab

    out = expression
    for s in vocab.LEGAL_SUFFIXES:
        out = f"list_transform([{out}], lambda x: CASE WHEN ends_with(x, '{s}') THEN trim(x[:-{len(s) + 1}]) ELSE x END)[1]"
    return out


PROTECTED = "'jio','retail','power','infrastructure','capital','securities','insurance','finance','bank','asset','petroleum','energy','pharma','healthcare','motors','auto','steel','cement','telecom','media','realty','housing','ventures','foundation','mutual fund','amc','trustee','mobility'"
NEVER = r"""regexp_matches(trim(name), '^\d') OR regexp_matches(trim(name), '^-?\d') OR regexp_matches(trim(name), '^\$') OR regexp_matches(trim(name), '(?i)^rs\b') OR regexp_matches(trim(name), '^₹') OR regexp_matches(trim(name), '(?i)\bfy\d{2}')
  OR regexp_matches(trim(name), '\b20\d{2}-\d{2}-\d{2}\b') OR regexp_matches(trim(name), '(?i)\d+\s*(crore|lakh|mtpa|million|billion|shares|points|percent|per\s+cent)\b')"""
BLOCKS = f"""
, n AS (SELECT DISTINCT label, {_stripped(NORM)} AS norm FROM nodes WHERE label NOT IN ('Event', 'Policy') AND name <> '' AND NOT ({NEVER})),
pairs AS (SELECT x.label, x.norm AS a, y.norm AS b FROM n x JOIN n y ON x.label = y.label AND x.norm[:3] = y.norm[:3] AND x.norm < y.norm WHERE x.norm <> '')
"""


@query(knowledge(BLOCKS + "SELECT label, a, b FROM pairs"))
def j7_block_pairs(spark: SparkSession, d: str) -> DataFrame:
    return merge.block_pairs(_kg(spark, d).nodes)


@query(knowledge(BLOCKS + f"""SELECT label, a, b FROM pairs WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest([{PROTECTED}]) AS p) WHERE contains(a, p) AND contains(b, p))
  AND 1 - levenshtein(a, b) / greatest(length(a), length(b)) >= CASE WHEN label = 'Indicator' THEN 0.92 ELSE 0.88 END"""))
def g11_similar_names(spark: SparkSession, d: str) -> DataFrame:
    return merge.similar_pairs(merge.block_pairs(_kg(spark, d).nodes), measure="levenshtein")


@query()
def g11_merge_entities(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_entities(_kg(spark, d), order="edge_no")[1]


@query()
def g12_incremental_matches(spark: SparkSession, d: str) -> DataFrame:
    n = _kg(spark, d).nodes
    late = n.where("updated_at >= '2023-06-01'")
    return merge.incremental_matches(late, n.where("updated_at < '2023-06-01'"))


@query("""WITH m AS (SELECT p_name AS g, p_partkey AS seq, p_brand || ' ' || p_type AS name, p_size / 50.0 AS c FROM part),
s AS (SELECT *, c * least(len(string_split_regex(trim(name), '\\s+')) / 2.0, 1.5) * CASE WHEN length(trim(name)) <= 2 THEN 0.5 ELSE 1 END AS worth FROM m),
b AS (SELECT g, name, row_number() OVER (PARTITION BY g ORDER BY worth DESC, seq) AS rn FROM s)
SELECT g AS group_key, name, replace(replace(upper(trim(name)), ' ', '_'), '-', '_')[:32] || '_' || sha256(lower(trim(name)) || '::part')[:8] AS id FROM b WHERE rn = 1""")
def g13_pick_incremental(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "part").select(F.col("p_name").alias("group_key"), F.col("p_partkey").alias("seq"), F.concat_ws(" ", "p_brand", "p_type").alias("name"), (F.col("p_size") / 50.0).alias("confidence"), F.lit("Part").alias("label"))
    return merge.pick_incremental(m).select("group_key", "name", "id")


@query("""WITH m AS (SELECT p_name AS g, 'P' || p_partkey AS id, p_type AS name FROM part), b AS (SELECT g, id, name, row_number() OVER (PARTITION BY g ORDER BY length(name) DESC, id) AS rn, count(*) OVER (PARTITION BY g) AS n FROM m)
SELECT g AS group_key, id AS canonical_id, name AS canonical_name, n::BIGINT AS size FROM b WHERE rn = 1""")
def g14_canonical_names(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "part").select(F.col("p_name").alias("group_key"), F.concat(F.lit("P"), "p_partkey").alias("id"), F.col("p_type").alias("name"), F.lit("Part").alias("label"))
    return merge.canonical_names(m)


@query(knowledge("""SELECT edge_no, coalesce(a.g, src) AS src, coalesce(b.g, dst) AS dst FROM edges LEFT JOIN (SELECT left_id AS id, min(right_id) AS g FROM entity_matches WHERE right_id IS NOT NULL GROUP BY left_id) a ON a.id = src
  LEFT JOIN (SELECT left_id AS id, min(right_id) AS g FROM entity_matches WHERE right_id IS NOT NULL GROUP BY left_id) b ON b.id = dst"""))
def j6_rewire(spark: SparkSession, d: str) -> DataFrame:
    redirect = table(spark, d, "entity_matches").where("right_id is not null and left_id is not null").groupBy(F.col("left_id").alias("id")).agg(F.min("right_id").alias("to"))
    return merge.rewire(_kg(spark, d).edges, redirect).select("edge_no", "src", "dst")


@query(knowledge("""SELECT edge_no, coalesce(m.g, k.id, src) AS src, coalesce(m2.g, k2.id, dst) AS dst FROM edges
  LEFT JOIN (SELECT left_id AS id, min(right_id) AS g FROM entity_matches WHERE right_id IS NOT NULL GROUP BY left_id) m ON m.id = src LEFT JOIN (SELECT lower(trim(name)) AS name, min(id) AS id FROM nodes GROUP BY 1) k ON k.name = lower(trim(src))
  LEFT JOIN (SELECT left_id AS id, min(right_id) AS g FROM entity_matches WHERE right_id IS NOT NULL GROUP BY left_id) m2 ON m2.id = dst LEFT JOIN (SELECT lower(trim(name)) AS name, min(id) AS id FROM nodes GROUP BY 1) k2 ON k2.name = lower(trim(dst))"""))
def j5_remap_ends(spark: SparkSession, d: str) -> DataFrame:
    g = _kg(spark, d)
    ids = table(spark, d, "entity_matches").where("right_id is not null and left_id is not null").groupBy(F.col("left_id").alias("id")).agg(F.min("right_id").alias("to"))
    names = g.nodes.groupBy(F.lower(F.trim("name")).alias("name")).agg(F.min("id").alias("to"))
    return merge.remap_ends(g.edges, ids, names).select("edge_no", "src", "dst")


@query("""SELECT id, round(max(confidence), 4)::DOUBLE AS confidence, arg_min(name, coalesce(epoch_us(updated_at), 0)) FILTER (name IS NOT NULL) AS name FROM entities WHERE id IS NOT NULL GROUP BY id""")
def a8_group_attributes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entities").where("id is not null").select("id", "confidence", "name", F.col("updated_at").alias("seq"))
    return merge.group_attributes(e, ["id"]).select("id", F.round("confidence", 4).alias("confidence"), "name")


@query(knowledge("""SELECT src, rel, dst, n, round(list_reduce(list_prepend(xs[1], xs[2:]), lambda s, x: (s + x) / 2.0), 9)::DOUBLE AS sentiment
  FROM (SELECT src, rel, dst, count(*)::BIGINT AS n, list(sentiment ORDER BY edge_no) AS xs FROM edges WHERE sentiment IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL GROUP BY src, rel, dst)"""))
def a9_sentiment_fold(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.operators.series import running_sentiment

    e = _kg(spark, d).edges.where("src is not null and dst is not null").withColumn("key", F.struct("src", "rel", "dst"))
    return running_sentiment(e, "key", "edge_no", "sentiment").select("key.*", "n", F.round("sentiment", 9).alias("sentiment"))


@query("""SELECT id, replace(replace(upper(trim(name)), ' ', '_'), '-', '_')[:32] || '_' || sha256(lower(trim(name)) || '::' || lower(trim(coalesce(label, ''))))[:8] AS stable FROM (SELECT DISTINCT id, name, label FROM entities WHERE name IS NOT NULL)""")
def t20_stable_ids(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entities").where("name is not null").select("id", "name", "label").distinct()
    return e.select("id", text.stable_id(F.col("name"), F.col("label")).alias("stable"))


@query(f"""SELECT DISTINCT name, {_stripped(NORM)} AS stripped FROM entities WHERE name IS NOT NULL""")
def t18_legal_suffixes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").where("name is not null").select("name", text.strip_legal_suffixes(F.col("name")).alias("stripped")).distinct()


@query(f"SELECT DISTINCT name, ({NEVER}) AS never_merged FROM entities WHERE name IS NOT NULL")
def f13_never_merged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").where("name is not null").select("name", text.is_never_merged(F.col("name")).alias("never_merged")).distinct()


@query(r"""SELECT DISTINCT name, length(trim(name)) < 2 OR regexp_matches(trim(name), '^([\d\s%.,/-]+|\d+(\.\d+)?\s*(million|billion|crore|lakh|thousand|tons?|kg|usd|inr|year|quarter|fy\d*)?|rs\.?\s*[\d.,]*|joint\s+venture|special\s+purpose\s+vehicle|spv|integrated\s+back[\s\-]?end|back[\s\-]?end|front[\s\-]?end|final\s+dividend|interim\s+dividend|trade\s+spotlight|market\s+update|press\s+release|four\s+tranches|multiple\s+tranches|tranches?|(buy|sell|hold|neutral|overweight|underweight)\s*|(overbought|oversold|tepid)\s*(condition|level|zone)?|[a-z]{1,4})$') AS noise FROM entities WHERE name IS NOT NULL""")
def f12_build_noise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").where("name is not null").select("name", text.is_build_noise(F.col("name")).alias("noise")).distinct()


@query(f"SELECT m.match_id, coalesce(list_bool_or(list_transform([{PROTECTED}], lambda p: contains(lower(a.name), p) AND contains(lower(b.name), p))), false) AS protected FROM entity_matches m JOIN (SELECT id, min(name) AS name FROM entities GROUP BY id) a ON a.id = m.left_id JOIN (SELECT id, min(name) AS name FROM entities GROUP BY id) b ON b.id = m.right_id WHERE a.name IS NOT NULL AND b.name IS NOT NULL")
def f14_protected_pairs(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "entities").groupBy("id").agg(F.min("name").alias("name")).where("name is not null")
    m = table(spark, d, "entity_matches").join(n.select(F.col("id").alias("left_id"), F.lower("name").alias("x")), "left_id").join(n.select(F.col("id").alias("right_id"), F.lower("name").alias("y")), "right_id")
    return m.select("match_id", text.is_protected_pair(F.col("x"), F.col("y")).alias("protected"))


@query(knowledge("SELECT sum((a.id IS NOT NULL)::INT + (b.id IS NOT NULL)::INT)::BIGINT AS rewired FROM edges LEFT JOIN (SELECT DISTINCT left_id AS id FROM entity_matches WHERE right_id IS NOT NULL) a ON a.id = src LEFT JOIN (SELECT DISTINCT left_id AS id FROM entity_matches WHERE right_id IS NOT NULL) b ON b.id = dst"))
def j6_rewired_count(spark: SparkSession, d: str) -> DataFrame:
    redirect = table(spark, d, "entity_matches").where("right_id is not null and left_id is not null").select(F.col("left_id").alias("id"))
    return merge.rewired_count(_kg(spark, d).edges, redirect)


@query(f"""WITH n AS (SELECT DISTINCT name, {_stripped(NORM)} AS s FROM entities WHERE name IS NOT NULL)
SELECT a.name AS a, b.name AS b FROM n a JOIN n b ON a.s = b.s AND a.name < b.name WHERE length(a.s) >= 4""")
def t19_same_without_suffix(spark: SparkSession, d: str) -> DataFrame:
    """Names that are equal but for legal suffixes, joined by what is left."""
    n = table(spark, d, "entities").where("name is not null").select("name", text.strip_legal_suffixes(F.col("name")).alias("s")).distinct()
    x, y = n.select("s", F.col("name").alias("a")), n.select("s", F.col("name").alias("b"))
    return x.join(y, "s").where("a < b").where(text.same_without_suffix(F.col("a"), F.col("b"))).select("a", "b")


#: Pairs of texts and their Ratcliff-Obershelp ratios: twice the matched characters over all (fixed values, worked out by hand).
RATIOS = [("abcd", "abcd", 1.0), ("abcd", "bcde", 0.75), ("", "", 1.0), ("a", "", 0.0), ("private thread", "private volatile", 20 / 30), ("tide", "diet", 0.25), ("diet", "tide", 0.5), ("ABC", "abc", 0.0)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {r:.6f}::DOUBLE)" for a, b, r in RATIOS) + ") t(a, b, ratio)")
def t1_ratio(spark: SparkSession, d: str) -> DataFrame:
    pairs = spark.createDataFrame([(a, b) for a, b, _ in RATIOS], "a string, b string")
    return pairs.withColumn("ratio", F.round(merge.ratio(F.col("a"), F.col("b")), 6))


@query(knowledge(f"""SELECT x.id AS a, y.id AS b FROM (SELECT id, label, lower(trim(name)) AS n, {_stripped(NORM)} AS s FROM nodes WHERE trim(name) <> '') x JOIN (SELECT id, label, lower(trim(name)) AS n, {_stripped(NORM)} AS s FROM nodes WHERE trim(name) <> '') y ON x.label = y.label AND x.id < y.id
WHERE (x.s = y.s AND length(x.s) >= 4) OR 1 - levenshtein(x.n, y.n)::DOUBLE / greatest(length(x.n), length(y.n)) >= 0.85"""))
def j8_new_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of new nodes of a label that are alike by Levenshtein distance, or equal but for suffixes; no noise names are among them."""
    n = _kg(spark, d).nodes.where("trim(name) <> ''")
    return merge.incremental_matches(n, n.limit(0), measure="levenshtein")
