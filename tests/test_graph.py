import itertools
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from graphloom.operators import clean, merge, paths, search, stats
from graphloom.operators.components import components
from graphloom.operators.graph import Graph, facts_to_graph, with_default_properties
from graphloom import schema
from tests.toy import EDGES, graph_of, toy_graph


@pytest.fixture(scope="module")
def toy(spark):
    return toy_graph(spark)


def ids(df):
    return sorted(tuple(r["node_ids"]) for r in df.collect())


def test_search_orders_by_degree(toy):
    rows = search.search_nodes(toy, "I").collect()
    assert rows[0]["id"] == "infosys" and rows[0]["degree"] == 4
    assert search.search_nodes(toy, "nothing").count() == 0


def test_neighbours_directions(toy):
    near = {(r["to_id"], r["direction"]) for r in search.neighbours(toy, ["infosys"]).collect()}
    assert near == {("salil_parekh", "outgoing"), ("it_sector", "outgoing"), ("sebi", "incoming"), ("narayana_murthy", "incoming")}
    assert [r["to_id"] for r in search.neighbours(toy, ["infosys"], ["founded"]).collect()] == ["narayana_murthy"]
    assert search.neighbours(toy, ["infosys"], after="2000-01-01", direction="out").count() == 1


def test_simple_paths(toy):
    found = ids(paths.simple_paths(toy, ["sebi"], max_hops=2))
    assert ("sebi", "infosys", "salil_parekh") in found and ("sebi", "wipro", "it_sector") in found
    assert ids(paths.simple_paths(toy, ["sebi"], ["it_sector"], 2)) == [("sebi", "infosys", "it_sector"), ("sebi", "wipro", "it_sector")]


def test_resolve_stages(toy):
    assert search.resolve(toy, "infosys").first()["match_type"] == "exact"
    assert search.resolve(toy, "infy").first().asDict() | {"score": 0} == {"id": "infosys", "name": "Infosys", "label": "Company", "score": 0, "match_type": "alias"}
    fuzzy = search.resolve(toy, "infossys").first()
    assert fuzzy["id"] == "infosys" and fuzzy["match_type"] == "fuzzy" and fuzzy["score"] < 0.65
    assert search.close_names(toy.nodes, "Wipr").first()["name"] == "Wipro"


def brute_trails(edges, start, max_hops):
    """All trails by enumeration, under the same rules."""
    adj = [(i, a, b) for i, (a, _, b) in enumerate(edges)] + [(i, b, a) for i, (a, _, b) in enumerate(edges) if a != b]
    out, walks = [], [((start,), ())]
    for hop in range(1, max_hops + 1):
        nxt = [(n + (b,), e + (i,)) for n, e in walks for i, a, b in adj if a == n[-1] and i not in e]
        out += [n for n, e in nxt if n[-1] != start and n[1] != start and (hop < 3 or n[3] != n[1])]
        walks = nxt
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_trails_equal_enumeration(spark, seed):
    r = random.Random(seed)
    names = [f"n{i}" for i in range(6)]
    edges = [(r.choice(names), r.choice("XY"), r.choice(names)) for _ in range(9)]
    g = graph_of(spark, [(n, n.upper(), "L") for n in names], edges)
    found = sorted(itertools.chain.from_iterable(ids(paths.describe(g, h)) for h in paths.trails(g, ["n0"])))
    assert found == brute_trails(edges, "n0", 3)
    assert ids(paths.find_paths(g, ["n0"], top_k=4)) == ids(paths.find_paths(g, ["n0"], top_k=4, progressive=False))


def test_scores(toy):
    found = paths.simple_paths(toy, ["infosys"], max_hops=1)
    best = paths.score_paths(found, 0.9, after="2018-01-01", words=["parekh"]).first()
    assert best["node_names"] == ["Infosys", "Salil Parekh"]
    assert best["score"] == round(0.35 * 0.75 + 0.25 * 0.9 + 0.2 + 0.15, 4)


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    r = random.Random(seed)
    rows = [(f"{r.randrange(40):02d}", f"{r.randrange(40):02d}") for _ in range(30)] + [("a", None), ("z", "z")]
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in rows:
        if b is not None:
            parent.setdefault(a, a), parent.setdefault(b, b)
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert {tuple(x) for x in components(spark.createDataFrame(rows, "a string, b string")).collect()} == {(x, find(x)) for x in parent}


DIRTY_NODES = [("a", "Alpha", "Company"), ("b", "joint venture", "Company"), ("c", "Gamma", "Person"), ("d", "Delta", "Person"), ("e", None, "Company")]
DIRTY_EDGES = [("a", "works with", "c"), ("a", "WORKS-WITH", "c"), ("a", "x", "a"), ("b", "x", "c"), ("c", "x", "ghost"), ("a", "y", "e")]


def test_clean_and_audit(spark):
    g = graph_of(spark, DIRTY_NODES, DIRTY_EDGES)
    once = clean.clean(g)
    edges = {(r["src"], r["rel"], r["dst"]) for r in once.edges.collect()}
    assert edges == {("a", "WORKS_WITH", "c"), ("a", "Y", "e")}
    assert {r["id"] for r in once.nodes.collect()} == {"a", "c", "e"}
    twice = clean.clean(once)
    assert {(r["src"], r["rel"], r["dst"]) for r in twice.edges.collect()} == edges
    row = clean.audit(g).first()
    assert (row["loops"], row["repeated"], row["noise_nodes"], row["noise_edges"], row["orphans"], row["broken"]) == (1, 1, 1, 1, 1, 1)


def test_clean_empty(spark):
    g = graph_of(spark, [], [])
    assert clean.clean(g).edges.count() == 0 and clean.audit(g).first()["edges_left"] == 0
    assert stats.graph_stats(g).first()["n_nodes"] == 0


def test_merge_entities(spark):
    nodes = [("1", "Zentara Mills Ltd", "Company"), ("2", "Zentara Mills Limited", "Company"), ("3", "Zentara Mils", "Company"), ("4", "Infosys", "Company"), ("5", "Infosys Ltd.", "Company"), ("6", "Zentara Mills", "Event")]
    g = graph_of(spark, nodes, [("1", "R", "4"), ("2", "R", "5"), ("1", "R", "2"), ("3", "S", "5")])
    merged, plan = merge.merge_entities(g)
    names = {r["name"] for r in merged.nodes.collect()}
    assert names == {"Zentara Mills Limited", "Infosys Ltd", "Zentara Mills"}
    assert merged.edges.count() == 2
    assert {r["id"]: r["to"] for r in plan.collect()} == {"1": "2", "2": "2", "3": "2", "4": "5", "5": "5"}


def test_ratio_is_directional(spark):
    from difflib import SequenceMatcher

    pairs = [("abcdefgh", "hgfedcba"), ("tide", "diet"), ("diet", "tide"), ("", "x")]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("r", merge.ratio(F.col("a"), F.col("b")))
    for r in df.collect():
        assert r["r"] == SequenceMatcher(None, r["a"], r["b"]).ratio()


def test_incremental_matches(spark):
    new = spark.createDataFrame([("n1", "Zentara Mills", "Company"), ("n2", "Zentara Mill", "Company"), ("n3", "abc", "Company"), ("n4", "Zentara Mills", "Person")], "id string, name string, label string")
    old = spark.createDataFrame([("o1", "Zentara Mills Ltd", "Company"), ("o2", "Other", "Company")], "id string, name string, label string")
    assert {tuple(r) for r in merge.incremental_matches(new, old).collect()} == {("n1", "n2"), ("n1", "o1")}


@pytest.mark.parametrize("seed", range(2))
def test_incremental_matches_lose_no_pair(spark, seed):
    from difflib import SequenceMatcher

    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abcd") for _ in range(n))
    names = [word(r.randint(1, 12)) for _ in range(60)]
    names += [n[:i] + r.choice("abcd") + n[i + r.randint(0, 1) :] for n in names for i in [r.randint(0, len(n))]]
    names = [n.upper() for n in names] + ["Abcabc Ltd", "ABCABC LIMITED"]
    rows = [(f"{i:03d}", n, "Company") for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "id string, name string, label string")
    strip = lambda n: n.lower().removesuffix(" ltd").removesuffix(" limited")
    want = {
        (a, b)
        for a, x, _ in rows
        for b, y, _ in rows
        if a < b and len(x) > 1 and len(y) > 1 and (strip(x) == strip(y) and len(strip(x)) >= 4 or SequenceMatcher(None, x.lower(), y.lower()).ratio() >= 0.85)
    }
    assert {tuple(p) for p in merge.incremental_matches(df, df.limit(0)).collect()} == want


def test_components_query_takes_every_link(spark, tmp_path):
    import __spark_entry__ as entry

    links = [("a", "b", 0.99), ("b", "c", 0.4), ("d", "c", None), ("e", "f", 0.95), ("g", "g", 0.1), (None, "h", 1.0)]
    spark.createDataFrame(links, "left_id string, right_id string, score double").write.parquet(str(tmp_path / "entity_matches.parquet"))
    found = {tuple(r) for r in entry.queries()["a10_components"](spark, str(tmp_path)).collect()}
    assert found == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("e", "e"), ("f", "e"), ("g", "g")}


def brute_normal(t):
    t = "".join(c for c in t.lower() if unicodedata.category(c)[0] != "C").replace("`", "'")
    return re.sub(r"\s+", " ", re.sub("[–—]", "-", t)).strip()


def test_normalise_query_takes_every_message(spark, data, tmp_path):
    import __spark_entry__ as entry

    texts = ["Q1–Q2 — “Infosys’ RESULTS”", "soft\u00adhyphen\u200b \ufeffBOM", "\u00a0NO\u00a0\u2003BREAK\u2028line ", "ÉTÉ `quoted`\tTAB\r\nbreak", "टाटा\u200d स्टील  RESULTS", "ＦＵＬＬ\u3000width 😀 \ue000", "plain  ASCII", "", "–", None]
    spark.createDataFrame(list(enumerate(texts)), "request_id long, message string").write.parquet(str(tmp_path / "chat_requests.parquet"))
    for d in (str(tmp_path), data):
        want = {r["request_id"]: brute_normal(r["message"]) for r in spark.read.parquet(f"{d}/chat_requests.parquet").where("message is not null").collect()}
        assert {r["request_id"]: r["normal"] for r in entry.queries()["t15_normalise_english"](spark, d).collect()} == want


def test_upsert_keeps_old_where_new_is_null(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, name string, v double")
    new = spark.createDataFrame([(2, None, 5.0), (3, "c", 3.0), (3, "d", 4.0)], "id int, name string, v double")
    rows = {tuple(r) for r in merge.upsert(old, new, ["id"], "v").collect()}
    assert rows == {(1, "a", 1.0), (2, "b", 5.0), (3, "d", 4.0)}


def test_facts(spark):
    facts = [
        ("Infosys", "Company", "announced results", "Q1", "Thing", None, None, ("2024-01-01", None, None, None), "text", {}),
        ("none", "Company", "x", "Y", "Company", 0.5, 0.1, None, None, None),
        ("Infosys", "Person", "x", "Y", "Company", 0.5, 0.1, None, None, None),
    ]
    g = facts_to_graph(spark.createDataFrame(facts, schema.FACTS))
    labels = {(r["name"], r["label"]) for r in g.nodes.collect()}
    assert labels == {("Infosys", "Company"), ("Infosys", "Person"), ("Q1", "Indicator"), ("Y", "Company")}
    e = {r["rel"]: r for r in g.edges.collect()}
    assert e["ANNOUNCED_RESULTS"]["confidence"] == 0.8 and e["ANNOUNCED_RESULTS"]["t_announce"] == "2024-01-01"


def test_default_properties(spark):
    df = spark.createDataFrame([("Person", {"role": "CEO"}), ("Company", None), ("Odd", {"k": "v"})], "type string, properties map<string,string>")
    rows = {r["type"]: r["properties"] for r in with_default_properties(df).collect()}
    assert rows["Person"] == {"role": "CEO", "affiliation": None} and set(rows["Company"]) == {"ticker", "sector", "exchange", "market_cap", "industry"} and rows["Odd"] == {"k": "v"}


def test_simple_graph(toy):
    e = toy.edges.unionByName(toy.edges.limit(1).withColumn("eid", F.lit("z")).withColumn("rel", F.lit("LAST")))
    kept = Graph(toy.nodes, e).simple().edges
    assert kept.count() == len(EDGES) and kept.where("rel = 'LAST'").count() == 1
