"""Lookups on the graph: nodes by name, id or type, and what is next to them."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import vocab
from graphloom.functions import text
from graphloom.functions.temporal import temporal_filter
from graphloom.operators.graph import Graph


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): edges at each node; a loop counts twice, as it has two ends there."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def with_degree(graph: Graph, nodes: DataFrame) -> DataFrame:
    """Degree of the given nodes only: the edges are reduced to those at them before anything is counted."""
    wanted = nodes.select("id")
    ends = graph.edges.select(F.explode(F.array("src", "dst")).alias("id")).join(wanted, "id", "left_semi")
    return nodes.join(ends.groupBy("id").agg(F.count("*").alias("degree")), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


def search_nodes(graph: Graph, query: str, top_k: int = 5) -> DataFrame:
    """Nodes whose name holds the text, case aside, most connected first; ties by id. A null name never matches."""
    hits = graph.nodes.where(F.contains(F.lower("name"), F.lit(query.lower()))).select("id", "name", "label")
    return with_degree(graph, hits).orderBy(F.desc("degree"), "id").limit(top_k)


def search_entities(graph: Graph, query: str, top_k: int = 10) -> DataFrame:
    """The same, without noise names; those are dropped after the limit."""
    return search_nodes(graph, query, top_k).where(~text.is_result_noise(F.col("name")))


def search_words(graph: Graph, query: str, top_k: int = 10) -> DataFrame:
    hits = graph.nodes.where(text.whole_word_match(F.col("name"), F.lit(query))).select("id", "name", "label")
    return with_degree(graph, hits).orderBy(F.desc("degree"), "id").limit(top_k).where(~text.is_result_noise(F.col("name")))


def search_case_sensitive(nodes: DataFrame, query: str, limit: int = 100) -> DataFrame:
    return nodes.where(F.contains(F.col("name"), F.lit(query))).orderBy("id").limit(limit)


def by_id(nodes: DataFrame, id: str) -> DataFrame:
    return nodes.where(F.col("id") == id)


def by_name(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(F.lower(F.trim("name")) == name.strip().lower())


def by_type(nodes: DataFrame, label: str) -> DataFrame:
    return nodes.where(F.col("label") == label)


def incident(edges: DataFrame, id: str, direction: str = "both") -> DataFrame:
    if direction == "out":
        return edges.where(F.col("src") == id)
    if direction == "in":
        return edges.where(F.col("dst") == id)
    return edges.where((F.col("src") == id) | (F.col("dst") == id))


def neighbours(graph: Graph, node_ids: Sequence[str], rel_types: Sequence[str] | None = None, direction: str = "both", after: str | None = None, before: str | None = None, limit: int | None = 30) -> DataFrame:
    """Direct neighbours of the nodes with the edges that lead there, in order of edge id.

    Filters on relation, direction and time reach the edge scan before the names are joined.
    """
    e = graph.edges.where(temporal_filter(after, before))
    if rel_types:
        e = e.where(F.upper("rel").isin(*[r.upper() for r in rel_types]))
    ids = [F.lit(i) for i in node_ids]
    out = e.where(F.col("src").isin(*ids)).select("eid", F.col("src").alias("from_id"), F.col("dst").alias("to_id"), "rel", F.lit("outgoing").alias("direction"), "t_announce", "t_effective", "source")
    back = e.where(F.col("dst").isin(*ids) & (F.col("src") != F.col("dst"))).select("eid", F.col("dst").alias("from_id"), F.col("src").alias("to_id"), "rel", F.lit("incoming").alias("direction"), "t_announce", "t_effective", "source")
    rows = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    rows = rows.orderBy("eid", "from_id").limit(limit) if limit else rows
    names = graph.nodes.select("id", "name", "label")
    rows = rows.join(names.select(F.col("id").alias("from_id"), F.col("name").alias("from_name")), "from_id", "left")
    return rows.join(names.select(F.col("id").alias("to_id"), F.col("name").alias("to_name"), F.col("label").alias("to_label")), "to_id", "left")


def looks_like_id(query: str) -> bool:
    return " " not in query and len(query) > 20


def neighbours_of(graph: Graph, query: str, rel_types: Sequence[str] | None = None, direction: str = "both", limit: int = 20) -> DataFrame:
    """Direct neighbours of a node given by its id, or by a name: then of the first entity that is found for it."""
    if looks_like_id(query):
        ids = [query]
    else:
        ids = [r["id"] for r in search_entities(graph, query, 1).collect()] or [r["id"] for r in by_id(graph.nodes, query).limit(1).collect()]
    return neighbours(graph, ids or [""], rel_types, direction, limit=limit)


CANDIDATE = "id string, name string, label string, score double, match_type string"


def resolve(graph: Graph, query: str, top_k: int = 5, use_aliases: bool = True) -> DataFrame:
    """Candidates of a mention: by exact substring, else by alias, else by likeness; the first stage with hits counts.

    (id, name, label, score, match_type), best first. A stage runs only if those before it found nothing, so its
    at most ``top_k`` rows come to the driver.
    """
    exact = lambda: search_entities(graph, query, top_k).select("id", "name", "label", F.lit(vocab.SCORE_EXACT).alias("score"), F.lit("exact").alias("match_type"), F.col("degree").cast("double").alias("order"))

    def alias() -> DataFrame | None:
        names = alias_names(query) if use_aliases else []
        if not names:
            return None
        hit = F.exists(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(F.lower(F.col("name")), n))
        found = with_degree(graph, graph.nodes.where(hit & ~text.is_result_noise(F.col("name"))).select("id", "name", "label"))
        return found.select("id", "name", "label", F.lit(vocab.SCORE_ALIAS).alias("score"), F.lit("alias").alias("match_type"), F.col("degree").cast("double").alias("order"))

    def alike() -> DataFrame | None:
        found = fuzzy_candidates(graph, query)
        return None if found is None else found.select("id", "name", "label", (F.lit(vocab.SCORE_FUZZY) * F.col("ratio")).alias("score"), F.lit("fuzzy").alias("match_type"), F.col("ratio").alias("order"))

    for stage in (exact, alias, alike):
        rows = stage()
        hits = rows.orderBy(F.desc("score"), F.desc("order"), "id").limit(top_k).drop("order").collect() if rows is not None else []
        if hits:
            break
    return graph.nodes.sparkSession.createDataFrame([tuple(r) for r in hits], CANDIDATE)


def linkable(graph: Graph, mentions: Sequence[str]) -> dict[str, list[int]]:
    """Places of the mentions that some name holds (``named``), by an alias (``alias``), or at the start of a word (``alike``): one scan for all."""
    name = F.lower("name")
    held = lambda texts: F.filter(F.transform(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("x")) for i, x in texts]), lambda s: F.when(F.contains(name, s["x"]), s["i"])), lambda i: i.isNotNull())
    words = lambda m: [w[:4] for w in m.split() if len(w) >= 3 and w not in vocab.STOPWORDS]
    kinds = {
        "named": list(enumerate(mentions)), "alias": [(i, n) for i, m in enumerate(mentions) for n in alias_names(m)], "alike": [(i, w) for i, m in enumerate(mentions) for w in words(m)],
    }
    quiet = graph.nodes.where(~text.is_result_noise(F.col("name")))
    out = {}
    shown = quiet.select(*[(F.array_distinct(held(t)) if t else F.array().cast("array<int>")).alias(k) for k, t in kinds.items()])
    row = shown.agg(*[F.array_distinct(F.flatten(F.collect_set(k))).alias(k) for k in kinds]).first()  # sets of at most as many places as there are mentions
    for k in kinds:
        out[k] = sorted(row[k] or [])
    return out


def alias_names(query: str) -> list[str]:
    """The alias table for one query, on the driver; ``text.aliases`` is the same for a column."""
    q = query.lower().strip()
    for key, names in vocab.ALIASES.items():
        if f" {key} " in f" {q} ":
            return names
    return list(dict.fromkeys(n for w in q.split() for n in vocab.ALIASES.get(w, [])))


def likeness(a: str, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of a fixed text to a column."""
    @F.pandas_udf("double")
    def ratio(names: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return names.map(lambda n: SequenceMatcher(None, a, n or "").ratio())

    return ratio(b)


def fuzzy_candidates(graph: Graph, query: str, per_word: int = 10) -> DataFrame | None:
    """Nodes that share the first letters of a word of the query and are alike enough; None without such words."""
    words = [w for w in query.lower().split() if len(w) >= 3 and w not in vocab.STOPWORDS]
    if not words:
        return None
    hits = search_nodes(graph, words[0][:4], per_word)
    for w in words[1:]:
        hits = hits.unionByName(search_nodes(graph, w[:4], per_word))
    hits = hits.dropDuplicates(["id"]).where(~text.is_result_noise(F.col("name")))
    return hits.withColumn("ratio", likeness(query.lower(), F.lower("name"))).where(F.col("ratio") >= vocab.FUZZY_CUTOFF)


def close_names(nodes: DataFrame, query: str, top_k: int = 5, cutoff: float = 0.6) -> DataFrame:
    """The most alike names, case counted, noise excluded, one node per name."""
    names = nodes.where(~text.is_result_noise(F.col("name")) & F.col("name").isNotNull()).groupBy("name").agg(F.min_by(F.struct("id", "label"), F.col("id")).alias("n"))
    rows = names.withColumn("ratio", likeness(query, F.col("name"))).where(F.col("ratio") >= cutoff)
    return rows.select("n.id", "name", "n.label", "ratio").orderBy(F.desc("ratio"), "name").limit(top_k)
