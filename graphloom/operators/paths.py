"""Bounded path search by joins, and the scores of paths.

A hop joins the frontier, which is bound to the start nodes and small, with the edges at its ends. Relation filters
apply before every hop; the frontier carries ids only, and names join the few paths that are kept. A search for the first
``top_k`` paths never builds a hub's whole fan-out: the order of paths is that of their edge ids, so prefixes are taken in
that order, a page at a time, and extended until there are enough paths. With ends given, edges at the starts and at
the ends are joined in the middle. The edges are written once where the graph is not a stored one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from graphloom import vocab
from graphloom.functions.numeric import clamp
from graphloom.operators.graph import Graph
from graphloom.session import Cuts

_STEP = "struct<rel:string,t_announce:string,t_effective:string,source:string>"


def _frontier(graph: Graph, starts: Sequence[str]) -> DataFrame:
    """One empty path per start that is a node."""
    return graph.nodes.where(F.col("id").isin(*starts)).select(
        F.array("id").alias("node_ids"), F.array().cast("array<string>").alias("eids"), F.array().cast(f"array<{_STEP}>").alias("steps"), F.col("id").alias("last"), F.lit(0).alias("hops")
    )


def _hop(frontier: DataFrame, adjacency: DataFrame, keep: Column) -> DataFrame:
    step = F.struct("rel", "t_announce", "t_effective", "source")
    rows = frontier.join(adjacency, frontier["last"] == adjacency["a"]).where(~F.array_contains("eids", F.col("eid")) & keep)
    return rows.select(F.array_append("node_ids", F.col("b")).alias("node_ids"), F.array_append("eids", F.col("eid")).alias("eids"), F.array_append("steps", step).alias("steps"), F.col("b").alias("last"), (F.col("hops") + 1).alias("hops"))


def _kept(hop: int) -> Column:
    """Whether a walk may go on from this hop: the second node isn't the start."""
    return (F.col("b") != F.element_at("node_ids", 1)) if hop == 1 else F.lit(True)


def _done(hop: int) -> Column:
    """Whether a trail may end here: not at the start, and a third hop's end isn't the second node."""
    return (F.col("b") != F.element_at("node_ids", 1)) & ((F.col("b") != F.element_at("node_ids", 2)) if hop == 3 else F.lit(True))


def trails(graph: Graph, starts: Sequence[str], ends: Sequence[str] | None = None, rel_types: Sequence[str] | None = None, max_hops: int = 3) -> list[DataFrame]:
    """All undirected trails of 1..``max_hops`` edges, one DataFrame a hop: no edge twice, the end is not the start,
    and no inner node but the last may be the start, nor the end the second node."""
    adjacency = graph.adjacency(rel_types)
    out, walk = [], _frontier(graph, starts)
    for hop in range(1, max_hops + 1):
        done = _hop(walk, adjacency, _done(hop))
        out.append(done.where(F.col("last").isin(*ends)) if ends else done)
        if hop < max_hops:
            walk = _hop(walk, adjacency, _kept(hop))
    return out


def _keyed(paths: DataFrame) -> DataFrame:
    return paths.withColumns({"key": F.array_join("eids", "\x01"), "places": F.array_join("node_ids", "\x01")})


def _ordered(paths: DataFrame, top_k: int) -> DataFrame:
    return _keyed(paths).orderBy("hops", "key", "places").limit(top_k).drop("key", "places")


_TRAIL = f"node_ids array<string>, eids array<string>, steps array<{_STEP}>, last string, hops int"


def _pages(step: DataFrame, size: int) -> Iterator[list[Row]]:
    """Rows of one hop in order of their edges, in pages of about ``size``, each twice the one before: what is
    collected is a page. Trails of the same edges are never in two pages."""
    after, rows = None, _keyed(step)
    while True:
        more = rows if after is None else rows.where(F.col("key") > after)
        page = more.orderBy("key", "places").limit(size + 1).collect()
        if len(page) <= size:
            if page:
                yield page
            return
        last = page[-1]["key"]
        kept = [r for r in page if r["key"] != last]
        if not kept:  # one page of trails of the same edges: take them all
            kept = rows.where(F.col("key") == last).collect()
        yield kept
        after, size = kept[-1]["key"], 2 * size


def _from(prefixes: list[Row], adjacency: DataFrame, keep: Column) -> DataFrame:
    """One more hop from a page of prefixes; their ends reach the scan as literals."""
    local = adjacency.sparkSession.createDataFrame([(r["node_ids"], r["eids"], r["steps"], r["last"], r["hops"]) for r in prefixes], _TRAIL)
    return _hop(local, adjacency.where(F.col("a").isin(*sorted({r["last"] for r in prefixes}))), keep)


class _Walks:
    """Pages of the walks of 0, 1, .. edges from the starts, in order of their edges, each fetched when first asked for."""

    def __init__(self, begin: list[Row], adjacency: DataFrame, size: int):
        self.adjacency, self.size = adjacency, size
        self.known: list[list[list[Row]]] = [[begin]]
        self.more: list[Iterator[list[Row]]] = [iter(())]

    def _next(self, hop: int) -> Iterator[list[Row]]:
        for prefixes in self.pages(hop - 1):
            yield from _pages(_from(prefixes, self.adjacency, _kept(hop)), self.size)

    def pages(self, hop: int) -> Iterator[list[Row]]:
        while len(self.known) <= hop:
            self.more.append(self._next(len(self.known)))
            self.known.append([])
        at = 0
        while True:
            if at == len(self.known[hop]):
                page = next(self.more[hop], None)
                if page is None:
                    return
                self.known[hop].append(page)
            yield self.known[hop][at]
            at += 1

    def first(self, hop: int, need: int) -> list[Row]:
        """The first ``need`` trails of ``hop`` edges: later prefixes are only looked at while there are too few."""
        out: list[Row] = []
        for prefixes in self.pages(hop - 1):
            out += _ordered(_from(prefixes, self.adjacency, _done(hop)), need - len(out)).collect()
            if len(out) >= need:
                break
        return out


def _between(begin: list[Row], adjacency: DataFrame, ends: Sequence[str], hop: int) -> DataFrame:
    """Trails of ``hop`` edges to the ends: one or two edges from the starts, the last backwards from the ends."""
    if hop == 1:
        return _from(begin, adjacency, _done(1)).where(F.col("last").isin(*ends))
    last = adjacency.where(F.col("a").isin(*ends)).select(F.col("b").alias("a"), F.col("a").alias("b"), "eid", "rel", "t_announce", "t_effective", "source")
    walk = _from(begin, adjacency, _kept(1))
    if hop == 3:
        near = adjacency.join(last.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        walk = _hop(walk, near, _kept(2))
    return _hop(walk, last, _done(hop))


def find_paths(graph: Graph, starts: Sequence[str], ends: Sequence[str] | None = None, rel_types: Sequence[str] | None = None, max_hops: int = 3, top_k: int = 3, progressive: bool = True) -> DataFrame:
    """The first ``top_k`` trails, shorter ones first, then by edge ids.

    ``progressive`` takes them page by page, at most ``top_k`` rows on the driver, and a hop only while there are too few;
    without it the same rows come from one plan. Starts that are no nodes have no paths; no starts give an empty result.
    """
    max_hops = min(max_hops, 3)
    if not progressive:
        out = trails(graph, starts or [""], ends, rel_types, max_hops)
        return describe(graph, _ordered(reduce(DataFrame.unionByName, out), top_k))
    cuts = Cuts(graph.nodes.sparkSession, "paths")
    adjacency = graph.store(cuts).adjacency(rel_types)
    begin, rows = _frontier(graph, starts or [""]).collect(), []
    walks = _Walks(begin, adjacency, max(64, top_k))
    for hop in range(1, max_hops + 1):
        if len(rows) >= top_k or not begin:
            break
        need = top_k - len(rows)
        rows += _ordered(_between(begin, adjacency, ends, hop), need).collect() if ends else walks.first(hop, need)
    cuts.clear()
    return describe(graph, graph.nodes.sparkSession.createDataFrame([(r["node_ids"], r["eids"], r["steps"], r["last"], r["hops"]) for r in rows], _TRAIL))


def simple_paths(graph: Graph, starts: Sequence[str], ends: Sequence[str] | None = None, max_hops: int = 3, top_k: int | None = None) -> DataFrame:
    """Directed paths that visit no node twice, 1..``max_hops`` edges, one per sequence of nodes, in breadth-first order."""
    cuts = Cuts(graph.nodes.sparkSession, "simple")
    e = graph.store(cuts).edges.select("eid", F.col("src").alias("a"), F.col("dst").alias("b"), "rel", "t_announce", "t_effective", "source")
    walk, out = _frontier(graph, starts or [""]), None
    for _ in range(max_hops):
        walk = _hop(walk, e, ~F.array_contains("node_ids", F.col("b")))
        out = walk if out is None else out.unionByName(walk)
    if ends:
        out = out.where(F.col("last").isin(*ends))
    one = out.groupBy("node_ids").agg(F.min_by(F.struct("eids", "steps", "last", "hops"), F.array_join("eids", "\x01")).alias("p")).select("node_ids", "p.*")
    return describe(graph, _ordered(one, top_k) if top_k else one)


def describe(graph: Graph, paths: DataFrame) -> DataFrame:
    """Paths with a stable id, and names, labels and triples in the order of the walk: one join with the nodes for all places."""
    rows = paths.withColumn("path_id", F.substring(F.sha2(F.concat_ws("\x01", "eids", "node_ids"), 256), 1, 12))
    wanted = rows.select("path_id", F.posexplode("node_ids").alias("at", "id"))
    named = wanted.join(graph.nodes.select("id", "name", "label"), "id", "left")
    names = named.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("at", "name", "label"))).alias("n"))
    rows = rows.join(names, "path_id")
    name_at = lambda i: F.element_at(F.col("n"), i.cast("int"))["name"]
    triple = F.transform(
        F.col("steps"),
        lambda s, i: F.struct(name_at(i + 1).alias("subj"), s["rel"].alias("rel"), name_at(i + 2).alias("obj"), F.coalesce(s["t_announce"], s["t_effective"]).alias("time"), s["source"].alias("source")),
    )
    return rows.select(
        "path_id", "hops", "node_ids", F.transform("n", lambda x: x["name"]).alias("node_names"), F.transform("n", lambda x: x["label"]).alias("node_labels"), "eids", triple.alias("triples")
    )


def temporal_score(triples: Column, after: str | None = None, before: str | None = None) -> Column:
    """1 without a constraint or with a triple that meets either bound, else 0.2; times compare as strings."""
    if not after and not before:
        return F.lit(1.0)
    meets = lambda t: F.coalesce(((t["time"] >= after) if after else F.lit(False)) | ((t["time"] <= before) if before else F.lit(False)), F.lit(False))
    return F.when(F.exists(triples, meets), 1.0).otherwise(0.2)


def relevance(node_names: Column, triples: Column, words: Sequence[str]) -> Column:
    """Share of the keywords that a word of the path holds or is held by."""
    if not words:
        return F.lit(0.0)
    parts = F.concat(node_names, F.flatten(F.transform(triples, lambda t: F.array(t["subj"], t["obj"], F.replace(t["rel"], F.lit("_"), F.lit(" "))))))
    tokens = F.array_distinct(F.flatten(F.transform(parts, lambda p: F.split(F.lower(F.coalesce(p, F.lit(""))), r"\s+"))))
    tokens = F.filter(tokens, lambda t: t != "")
    hits = F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.exists(tokens, lambda t: F.contains(t, w) | F.contains(w, t))))
    return F.least(F.lit(1.0), hits / len(words))


def path_score(entity: Column, relation: Column, temporal: Column, hops: Column, bonus: Column) -> Column:
    w = vocab.WEIGHTS
    penalty = w["penalty"] * (w["hop_penalty"] * F.greatest(F.lit(0), hops - 1))
    return F.round(clamp(w["entity"] * entity + w["relation"] * relation + w["temporal"] * temporal - penalty + w["relevance"] * bonus), 4)


def score_paths(paths: DataFrame, relation_confidence: float, after: str | None = None, before: str | None = None, words: Sequence[str] = (), entity: float = vocab.ANCHOR_SCORE, top_k: int | None = 3) -> DataFrame:
    """Paths with their score, best first, ties to shorter ones and then by id."""
    t, b = temporal_score(F.col("triples"), after, before), relevance(F.col("node_names"), F.col("triples"), words)
    rows = paths.withColumn("score", path_score(F.lit(entity), F.lit(relation_confidence), t, F.col("hops"), b)).orderBy(F.desc("score"), "hops", "path_id")
    return rows.limit(top_k) if top_k else rows


def neighbour_paths(neighbours: DataFrame) -> DataFrame:
    """Neighbours as paths of one edge: the fallback where a search finds none."""
    time = F.coalesce("t_announce", "t_effective")
    triple = F.struct(F.col("from_name").alias("subj"), "rel", F.col("to_name").alias("obj"), time.alias("time"), "source")
    return neighbours.select(
        F.concat_ws("_", F.lit("nb"), "from_id", "eid").alias("path_id"), F.lit(1).alias("hops"), F.array("from_id", "to_id").alias("node_ids"), F.array("from_name", "to_name").alias("node_names"),
        F.array(F.lit(None).cast("string"), F.col("to_label")).alias("node_labels"), F.array("eid").alias("eids"), F.array(triple).alias("triples"),
    )


def first_seen(paths: DataFrame, order: str) -> DataFrame:
    """Each path once, by its id: the first in ``order``."""
    rest = [c for c in paths.columns if c not in ("path_id", order)]
    return paths.groupBy("path_id").agg(F.min_by(F.struct(*rest), F.col(order)).alias("p")).select("path_id", "p.*")


def distinct_triples(paths: DataFrame, order: str = "rank") -> DataFrame:
    """Triples of ranked paths, each once, in the order they first come."""
    rows = paths.select(F.col(order).alias("rank"), F.posexplode("triples").alias("at", "t"))
    first = rows.groupBy("t.subj", "t.rel", "t.obj").agg(F.min(F.struct("rank", "at")).alias("first"), F.min_by("t.time", F.struct("rank", "at")).alias("time"))
    return first.select("first.rank", "first.at", "subj", "rel", "obj", "time")


def shared_ends(*branches: DataFrame) -> DataFrame:
    """End nodes (id, name) that every branch's paths reach: a true intersection."""
    ends = [b.select(F.element_at("node_ids", -1).alias("id"), F.element_at("node_names", -1).alias("name")) for b in branches]
    out = ends[0]
    for e in ends[1:]:
        out = out.intersect(e)
    return out.distinct()
