"""Cleaning of a graph, and the audit of what was removed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import vocab
from graphloom.functions.text import upper_snake
from graphloom.operators.graph import Graph
from graphloom.session import Cuts


def normalise_relations(edges: DataFrame) -> DataFrame:
    return edges.withColumn("rel", upper_snake(F.col("rel")))


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key. The least order per key is found with partial aggregation, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r"))
    return best.select(*keys, "r.*").select(*df.columns)


def is_noise_node() -> Column:
    name = F.lower(F.trim(F.coalesce("name", F.lit(""))))
    return reduce(lambda a, b: a | b, [(F.col("label") == label) & name.isin(*names) for label, names in vocab.LABEL_NOISE.items()])


def without_noise(graph: Graph) -> Graph:
    """Without noise nodes and the edges at them."""
    noise = graph.nodes.where(is_noise_node()).select("id")
    return Graph(graph.nodes.where(~F.coalesce(is_noise_node(), F.lit(False))), without_ends(graph.edges, noise))


def without_ends(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that touch none of the ids."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti").select(*edges.columns)


def without_orphans(graph: Graph) -> Graph:
    """Only nodes with an edge."""
    ends = graph.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return Graph(graph.nodes.join(ends, "id", "left_semi").select(*graph.nodes.columns), graph.edges)


def without_broken(graph: Graph) -> Graph:
    """Only edges both of whose ends are nodes."""
    ids = graph.nodes.select("id").distinct()
    e = graph.edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return Graph(graph.nodes, e.select(*graph.edges.columns))


def clean(graph: Graph, order: str = "eid") -> Graph:
    """Relation names, loops, repeated edges (the first stays), noise, orphans, broken ends: in this order.

    Cleaning a clean graph changes nothing. Null names are no noise; an empty graph stays empty.
    """
    e = keep_first(without_loops(normalise_relations(graph.edges)), ["src", "rel", "dst"], order)
    return without_broken(without_orphans(without_noise(Graph(graph.nodes, e))))


def audit(graph: Graph, order: str = "eid") -> DataFrame:
    """One row of counts: what each step of ``clean`` changes or removes.

    Edges are read once for their own counts and once, kept-first, with a flag per end; that short table is written and
    all else is counted from it.
    """
    cuts = Cuts(graph.nodes.sparkSession, "audit")
    own = graph.edges.agg(F.count("*").alias("edges"), F.sum((F.col("rel") != upper_snake(F.col("rel"))).cast("long")).alias("renamed"), F.sum((F.col("src") == F.col("dst")).cast("long")).alias("loops"))
    flags = graph.nodes.select("id", F.coalesce(is_noise_node(), F.lit(False)).alias("noise")).groupBy("id").agg(F.max("noise").alias("noise"), F.sum((~F.col("noise")).cast("long")).alias("quiet"), F.count("*").alias("rows"))
    flags = cuts.cut(flags)
    once = keep_first(without_loops(normalise_relations(graph.edges.select("src", "rel", "dst", order))), ["src", "rel", "dst"], order).select("src", "dst")
    for c in ("src", "dst"):
        once = once.join(flags.select(F.col("id").alias(c), F.col("noise").alias(f"{c}_noise"), (F.col("quiet") > 0).alias(f"{c}_known")), c, "left")
    quiet = ~F.coalesce("src_noise", F.lit(False)) & ~F.coalesce("dst_noise", F.lit(False))
    once = cuts.cut(once.select("src", "dst", quiet.alias("quiet"), F.coalesce(F.col("src_known") & F.col("dst_known"), F.lit(False)).alias("known")))
    ends = once.where("quiet").select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    parts = [
        own, once.agg(F.count("*").alias("once"), F.sum(F.col("quiet").cast("long")).alias("quiet_edges"), F.sum((F.col("quiet") & F.col("known")).cast("long")).alias("edges_left")),
        flags.agg(F.sum("rows").alias("nodes"), F.sum("quiet").alias("quiet_nodes")), flags.join(ends, "id", "left_semi").agg(F.sum("quiet").alias("nodes_left")),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, True), parts)  # a row each, summed to one
    row = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in rows.columns])
    return row.select(
        "renamed", "loops", (F.col("edges") - F.col("loops") - F.col("once")).alias("repeated"), (F.col("nodes") - F.col("quiet_nodes")).alias("noise_nodes"), (F.col("once") - F.col("quiet_edges")).alias("noise_edges"),
        (F.col("quiet_nodes") - F.col("nodes_left")).alias("orphans"), (F.col("quiet_edges") - F.col("edges_left")).alias("broken"), "nodes_left", "edges_left",
    )
