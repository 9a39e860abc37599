"""Counts over the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import Graph
from graphloom.operators.search import degrees


def label_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(F.coalesce("label", F.lit("?")).alias("label")).agg(F.count("*").alias("n"))


def relation_histogram(edges: DataFrame, top: int | None = 15) -> DataFrame:
    rows = edges.groupBy("rel").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rel")
    return rows.limit(top) if top else rows


def sentiment_distribution(edges: DataFrame) -> DataFrame:
    return edges.where("sentiment_label is not null").groupBy("sentiment_label").agg(F.count("*").alias("n"))


def graph_stats(graph: Graph) -> DataFrame:
    """One row: nodes, labels, edges, relation types, distinct sources, mean of the known sentiments."""
    n = graph.nodes.agg(F.count("*").alias("n_nodes"), F.countDistinct("label").alias("n_labels"))
    mood = F.avg("sentiment") if "sentiment" in graph.edges.columns else F.lit(None).cast("double")
    e = graph.edges.agg(F.count("*").alias("n_edges"), F.countDistinct("rel").alias("n_rels"), F.countDistinct("source").alias("n_sources"), mood.alias("avg_sentiment"))
    return n.join(F.broadcast(e))  # one row each


def top_by_degree(graph: Graph, n: int = 10) -> DataFrame:
    top = degrees(graph.edges).orderBy(F.desc("degree"), "id").limit(n)
    return top.join(graph.nodes.select("id", "name", "label"), "id", "left")


def schema_overview(graph: Graph) -> DataFrame:
    """(kind, value): labels and relation types in use."""
    labels = graph.nodes.select(F.lit("label").alias("kind"), F.col("label").alias("value")).distinct()
    return labels.unionByName(graph.edges.select(F.lit("rel").alias("kind"), F.col("rel").alias("value")).distinct())


def property_keys(nodes: DataFrame, label: str = "label", properties: str = "properties") -> DataFrame:
    """(label, key): the property keys in use per label."""
    return nodes.select(label, F.explode(F.map_keys(properties)).alias("key")).distinct()
