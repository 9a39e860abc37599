"""Writers. A graph's version is a directory of its own, so a reader never sees half of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import stats
from graphloom.operators.graph import Graph
from graphloom.operators.merge import upsert


def write_graph(graph: Graph, path: str, version: str, mode: str = "errorifexists") -> str:
    """Nodes and edges as Parquet under path/version; ``overwrite`` is the truncating load."""
    target = f"{path}/{version}"
    graph.nodes.write.mode(mode).parquet(f"{target}/nodes")
    graph.edges.write.mode(mode).partitionBy("rel").parquet(f"{target}/edges")
    return target


def read_graph(spark: SparkSession, target: str) -> Graph:
    return Graph(spark.read.parquet(f"{target}/nodes"), spark.read.parquet(f"{target}/edges"))


def write_graph_json(graph: Graph, path: str) -> None:
    """Nodes, edges and a row of counts as JSON lines."""
    graph.nodes.write.mode("overwrite").json(f"{path}/nodes")
    graph.edges.write.mode("overwrite").json(f"{path}/edges")
    stats.graph_stats(graph).write.mode("overwrite").json(f"{path}/stats")


def upsert_nodes(stored: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """By (label, id); null values of new rows leave the stored ones."""
    return upsert(stored, new, ["label", "id"], order)


def upsert_edges(stored: DataFrame, new: DataFrame, by_relation_id: bool = False, order: str | None = None) -> DataFrame:
    return upsert(stored, new, ["src", "rel", "eid", "dst"] if by_relation_id else ["src", "rel", "dst"], order)


def loadable_edges(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """Edges both of whose ends are nodes, and one row with the count of those skipped."""
    ids = graph.nodes.select("id").distinct()
    a, b = ids.select(F.col("id").alias("src")), ids.select(F.col("id").alias("dst"))
    good = graph.edges.join(a, "src", "left_semi").join(b, "dst", "left_semi").select(*graph.edges.columns)
    no_src = graph.edges.join(a, "src", "left_anti").select("eid")
    no_dst = graph.edges.join(a, "src", "left_semi").join(b, "dst", "left_anti").select("eid")
    return good, no_src.unionByName(no_dst).agg(F.count("*").alias("skipped"))


def storable(nodes: DataFrame) -> DataFrame:
    """Flat rows for a property store: nested values as text, lists joined, times in ISO form, null properties dropped."""
    cols = []
    for f in nodes.schema:
        kind = f.dataType.simpleString()
        c = F.col(f.name)
        if kind.startswith("array<string"):
            c = F.array_join(c, ", ")
        elif kind.startswith("map"):
            c = F.to_json(F.map_filter(c, lambda _, v: v.isNotNull()))
        elif kind.startswith(("array", "struct")):
            c = F.to_json(c)
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        cols.append(c.alias(f.name))
    return nodes.select(*cols)


def write_batches(nodes: DataFrame, path: str, batch: int = 500) -> None:
    """Storable nodes in files of at most ``batch`` rows, a folder per label: what a store loads at once."""
    storable(nodes).write.mode("overwrite").partitionBy("label").option("maxRecordsPerFile", batch).parquet(path)


def write_by_id(graph: Graph, target: str) -> None:
    """Nodes in order of their id, and edges from both their ends in order of the end's: a lookup by id, and a hop, reads few row groups."""
    graph.nodes.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{target}/nodes")
    graph.adjacency().repartitionByRange("a", "eid").sortWithinPartitions("a", "eid").write.mode("overwrite").parquet(f"{target}/adjacency")


def write_checkpoint(df: DataFrame, path: str, label: str) -> None:
    df.write.mode("overwrite").parquet(f"{path}/checkpoint={label}")


def resume(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among those already written."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def write_split(pairs: DataFrame, path: str) -> None:
    """Training and validation rows as partitions of one dataset."""
    pairs.write.mode("overwrite").partitionBy("split").parquet(path)


def to_store_model(graph: Graph) -> Graph:
    """Edges with the id src__REL__dst and a confidence of 0.8 where none is known."""
    e = graph.edges
    confidence = F.coalesce("confidence", F.lit(0.8)) if "confidence" in e.columns else F.lit(0.8)
    return Graph(graph.nodes, e.withColumns({"eid": F.concat_ws("__", "src", "rel", "dst"), "confidence": confidence}))
