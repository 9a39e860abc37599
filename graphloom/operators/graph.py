"""The property graph as two DataFrames, and its builders."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import vocab
from graphloom.functions import text
from graphloom.session import Cuts, table


@dataclass
class Graph:
    """``nodes(id, name, label)`` and ``edges(eid, src, dst, rel, t_announce, t_effective, source)``, further columns allowed.

    Several edges may join the same two nodes; ``simple`` keeps the last of each ordered pair.
    """

    nodes: DataFrame
    edges: DataFrame
    #: whether the edges are a table to read and not a plan to run at every hop
    stored: bool = False

    def store(self, cuts: Cuts) -> Graph:
        """The graph with its edges written once, for searches that read them hop by hop."""
        return self if self.stored else Graph(self.nodes, cuts.cut(self.edges), True)

    def adjacency(self, rel_types: Sequence[str] | None = None) -> DataFrame:
        """Each edge from both its ends: (eid, a, b, rel, direction, t_announce, t_effective, source)."""
        e = self.edges
        if rel_types:
            e = e.where(F.upper("rel").isin(*[r.upper() for r in rel_types]))
        ends = F.explode(
            F.when(F.col("src") == F.col("dst"), F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit("outgoing").alias("direction")))).otherwise(
                F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit("outgoing").alias("direction")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit("incoming").alias("direction")))
            )
        ).alias("x")
        return e.select("eid", "rel", "t_announce", "t_effective", "source", ends).select("eid", "x.a", "x.b", "rel", "x.direction", "t_announce", "t_effective", "source")

    def simple(self, order: str = "eid") -> Graph:
        """One edge per ordered pair of nodes: the last in ``order``."""
        last = self.edges.groupBy("src", "dst").agg(F.max_by(F.struct(*[c for c in self.edges.columns if c not in ("src", "dst")]), F.col(order)).alias("e"))
        return Graph(self.nodes, last.select("src", "dst", "e.*").select(*self.edges.columns))


def edge_id(src: Column, rel: Column, dst: Column) -> Column:
    return F.concat_ws("|", src, rel, dst)


def trade_graph(spark: SparkSession, d: str) -> Graph:
    """The graph of the star schema: places, customers, suppliers and parts, with what they order and supply."""
    region, nation, customer, supplier, part = (table(spark, d, t) for t in ("region", "nation", "customer", "supplier", "part"))
    orders, items = table(spark, d, "orders"), table(spark, d, "lineitem")
    node = lambda df, p, k, n, label: df.select(F.concat(F.lit(p), F.col(k)).alias("id"), F.col(n).alias("name"), F.lit(label).alias("label"))
    nodes = node(region, "R", "r_regionkey", "r_name", "Region").unionByName(node(nation, "N", "n_nationkey", "n_name", "Nation")).unionByName(node(customer, "C", "c_custkey", "c_name", "Customer"))
    nodes = nodes.unionByName(node(supplier, "S", "s_suppkey", "s_name", "Supplier")).unionByName(node(part, "P", "p_partkey", "p_name", "Part"))

    def edges(df: DataFrame, p: str, a: str, q: str, b: str, rel: str, time: Column | None = None) -> DataFrame:
        src, dst = F.concat(F.lit(p), F.col(a)), F.concat(F.lit(q), F.col(b))
        when = F.date_format(time, "yyyy-MM-dd") if time is not None else F.lit(None).cast("string")
        return df.select(edge_id(src, F.lit(rel), dst).alias("eid"), src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel"), when.alias("t_announce"), F.lit(None).cast("string").alias("t_effective"), F.lit("trade").alias("source"))

    supplied = items.groupBy("l_suppkey", "l_partkey").agg(F.min("l_shipdate").alias("t"))
    ordered = orders.join(items, orders.o_orderkey == items.l_orderkey).groupBy("o_custkey", "l_partkey").agg(F.min("o_orderdate").alias("t"))
    out = edges(nation, "N", "n_nationkey", "R", "n_regionkey", "PART_OF").unionByName(edges(customer, "C", "c_custkey", "N", "c_nationkey", "LOCATED_IN"))
    out = out.unionByName(edges(supplier, "S", "s_suppkey", "N", "s_nationkey", "LOCATED_IN"))
    return Graph(nodes, out.unionByName(edges(supplied, "S", "l_suppkey", "P", "l_partkey", "SUPPLIES", F.col("t"))).unionByName(edges(ordered, "C", "o_custkey", "P", "l_partkey", "ORDERED", F.col("t"))))


def knowledge_graph(entities: DataFrame, relationships: DataFrame) -> Graph:
    """The graph of the stored tables: the latest version of each node, and edges between trimmed upper-case ids."""
    latest = entities.where(F.col("id").isNotNull()).groupBy("id").agg(F.max_by(F.struct("name", F.col("entity_type").alias("label"), "confidence", "updated_at"), F.col("updated_at")).alias("n"))
    nodes = latest.select("id", F.coalesce("n.name", F.lit("")).alias("name"), "n.label", "n.confidence", "n.updated_at")
    key = lambda c: F.upper(F.regexp_replace(F.col(c), r"^[\s\u00A0]+|[\s\u00A0]+$", ""))
    stamp = lambda c: F.date_format(F.col(c), "yyyy-MM-dd")
    edges = relationships.select(
        F.col("edge_no").cast("string").alias("eid"), key("source").alias("src"), key("target").alias("dst"), text.upper_snake(F.col("predicate")).alias("rel"),
        stamp("temporal.t_announce").alias("t_announce"), stamp("temporal.t_effective").alias("t_effective"), F.lit("news").alias("source"),
        "edge_no", F.col("props.sentiment").alias("sentiment"), F.col("props.sentiment_label").alias("sentiment_label"), F.col("props.confidence").alias("confidence"),
    )
    return Graph(nodes, edges)


def facts_to_graph(facts: DataFrame) -> Graph:
    """Entities and edges of extracted facts.

    Names that are null, blank or a word for nothing are dropped with their facts; unknown types become Indicator;
    ids carry the label, so names of different types don't collide; temporal data, sentiment and text are carried.
    """
    named = lambda c: F.col(c).isNotNull() & ~F.lower(F.trim(c)).isin("", "none", "null", "n/a", "unknown")
    kind = lambda c: F.when(F.col(c).isin(*vocab.NODE_LABELS), F.col(c)).otherwise("Indicator")
    f = facts.where(named("subject") & named("object")).select(
        F.trim("subject").alias("s"), kind("subject_type").alias("s_type"), F.trim("object").alias("o"), kind("object_type").alias("o_type"), text.upper_snake(F.col("predicate")).alias("rel"),
        F.coalesce("confidence", F.lit(0.8)).alias("confidence"), F.coalesce("sentiment", F.lit(0.0)).alias("sentiment"), "temporal", "source_text",
    )
    f = f.withColumns({"src": text.stable_id(F.col("s"), F.col("s_type")), "dst": text.stable_id(F.col("o"), F.col("o_type"))})
    ends = f.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("s").alias("name"), F.col("s_type").alias("label"), "confidence"), F.struct(F.col("dst").alias("id"), F.col("o").alias("name"), F.col("o_type").alias("label"), "confidence"))).alias("n")).select("n.*")
    nodes = ends.groupBy("id", "label").agg(F.min("name").alias("name"), F.max("confidence").alias("confidence")).select("id", "name", "label", "confidence")
    edge = F.concat_ws("_", text.upper_id(F.col("s")), F.col("rel"), text.upper_id(F.col("o")))
    edges = f.select(edge.alias("eid"), "src", "dst", "rel", F.col("temporal.t_announce").alias("t_announce"), F.col("temporal.t_effective").alias("t_effective"), F.col("source_text").alias("source"), "confidence", "sentiment")
    return Graph(nodes, edges)


def with_default_properties(nodes: DataFrame) -> DataFrame:
    """Each type's property keys, empty where not given; given values win."""
    defaults = F.create_map().cast("map<string,string>")
    for kind, keys in vocab.DEFAULT_PROPERTIES.items():
        own = F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array_repeat(F.lit(None).cast("string"), len(keys)))
        defaults = F.when(F.col("type") == kind, own).otherwise(defaults)
    given = F.coalesce("properties", F.create_map().cast("map<string,string>"))
    return nodes.withColumn("properties", F.map_zip_with(defaults, given, lambda _, a, b: F.coalesce(b, a)))


def edge_property_errors(edges: DataFrame) -> DataFrame:
    """Rows whose measures lie outside their range, with the name of the first such measure."""
    bad = F.lit(None).cast("string")
    for c, lo in (("prominence", 0), ("confidence", 0), ("impact_magnitude", 0), ("sentiment", -1)):
        bad = F.when((F.col(f"props.{c}") < lo) | (F.col(f"props.{c}") > 1), F.lit(c)).otherwise(bad)
    return edges.withColumn("out_of_range", bad).where("out_of_range is not null")


def quintuples(edges: DataFrame) -> DataFrame:
    """(s, p, o, t_start, t_end) with a dot for a missing time."""
    dot = lambda c: F.coalesce(F.col(c), F.lit("."))
    return edges.select(F.col("src").alias("s"), F.col("rel").alias("p"), F.col("dst").alias("o"), dot("t_announce").alias("t_start"), dot("t_effective").alias("t_end"))


def mapping_edges(mapping: DataFrame, nodes: DataFrame, rel: str = "OPERATES_IN", source: str = "mapping") -> DataFrame:
    """Edges from each ``mapping(name, group)`` whose name and group are both nodes' names, case and outer spaces aside;
    of several nodes of a name the least id; a repeated mapping gives one edge."""
    ids = nodes.groupBy(F.lower(F.trim("name")).alias("k")).agg(F.min("id").alias("i"))
    m = mapping.select(F.lower(F.trim("name")).alias("a"), F.lower(F.trim("group")).alias("b")).distinct()
    both = m.join(ids.select(F.col("k").alias("a"), F.col("i").alias("src")), "a").join(ids.select(F.col("k").alias("b"), F.col("i").alias("dst")), "b")
    none = F.lit(None).cast("string")
    return both.select(edge_id(F.col("src"), F.lit(rel), F.col("dst")).alias("eid"), "src", "dst", F.lit(rel).alias("rel"), none.alias("t_announce"), none.alias("t_effective"), F.lit(source).alias("source"))
