"""Graphs built batch by batch: each batch reads the last version and writes the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.components import components
from graphloom.operators.graph import Graph, facts_to_graph
from graphloom.operators.merge import incremental_matches, pick_incremental, rewire
from graphloom.operators.orphans import OrphanTracker, deletions, parents, references
from graphloom.session import Cuts
from graphloom.state import Versions

TABLES = {
    "nodes": "id string, name string, label string, confidence double",
    "edges": "eid string, src string, dst string, rel string, t_announce string, t_effective string, source string, confidence double, sentiment double",
}


class GraphBuilder:
    """``add`` takes a batch of facts; new nodes that match others move to one canonical node, edges follow.

    State is versioned by batch at ``path``: a builder started there goes on after the last committed batch, and a batch
    number that is committed already changes nothing. Without a path it lives as long as the driver, in the shared folder.
    Edges are kept per (src, rel, dst): the first stays.
    """

    def __init__(self, spark: SparkSession, start: Graph | None = None, eps: float = 0.85, path: str | None = None):
        if eps < 0.85:
            raise ValueError("a likeness below 0.85 joins different entities")
        self.spark, self.eps, self.cuts = spark, eps, Cuts(spark, "builder")
        self.state = Versions(spark, path or f"{self.cuts.base}/state", TABLES)
        saved = Graph(self.state.read("nodes"), self.state.read("edges"))
        self.graph = saved if self.state.version >= 0 or start is None else start

    @property
    def batches(self) -> int:
        return self.state.version + 1

    def add(self, facts: DataFrame, batch: int | None = None) -> Graph:
        with self.state.update(batch) as fresh:
            if fresh:
                self._add(facts)
        self.graph = Graph(self.state.read("nodes"), self.state.read("edges"))
        return self.graph

    def _add(self, facts: DataFrame) -> None:
        old = self.graph
        new = facts_to_graph(facts)
        fresh = self.cuts.cut(new.nodes.join(old.nodes.select("id"), "id", "left_anti").select(*old.nodes.columns))
        pairs = incremental_matches(fresh, old.nodes, self.eps)
        groups = components(pairs.select("a", "b"))
        everyone = old.nodes.withColumn("seq", F.lit(0)).unionByName(fresh.withColumn("seq", F.lit(1)))
        members = everyone.join(groups, "id").withColumnsRenamed({"component": "group_key", "id": "node"}).withColumn("seq", F.struct("seq", F.col("node")))
        best = pick_incremental(members)
        moved = members.select("node", "group_key").join(best.select("group_key", F.col("id").alias("to")), "group_key").select(F.col("node").alias("id"), "to")
        strength = members.groupBy("group_key").agg(F.max("confidence").alias("confidence"))
        merged = best.join(strength, "group_key").select("id", "name", "label", "confidence")
        nodes = everyone.drop("seq").join(moved.select("id"), "id", "left_anti").select("id", "name", "label", "confidence").unionByName(merged)
        nodes = nodes.groupBy("id").agg(F.min("name").alias("name"), F.min("label").alias("label"), F.max("confidence").alias("confidence"))
        edges = old.edges.withColumn("age", F.lit(0)).unionByName(new.edges.select(*old.edges.columns).withColumn("age", F.lit(1)))
        edges = rewire(edges, moved).where("src <> dst")
        rest = [c for c in edges.columns if c not in ("src", "rel", "dst")]
        first = edges.groupBy("src", "rel", "dst").agg(F.min_by(F.struct(*rest), F.struct("age", "eid")).alias("e"))
        everything = range(self.state.buckets)
        self.state.replace("nodes", nodes, "id", everything)
        self.state.replace("edges", first.select("src", "rel", "dst", "e.*"), "eid", everything)
        self.cuts.drop(fresh)

    def attach(self, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        """Feed the builder from a stream of facts. The checkpoint and the builder's path together are where a restart goes on."""
        writer = stream.writeStream.foreachBatch(lambda rows, batch: self.add(rows, batch) and None).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def attach_orphans(tracker: OrphanTracker, edges: DataFrame, entities: DataFrame, removed: DataFrame, checkpoint: str) -> StreamingQuery:
    """Keep an orphan tracker up to date with a stream of edges. The other two tables are read as they are at each batch; of
    them only what the tracker's index doesn't know is taken in. The checkpoint and the tracker's path go together."""

    def step(rows: DataFrame, batch: int) -> None:
        index = tracker.state.read("parents")
        made = parents(entities).join(index.where("known").select("id", "created"), ["id", "created"], "left_anti")
        gone = deletions(removed).join(index.select("id", "deleted"), ["id", "deleted"], "left_anti")
        tracker.advance(references(rows), made, gone, batch)

    return edges.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts and sums with a watermark, for event tables."""
    return events.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")
