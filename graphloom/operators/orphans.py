"""References to records that do not exist, kept up to date incrementally.

State, all of it bucketed by id and versioned by batch (``graphloom.state``):

* parent index: per id the earliest creation and the earliest deletion seen so far,
* references: every reference that names an id; batches only append to it,
* orphans: the references that named no living record when they were made, with the reason and
  whether the record has turned up since (``resolved``).

A batch rewrites the buckets whose parents arrive or go, and appends new orphans to the others. With a path the state
outlives the driver: a tracker started there goes on after the last committed batch.

``OrphanTracker.advance`` takes one batch of new references, parents and deletions: the new
references probe the updated parent index; arriving parents resolve waiting orphans (a `missing` one
turns `late`); arriving deletions reopen what points at the deleted record. ``snapshot`` counts the
orphans per table and month. Batches may come from a stream (``foreachBatch``) or from a fold over
periods of stored tables, as in ``track``.

A hot id is no hot task: it is probed from the parent side, which has one row per id, the skewed
side is split by AQE, and its bucket is written by several tasks; nothing is gathered per id.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import shared_dir
from graphloom.state import Versions

REFERENCE = "ref_no long, side string, id string, at timestamp"


def reference_id(c: str | Column) -> Column:
    """An id without outer spaces and case; null where blank."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.upper(F.regexp_replace(c, r"^[\s\u00A0]+|[\s\u00A0]+$", ""))
    return F.when(t != "", t)


def references(edges: DataFrame, number: str = "edge_no", at: str = "created_at", sides: Sequence[str] = ("source", "target")) -> DataFrame:
    """One row (ref_no, side, id, at) per reference; null and blank ids refer to nothing."""
    refs = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), reference_id(s).alias("id")) for s in sides])).alias("r")
    return edges.select(F.col(number).alias("ref_no"), F.col(at).alias("at"), refs).select("ref_no", "r.side", "r.id", "at").where("id is not null")


def parents(entities: DataFrame, id: str = "id", at: str = "created_at") -> DataFrame:
    return entities.select(reference_id(id).alias("id"), F.col(at).alias("created")).where("id is not null").groupBy("id").agg(F.min("created").alias("created"))


def deletions(rows: DataFrame, id: str = "id", at: str = "deleted_at") -> DataFrame:
    return rows.select(reference_id(id).alias("id"), F.col(at).alias("deleted")).where("id is not null and deleted is not null").groupBy("id").agg(F.min("deleted").alias("deleted"))


TABLES = {"parents": "id string, created timestamp, deleted timestamp, known boolean", "references": REFERENCE, "orphans": REFERENCE + ", why string, resolved boolean"}


class OrphanTracker:
    """Keyed pending-orphan state. Without a ``path`` it lives as long as the driver, in the shared folder."""

    def __init__(self, spark: SparkSession, keep_references: bool = True, path: str | None = None, buckets: int = 16):
        self.spark, self.keep_references = spark, keep_references
        self.state = Versions(spark, path or f"{shared_dir(spark)}/orphans-{uuid.uuid4().hex}", TABLES, buckets)
        if path is None:
            atexit.register(_forget, self.state)

    def advance(self, refs: DataFrame, new_parents: DataFrame, new_deletions: DataFrame, batch: int | None = None) -> None:
        """Take in a batch. A parent with unknown creation time counts as existing from the beginning. A ``batch`` number
        that is committed already is skipped."""
        with self.state.update(batch) as fresh:
            if fresh:
                self._advance(self.state, refs, new_parents, new_deletions)

    def _advance(self, s: Versions, refs: DataFrame, new_parents: DataFrame, new_deletions: DataFrame) -> None:
        arrivals = new_parents.select("id", "created", F.lit(None).cast("timestamp").alias("deleted"), F.lit(True).alias("known"))
        removals = new_deletions.select("id", F.lit(None).cast("timestamp").alias("created"), "deleted", F.lit(None).cast("boolean").alias("known"))
        changes = arrivals.unionByName(removals)
        touched = s.touched(changes, "id")
        if touched:
            merged = s.read("parents", touched).unionByName(changes).groupBy("id").agg(F.min("created").alias("created"), F.min("deleted").alias("deleted"), F.max("known").alias("known"))
            s.replace("parents", merged, "id", touched)
        index = s.read("parents")
        living = F.coalesce(F.col("known") & F.col("deleted").isNull(), F.lit(False))
        if touched:
            # arriving parents resolve waiting orphans, arriving deletions reopen resolved ones
            now = s.read("parents", touched).join(changes.select("id").distinct(), "id", "left_semi").withColumn("touched", F.lit(True))
            settled = F.when((F.col("why") == "missing") & F.col("known"), "late").otherwise(F.col("why"))
            kept = s.read("orphans", touched).join(now, "id", "left").select("ref_no", "side", "id", "at", settled.alias("why"), F.when(F.col("touched"), living).otherwise(F.col("resolved")).alias("resolved"))
            if self.keep_references:
                # references that were sound when made and lose their record now
                lost = removals.select("id").distinct().join(s.read("parents", touched).where("known"), "id").select("id", "deleted")
                reopened = s.read("references", touched).join(lost, "id").where("deleted > at").join(s.read("orphans", touched).select("ref_no", "side"), ["ref_no", "side"], "left_anti")
                kept = kept.unionByName(reopened.select("ref_no", "side", "id", "at", F.lit("dangling").alias("why"), F.lit(False).alias("resolved")))
            s.replace("orphans", kept, "id", touched, "ref_no")
        probe = F.when(F.col("known").isNull(), "missing").when(F.col("created") > F.col("at"), "late").when(F.col("deleted") <= F.col("at"), "deleted")
        fresh = refs.join(index, "id", "left").withColumn("why", probe).where("why is not null")
        s.append("orphans", fresh.select("ref_no", "side", "id", "at", "why", living.alias("resolved")), "id", "ref_no")
        if self.keep_references:
            s.append("references", refs, "id", "ref_no")

    def found(self) -> DataFrame:
        """References without a living record when they were made: (ref_no, side, why, month)."""
        return self.state.read("orphans").where("why <> 'dangling'").select("ref_no", "side", "why", F.date_format("at", "yyyy-MM").alias("month"))

    def snapshot(self) -> DataFrame:
        """Open and resolved orphans per side, reason and month."""
        return self.state.read("orphans").groupBy("side", "why", F.date_format("at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.sum((~F.col("resolved")).cast("long")).alias("open"))


def _forget(state: Versions) -> None:
    try:
        state.clear()
    except Exception:  # the session is gone; so is whoever could read the state
        pass


def track(edges: DataFrame, entities: DataFrame, removed: DataFrame, periods: int = 3, keep_references: bool = False) -> OrphanTracker:
    """Fold stored tables through the tracker in ``periods`` batches of event time.

    What arrives in a batch is what is dated in its period: the earliest creation and deletion of an id, and the
    references made. Rows without a date come in the first batch; a reference without a date is no case, since
    what existed then is unknown. An empty table is an empty batch; other columns are ignored.
    """
    refs = references(edges).where("at is not null")
    made, gone = parents(entities), deletions(removed)
    lo, hi = refs.agg(F.min("at"), F.max("at")).first()
    tracker = OrphanTracker(edges.sparkSession, keep_references)
    if lo is None:
        return tracker
    step = (hi - lo) / periods
    ends = [lo + step * (i + 1) for i in range(periods - 1)]

    def between(df: DataFrame, c: str, i: int) -> DataFrame:
        after = F.col(c) > F.lit(ends[i - 1]) if i else F.lit(True)
        before = F.col(c) <= F.lit(ends[i]) if i < len(ends) else F.lit(True)
        undated = F.col(c).isNull() if i == 0 else F.lit(False)
        return df.where((after & before) | undated)

    for i in range(periods):
        tracker.advance(between(refs, "at", i), between(made, "created", i), between(gone, "deleted", i))
    return tracker
