"""Problem 6: consolidating pairwise matches into groups.

Every record starts with its own id as label. A round lets each record take the least label among
its neighbours (partial minima before the shuffle, so a record with a third of all links is no
hot spot), then jumps: a label is replaced by the label of the record it names, which halves the
remaining distance. Each round's labels are written to the shared folder, which cuts the lineage
and survives lost executors; the rounds end when no label changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import Cuts


def linked_groups(pairs: DataFrame, left: str = "left_id", right: str = "right_id") -> DataFrame:
    """(group_id, member_id): each id of a row with both ids, under the least id it is linked to.

    Rows with a null id are ignored, an id linked only with itself is its own group, repeated and reversed
    links count once, an empty table gives no row; other columns are ignored.
    """
    cuts = Cuts(pairs.sparkSession, "groups")
    links = pairs.select(F.col(left).cast("string").alias("a"), F.col(right).cast("string").alias("b")).where("a is not null and b is not null")
    edges = cuts.cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    both = edges.where("u > v").select("u", "v").unionByName(edges.where("u > v").select(F.col("v").alias("u"), F.col("u").alias("v")))
    # first labels: the least of oneself and the neighbours, found in the same pass that lists the records
    labels = cuts.cut(edges.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("label"))).groupBy("id").agg(F.min("label").alias("label")))
    while True:
        near = both.join(labels.select(F.col("id").alias("v"), "label"), "v").groupBy(F.col("u").alias("id")).agg(F.min("label").alias("near"))
        # a record hands its neighbours' least label to the record its own label names, too, so roots hook onto roots
        known = labels.join(near, "id", "left").withColumn("best", F.least("label", "near"))
        hooks = known.where("best < label").select(F.col("label").alias("id"), "best")
        lowered = known.select("id", "label", F.col("best")).unionByName(hooks.select("id", F.lit(None).cast("string").alias("label"), "best")).groupBy("id").agg(F.max("label").alias("old"), F.min("best").alias("best"))
        step = cuts.cut(lowered)
        jumped = step.alias("x").join(step.select(F.col("id").alias("best"), F.col("best").alias("further")), "best", "left")
        after = cuts.cut(jumped.select("id", "old", F.least("best", "further").alias("label")))
        changed = after.where("label < old").limit(1).count()
        cuts.drop(step), cuts.drop(labels)
        labels = after
        if not changed:
            return labels.select(F.col("label").alias("group_id"), F.col("id").alias("member_id"))
