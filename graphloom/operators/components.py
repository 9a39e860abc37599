"""Connected components of a similarity graph by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import Cuts


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the least id each id of ``pairs`` is connected to.

    Large star: a node's greater neighbours are linked to its least one; small star: its lesser neighbours are. Each
    pair of steps is written to the shared folder; they end when every link leads to its component's least id, which
    takes a number of steps that grows with the logarithm of the longest chain squared at most.
    """
    cuts = Cuts(pairs.sparkSession, "components")
    links = cuts.cut(pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null").distinct())
    loops = links.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    e = links.where("u <> v")
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u")
        step = small.select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = cuts.cut(step)
        # stars only: no node is both a leaf and a centre, and no leaf has two centres
        deep = new.select(F.col("v").alias("u")).distinct().join(new.select("u"), "u", "left_semi").limit(1).count()
        twice = new.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        e = new
        if not deep and not twice:
            return loops.join(e.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
