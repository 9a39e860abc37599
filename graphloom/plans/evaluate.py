"""The evaluation harness."""

from __future__ import annotations

import time
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.text import same_answer
from graphloom.session import Cuts

if TYPE_CHECKING:
    from graphloom.plans.engine import Engine


def path_match(gold: Column, found: Column) -> Column:
    """Any gold (rel, obj) among the found triples, relation and object compared without case; null without a gold path."""
    key = lambda t: F.concat_ws("\x01", F.upper(t["rel"]), F.lower(t["obj"]))
    return F.when(gold.isNotNull() & (F.size(gold) > 0), F.arrays_overlap(F.transform(gold, key), F.transform(found, key)))


def exact_rank(rows: DataFrame, value: str, q: float) -> DataFrame:
    """One row with the value at place int(n q) of the sorted values, not interpolated; null without values.

    Counts per value are made first, so what is sorted and summed up is distinct values, streamed, not a list of all.
    """
    # distinct values only, in order by ranges: the sum up to a value is that of the ranges before it and within its own
    cuts = Cuts(rows.sparkSession, "rank")
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    parts = cuts.cut(counts.repartitionByRange("v").withColumn("p", F.spark_partition_id()))
    sums = parts.groupBy("p").agg(F.sum("n").alias("n")).orderBy("p").collect()  # a row a partition
    place, part = int(sum(r["n"] for r in sums) * q), None
    for r in sums:
        part = r["p"]
        if place < r["n"]:
            break
        place -= r["n"]
    run = parts.where(F.col("p") == part).withColumn("upto", F.sum("n").over(Window.partitionBy("p").orderBy("v")))
    return run.where(F.col("upto") > place).agg(F.min("v").alias("value"))


def run(engine: Engine, items: DataFrame, most: int = 1000) -> DataFrame:
    """The benchmark's questions put to the engine one by one, as its users do: rows for ``report``.

    ``items``: (question, gold_answer, gold_path). At most ``most`` questions, in order of their text; each has a session of its own.
    """
    rows = []
    for i, r in enumerate(items.where("question is not null").select("question", "gold_answer", "gold_path").orderBy("question", "gold_answer").limit(most).collect()):
        began = time.perf_counter()
        a = engine.ask(r["question"], session=f"benchmark-{i}")
        took = (time.perf_counter() - began) * 1000
        top = a.paths[0]["triples"] if a.paths else []
        said = a.candidates[0] if a.candidates else a.text
        rows.append((r["question"], r["gold_answer"], said, r["gold_path"], [(t["rel"], t["obj"]) for p in a.paths for t in p["triples"]], len(a.steps) / len(top) if top else 1.0, took))
    pair = "array<struct<rel:string,obj:string>>"
    return items.sparkSession.createDataFrame(rows, f"question string, gold_answer string, answer string, gold_path {pair}, triples {pair}, faithful double, latency double")


def report(results: DataFrame) -> DataFrame:
    """One row over (question, gold_answer, answer, gold_path, triples, faithful, latency): rates and latencies.

    The path match is the mean over the rows with a gold path; an empty table gives a row of nulls and 0.
    """
    r = results.withColumn("em", same_answer(F.col("gold_answer"), F.col("answer")).cast("int")).withColumn("pm", path_match(F.col("gold_path"), F.col("triples")).cast("int"))
    rates = r.agg(F.count("*").alias("n"), F.avg("em").alias("exact_match"), F.avg("pm").alias("path_match"), F.avg("faithful").alias("faithfulness"))
    for name, q in (("p50", 0.5), ("p95", 0.95)):
        rates = rates.join(F.broadcast(exact_rank(results, "latency", q).withColumnRenamed("value", name)))  # one row each
    return rates
