"""Answers and their steps in words, and whether the steps are grounded in the triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import relation_phrase

NO_PATH = "I could not find a relevant answer in the Knowledge Graph for your query. Please try rephrasing with a specific company name, event, or indicator."
NO_ANSWER = "I could not find a direct answer in the Knowledge Graph. Please try a more specific query."


def step_sentence(step: Column, t: Column) -> Column:
    """Step n: **subject** phrase **object**, with the time and source where known."""
    time = F.when(F.coalesce(t["time"], F.lit("")) != "", F.concat(F.lit(" (recorded: "), t["time"], F.lit(")"))).otherwise("")
    source = F.when(F.coalesce(t["source"], F.lit("")) != "", F.concat(F.lit(" [Source: "), t["source"], F.lit("]"))).otherwise("")
    return F.concat(F.lit("Step "), step.cast("string"), F.lit(": **"), t["subj"], F.lit("** "), relation_phrase(t["rel"]), F.lit(" **"), t["obj"], F.lit("**"), time, source, F.lit("."))


def steps(paths: DataFrame) -> DataFrame:
    return paths.withColumn("steps", F.transform("triples", lambda t, i: step_sentence(i + 1, t)))


def triple_line(t: Column) -> Column:
    """subject -[REL]-> object (time) as models are given it."""
    return F.concat(t["subj"], F.lit(" -["), t["rel"], F.lit("]-> "), t["obj"], F.when(F.coalesce(t["time"], F.lit("")) != "", F.concat(F.lit(" ("), t["time"], F.lit(")"))).otherwise(""))


def answer(triples: Column, candidates: Column, kind: Column) -> Column:
    """The template that fits: no path (null), no triples with or without candidates, one triple, or a chain."""
    one = F.get(triples, F.lit(0))
    as_of = F.when(F.coalesce(one["time"], F.lit("")) != "", F.concat(F.lit(" (as of "), one["time"], F.lit(")"))).otherwise("")
    single = F.concat(F.lit("**"), one["subj"], F.lit("** "), relation_phrase(one["rel"], answers=True), F.lit(" **"), one["obj"], F.lit("**"), as_of, F.lit("."))
    chain = F.array_join(F.transform(triples, lambda t: F.concat(t["subj"], F.lit(" -["), t["rel"], F.lit("]-> "), t["obj"])), "  ->  ")
    last = F.element_at(triples, -1)["obj"]
    told = F.concat(F.lit("Following the reasoning chain:\n"), chain, F.lit("\n\n**Answer: "), last, F.lit("**"))
    known = F.concat(F.lit("Based on the KG, the answer is: **"), F.array_join(candidates, ", "), F.lit("**."))
    return (
        F.when(triples.isNull(), NO_PATH)
        .when(F.size(triples) == 0, F.when(F.size(candidates) > 0, known).otherwise(NO_ANSWER))
        .when((kind == "single_hop") & (F.size(triples) == 1), single)
        .otherwise(told)
    )


def is_grounded(sentence: Column, triples: Column) -> Column:
    """Two of subject, object and relation of some triple occur in the sentence; names of two letters don't count."""
    s = F.lower(sentence)

    def two_of(t: Column) -> Column:
        name = lambda n: F.coalesce((F.length(n) > 2) & F.contains(s, F.lower(n)), F.lit(False)).cast("int")
        rel = F.coalesce((t["rel"] != "") & F.contains(s, F.replace(F.lower(t["rel"]), F.lit("_"), F.lit(" "))), F.lit(False)).cast("int")
        return name(t["subj"]) + name(t["obj"]) + rel >= 2

    return F.exists(triples, two_of)


def verify(rows: DataFrame, threshold: float = 0.80) -> DataFrame:
    """``rows(id, steps, triples)`` to the grounded steps, their share (1 without steps, 3 digits) and whether it passes."""
    good = F.filter("steps", lambda s: is_grounded(s, F.col("triples")))
    share = F.when(F.size("steps") == 0, F.lit(1.0)).otherwise(F.size(good) / F.size("steps"))
    return rows.withColumn("verified", good).withColumn("alignment", F.round(share, 3)).withColumn("passed", share >= threshold)
