"""Upserts, unions and entity resolution on graphs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom import vocab
from graphloom.functions import text
from graphloom.functions.numeric import sentiment_bucket
from graphloom.operators.clean import keep_first, without_loops
from graphloom.operators.components import components
from graphloom.operators.graph import Graph


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of both by key: a new row's values win where they are not null. Within ``new`` the last in ``order`` counts."""
    rest = [c for c in old.columns if c not in keys]
    if order:
        new = new.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in new.columns if c not in keys]), F.col(order)).alias("r")).select(*keys, "r.*")
    a = old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in rest])
    b = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in rest if c in new.columns])
    value = lambda c: F.coalesce(f"new_{c}", f"old_{c}") if c in new.columns else F.col(f"old_{c}")
    return a.join(b, keys, "full").select(*keys, *[value(c).alias(c) for c in rest]).select(*old.columns)


def last_write(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last version of each key, whole."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*").select(*rows.columns)


def merge_graphs(first: Graph, second: Graph) -> Graph:
    """Nodes by id and edges by (src, rel, dst); the second graph's rows replace the first's."""

    def both(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
        cols = [c for c in a.columns if c in b.columns]
        rows = a.select(*cols, F.lit(1).alias("_v")).unionByName(b.select(*cols, F.lit(2).alias("_v")))
        return last_write(rows, keys, "_v").drop("_v")

    return Graph(both(first.nodes, second.nodes, ["id"]), both(first.edges, second.edges, ["src", "rel", "dst"]))


def add_sources(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct sources of each key over all its rows, in order."""
    return rows.select(*keys, F.explode("sources").alias("s")).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("s")).alias("sources"))


def _ratio(a: pd.Series, b: pd.Series, least: float) -> pd.Series:
    from difflib import SequenceMatcher

    # the second text is indexed by the matcher; pairs come sorted by it, so it is indexed once per run of equal ones
    out, matcher, last = [], SequenceMatcher(None), None
    for x, y in zip(a, b):
        if y != last:
            matcher.set_seq2(y)
            last = y
        matcher.set_seq1(x)
        out.append(matcher.ratio() if matcher.quick_ratio() >= least else 0.0)
    return pd.Series(out)


def ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    """Ratcliff-Obershelp ratio of two columns, or 0 where it must be below ``least``; it isn't symmetric."""

    @F.pandas_udf("double")
    def f(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield _ratio(x, y, least)

    return f(a, b)


def length_bound(a: Column, b: Column) -> Column:
    """What the ratio can be at most, by length alone: 2 min / (sum)."""
    return 2 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b))


def gram_prefix(names: DataFrame, key: list[str], c: str, threshold: float) -> DataFrame:
    """(*key, gram): as many of each name's rarest bigrams as two names of that ratio must share one of.

    A ratio r of texts of mean length m means at least r m matched letters in at most (2 - 2 r) m + 1 blocks, hence at
    least (3 r - 2) m - 1 common bigrams, repeats numbered. So no pair of that ratio is lost.
    """
    n = F.length(c)
    raw = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(F.col(c), i, F.lit(2)))
    grams = names.where(n >= 2).select(*key, n.alias("_n"), raw.alias("_g")).select(*key, "_n", F.posexplode("_g").alias("_i", "_g"))
    grams = grams.withColumn("gram", F.concat_ws("#", "_g", F.row_number().over(Window.partitionBy(*key, "_g").orderBy("_i")).cast("string")))
    df = grams.groupBy("gram").agg(F.count("*").alias("_df"))
    shared = F.greatest(F.lit(1), F.ceil((3 * threshold - 2) * (1 + threshold / (2 - threshold)) / 2 * F.col("_n") - 1))
    at = F.row_number().over(Window.partitionBy(*key).orderBy("_df", "gram"))
    return grams.join(df, "gram").withColumn("_at", at).where(F.col("_at") <= F.col("_n") - 1 - shared + 1).select(*key, "gram")


def normal_names(nodes: DataFrame) -> DataFrame:
    """Distinct (label, norm) of the names that may be merged; copies of a name cost nothing."""
    n = nodes.withColumn("norm", text.strip_legal_suffixes(F.col("name")))
    return n.where((F.col("norm") != "") & ~F.col("label").isin(*vocab.UNMERGED_LABELS) & ~text.is_never_merged(F.col("name"))).select("label", "norm").distinct()


def block_pairs(nodes: DataFrame, prefix: int = 3) -> DataFrame:
    """Pairs of distinct normal names of one label that share a prefix: (label, a, b), an equi-join on the block."""
    n = normal_names(nodes).withColumn("block", F.substring("norm", 1, prefix))
    x, y = n.select("label", "block", F.col("norm").alias("a")), n.select("label", "block", F.col("norm").alias("b"))
    return x.join(y, ["label", "block"]).where("a < b").select("label", "a", "b")


def alike_pairs(nodes: DataFrame, threshold: float, prefix: int = 3) -> DataFrame:
    """Those of ``block_pairs`` that can have a ratio of ``threshold``: joined by rare bigrams, not by the whole block."""
    g = gram_prefix(normal_names(nodes), ["label", "norm"], "norm", threshold).withColumn("block", F.substring("norm", 1, prefix))
    x, y = g.select("label", "block", "gram", F.col("norm").alias("a")), g.select("label", "block", "gram", F.col("norm").alias("b"))
    return x.join(y, ["label", "block", "gram"]).where("a < b").select("label", "a", "b").distinct()


def similar_pairs(pairs: DataFrame, threshold: float = 0.88, indicator: float = 0.92, measure: str = "ratio") -> DataFrame:
    """Pairs that are alike enough in either direction and aren't protected; a cheap bound goes before the ratio.

    ``measure`` levenshtein is the stand-in that SQL can state: 1 - distance / longer length.
    """
    least = F.when(F.col("label") == "Indicator", F.lit(indicator)).otherwise(F.lit(threshold))
    p = pairs.where(~text.is_protected_pair(F.col("a"), F.col("b")))
    if measure == "levenshtein":
        return p.where(1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b")) >= least)
    p = p.where(length_bound(F.col("a"), F.col("b")) >= least)
    lowest = min(threshold, indicator)
    return p.where(F.greatest(ratio(F.col("a"), F.col("b"), lowest), ratio(F.col("b"), F.col("a"), lowest)) >= least)


def name_groups(nodes: DataFrame, threshold: float = 0.88, indicator: float = 0.92, measure: str = "ratio") -> DataFrame:
    """(id, group_key): nodes of one label whose normal names are equal or connected by likeness."""
    # the bigram bound holds for the ratio only
    pairs = alike_pairs(nodes, min(threshold, indicator)) if measure == "ratio" else block_pairs(nodes)
    alike = similar_pairs(pairs, threshold, indicator, measure)
    key = lambda c: F.concat_ws("\x01", "label", c)
    groups = components(alike.select(key("a").alias("a"), key("b").alias("b")))
    n = nodes.where(~F.col("label").isin(*vocab.UNMERGED_LABELS) & ~text.is_never_merged(F.col("name"))).withColumn("norm", text.strip_legal_suffixes(F.col("name"))).where("norm <> ''")
    n = n.select(F.col("id").alias("node"), key("norm").alias("id"))
    return n.join(groups, "id", "left").select(F.col("node").alias("id"), F.coalesce("component", F.col("id")).alias("group_key"))


def canonical_names(members: DataFrame) -> DataFrame:
    """(group_key, canonical_id, canonical_name): by the table of set names, the first rule that fits a member, else the
    longest name, ties to the least id. ``members``: (group_key, id, name, label)."""
    rules = [F.when((F.lower("label") == label) & F.contains(text.strip_legal_suffixes(F.col("name")), F.lit(part)), F.lit(i)) for i, (label, part, _) in enumerate(vocab.CANONICAL_NAMES)]
    rows = members.withColumn("rule", F.coalesce(*rules))
    best = rows.groupBy("group_key").agg(
        F.min("rule").alias("rule"), F.min_by(F.struct("id", "name"), F.struct(-F.length("name"), F.col("id"))).alias("m"), F.count("*").alias("size")
    )
    names = F.array(*[F.lit(n) for *_, n in vocab.CANONICAL_NAMES])
    return best.select("group_key", F.col("m.id").alias("canonical_id"), F.coalesce(F.get(names, F.col("rule")), F.col("m.name")).alias("canonical_name"), "size")


def rewired_count(edges: DataFrame, redirect: DataFrame) -> DataFrame:
    """One row: how many ends ``rewire`` replaces."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return ends.join(redirect.select("id").distinct(), "id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rewired"))


def rewire(edges: DataFrame, redirect: DataFrame) -> DataFrame:
    """Edges with both ends replaced by ``redirect(id, to)`` where it names them."""
    a, b = redirect.select(F.col("id").alias("src"), F.col("to").alias("src_to")), redirect.select(F.col("id").alias("dst"), F.col("to").alias("dst_to"))
    rows = edges.join(a, "src", "left").join(b, "dst", "left")
    return rows.withColumns({"src": F.coalesce("src_to", "src"), "dst": F.coalesce("dst_to", "dst")}).select(*edges.columns)


def merge_entities(graph: Graph, threshold: float = 0.88, order: str = "eid", measure: str = "ratio") -> tuple[Graph, DataFrame]:
    """Near-duplicate nodes merged within their label, and the plan (id, to, canonical_name) of what moves.

    Edges are rewired, loops and repeats that result removed; orphans stay until the graph is cleaned again.
    """
    groups = name_groups(graph.nodes, threshold, measure=measure).join(graph.nodes.select("id", "name", "label"), "id")
    best = canonical_names(groups).where("size > 1")
    plan = groups.join(best, "group_key").select("id", F.col("canonical_id").alias("to"), "canonical_name")
    moved = plan.where("id <> to")
    kept = plan.where("id = to").select("id", "canonical_name")
    nodes = graph.nodes.join(moved.select("id"), "id", "left_anti").join(kept, "id", "left").withColumn("name", F.coalesce("canonical_name", "name")).select(*graph.nodes.columns)
    edges = keep_first(without_loops(rewire(graph.edges, moved)), ["src", "rel", "dst"], order)
    return Graph(nodes, edges), plan


def incremental_matches(new: DataFrame, known: DataFrame, eps: float = 0.85, measure: str = "ratio") -> DataFrame:
    """(a, b) ids of new nodes and what they match: other new ones of their label, and known ones under the same four
    letters. Alike by ratio, or equal but for suffixes; noise names match nothing; never across labels."""
    ready = lambda df: df.where(~text.is_build_noise(F.col("name"))).select("id", "label", F.lower(F.trim("name")).alias("n"), text.strip_legal_suffixes(F.col("name")).alias("s"))
    x, y = ready(new), ready(known)
    least = max(0.85, eps)
    # all pairs of a label that can be alike share a rare bigram; those equal but for suffixes share the rest
    names = x.select("label", "n").distinct()
    everyone = x.select("label", "n", "s").unionByName(y.select("label", "n", "s")).distinct()
    if measure == "ratio":
        g = gram_prefix(everyone.select("label", "n").distinct(), ["label", "n"], "n", least)
        near = names.join(g, ["label", "n"]).join(g.select("label", "gram", F.col("n").alias("m")), ["label", "gram"]).select("label", "n", "m")
    else:  # no bound holds: all of a label
        near = names.join(everyone.select("label", F.col("n").alias("m")).distinct(), "label")
    rest = everyone.where(F.length("s") >= 4)
    same_rest = names.join(rest, ["label", "n"]).join(rest.select("label", "s", F.col("n").alias("m")), ["label", "s"]).select("label", "n", "m")
    pairs = near.select("label", "n", "m").unionByName(same_rest).unionByName(names.select("label", "n", F.col("n").alias("m"))).distinct().alias("p")
    both = pairs.join(x.alias("x"), F.expr("x.label = p.label and x.n = p.n")).join(x.alias("y"), F.expr("y.label = p.label and y.n = p.m"))
    # the ratio is taken from the lesser id to the greater, whichever name comes first
    within = both.where("x.id < y.id").select(F.struct("x.*").alias("x"), F.struct("y.*").alias("y"))
    across = pairs.where("substring(p.n, 1, 4) = substring(p.m, 1, 4)").join(x.alias("x"), F.expr("x.label = p.label and x.n = p.n")).join(y.alias("y"), F.expr("y.label = p.label and y.n = p.m")).where("x.id <> y.id")
    cols = [F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"), F.col("x.s").alias("sa"), F.col("y.s").alias("sb")]
    pairs = within.select(*cols).unionByName(across.select(*cols))
    same = (F.col("sa") == F.col("sb")) & (F.length("sa") >= 4)
    if measure == "levenshtein":
        alike = 1 - F.levenshtein("na", "nb") / F.greatest(F.length("na"), F.length("nb")) >= least
        return pairs.where(same | alike).select("a", "b")
    maybe = pairs.where(same | (length_bound(F.col("na"), F.col("nb")) >= least))
    return maybe.where(same | (ratio(F.col("na"), F.col("nb"), least) >= least)).select("a", "b")


def pick_incremental(members: DataFrame) -> DataFrame:
    """(group_key, id, name, label): the member of the greatest confidence x min(words / 2, 1.5), halved for names of
    two letters; ties to the first in ``seq``. A missing label is filled from the group."""
    words = F.size(F.split(F.trim("name"), r"\s+"))
    worth = F.coalesce("confidence", F.lit(0.0)) * F.least(words / 2, F.lit(1.5)) * F.when(F.length(F.trim("name")) <= 2, 0.5).otherwise(1.0)
    best = members.groupBy("group_key").agg(F.min_by(F.struct("name", "label"), F.struct(-worth, F.col("seq"))).alias("m"), F.min_by("label", F.when(F.col("label").isNotNull(), F.col("seq"))).alias("any_label"))
    label = F.coalesce("m.label", "any_label", F.lit(""))
    return best.select("group_key", text.stable_id(F.col("m.name"), label).alias("id"), F.col("m.name").alias("name"), label.alias("label"))


def group_attributes(members: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Greatest confidence, and of every other attribute the first value that isn't null, in order."""
    rest = [c for c in members.columns if c not in (*keys, order, "confidence")]
    return members.groupBy(*keys).agg(F.max("confidence").alias("confidence"), *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest])


def remap_ends(edges: DataFrame, by_id: DataFrame, by_name: DataFrame) -> DataFrame:
    """Edge ends through (id, to), else through the lower-case name (name, to), else as they are."""
    for c in ("src", "dst"):
        ids, names = by_id.select(F.col("id").alias(c), F.col("to").alias("_i")), by_name.select(F.col("name").alias("_k"), F.col("to").alias("_n"))
        edges = edges.join(ids, c, "left").withColumn("_k", F.lower(F.trim(c))).join(names, "_k", "left").withColumn(c, F.coalesce("_i", "_n", c)).drop("_i", "_n", "_k")
    return edges


def fold_sentiment(edges: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Per edge key the running mean of its sentiments, its bucket, and its sources in order."""
    from graphloom.operators.series import running_sentiment

    key = F.concat_ws("\x01", *keys)
    mood = running_sentiment(edges.withColumn("_key", key), "_key", order, "sentiment")
    base = edges.withColumn("_key", key).groupBy("_key", *keys).agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return base.join(mood, "_key", "left").select(*keys, "sentiment", sentiment_bucket(F.col("sentiment")).alias("sentiment_label"), "sources")
