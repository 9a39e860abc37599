"""Problem 8: filling fixed-capacity containers with texts.

Hierarchical multi-length packing. A text's token count routes it to the shortest context tier
that holds it (capacity, capacity / 2, ...). Every tier has windows of its own length. What must be
known to pack is only how many pieces there are of each size, a table of at most ``capacity`` rows
however large the corpus; on it a plan is made on the driver, from the longest tier to the shortest:

1. A tier's pieces open its windows, as many as fit; the gaps are filled best-fit from shorter tiers only.
2. A window that no shorter tier could fill up to ``slack`` of its length is given up: its pieces go into
   windows of the full capacity, packed after all tiers, largest first.
3. Windows are placed in containers like buddies: 2, 4, .. windows of a half, a quarter, .. of the capacity.
4. Containers are numbered by falling attention cost (the sum of squared piece lengths) and dealt to the
   step groups in turn, so two groups differ by one container at most, and in cost by the cost of one.

A piece finds its place in the plan by its rank within its size, which is the sum of the counts of
earlier input partitions and its place in its own, so no size is ever gathered in one task. Texts
longer than a container are cut at container length; only the rest is packed.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.session import Cuts

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokeniser of the byte-level vocabularies (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(path: str):
    """text -> number of tokens, by the kind of vocabulary file."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        e = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda t: len(e.encode_ordinary(t))
    if path.endswith(".model"):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(p.encode(t))
    from tokenizers import Tokenizer

    k = Tokenizer.from_file(path)
    k.encode_special_tokens = True
    return lambda t: len(k.encode(t, add_special_tokens=False).ids)


SIZED = "doc_id long, part int, n_tokens long, rest int, place long"


def sized(docs: DataFrame, capacity: int, tokenizer: str) -> DataFrame:
    """Per text: tokens, tokens beyond full containers (``rest``), and its place among the texts of
    that rest in its input partition ``part``. Null and empty texts have 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen, part = encoder(tokenizer), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            n = [count(t) if t else 0 for t in batch.column(1).to_pylist()]
            rest = [x % capacity for x in n]
            place = []
            for r in rest:
                place.append(seen[r])
                seen[r] += 1
            cols = [batch.column(0), pa.array([part] * len(n), pa.int32()), pa.array(n, pa.int64()), pa.array(rest, pa.int32()), pa.array(place, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "part", "n_tokens", "rest", "place"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SIZED)


Windows = tuple[int, int, list[tuple[int, int]]]


def fill_windows(left: dict[int, int], window: int, opening: list[int], shorter: int) -> list[Windows]:
    """Windows (how many, length, [(size, pieces in each), ...]) opened by each of the sizes ``opening`` in turn.

    A gap takes more of the opening size or the best-fitting size of at most ``shorter``, each step for as many like
    windows as there are pieces. What is used is taken from ``left``.
    """
    done: list[Windows] = []
    for size in opening:
        while left.get(size):
            per = min(window // size, left[size])
            n = left[size] // per
            inside, gap = [(size, per)], window - per * size
            left[size] -= n * per
            while fit := max((s for s, k in left.items() if k and s <= min(gap, shorter)), default=0):
                each = max(1, min(gap // fit, left[fit] // n))
                m = min(n, left[fit] // each)
                if m < n:  # the windows that get none are filled in another way
                    for s, k in inside:
                        left[s] = left.get(s, 0) + (n - m) * k
                    n = m
                left[fit] -= each * n
                inside.append((fit, each))
                gap -= each * fit
            done.append((n, window, inside))
    return done


def plan(sizes: dict[int, int], capacity: int, tiers: tuple[int, ...], slack: float = 1 / 64) -> list[tuple[int, list[Windows]]]:
    """Containers (how many, windows in each) that use up ``sizes``; a window is (how many, length, [(size, pieces), ...])."""
    left = {s: n for s, n in sizes.items() if n > 0}
    windows: list[Windows] = []
    for window, shorter in zip(tiers, [*tiers[1:], 0]):
        opening = sorted((s for s in left if shorter < s <= window), reverse=True)
        windows += fill_windows(left, window, opening, shorter or window)
    kept, again = [], Counter()
    for n, window, inside in windows:
        if window < capacity and window - sum(s * k for s, k in inside) > slack * window:
            for s, k in inside:
                again[s] += n * k
        else:
            kept.append((n, window, inside))
    # what the tiers could not place tightly: the emptiest full windows are opened again with it
    for n, window, inside in [w for w in kept if w[1] == capacity]:
        if again and capacity - sum(s * k for s, k in inside) >= min(again):
            kept.remove((n, window, inside))
            for s, k in inside:
                again[s] += n * k
    kept += fill_windows(again, capacity, sorted(again, reverse=True), capacity)
    kept.sort(key=lambda w: -w[1])
    return buddies(kept, capacity)


def buddies(windows: list[Windows], capacity: int) -> list[tuple[int, list[Windows]]]:
    """Containers of windows by falling length; each length divides the one before, so a window always fits or starts anew."""
    out: list[tuple[int, list[Windows]]] = []
    inside: list[Windows] = []
    room = capacity
    for n, window, pieces in windows:
        while n:
            if room == capacity and n * window >= capacity:
                k = capacity // window
                out.append((n // k, [(k, window, pieces)]))
                n %= k
                continue
            k = min(n, room // window)
            inside.append((k, window, pieces))
            n, room = n - k, room - k * window
            if not room:
                out.append((1, inside))
                inside, room = [], capacity
    return out + ([(1, inside)] if inside else [])


def cost(windows: list[Windows]) -> int:
    """Attention cost of a container: the sum of its squared piece lengths."""
    return sum(n * k * s * s for n, _, inside in windows for s, k in inside)


def slots_of(containers: list[tuple[int, list[Windows]]], first: int) -> dict[int, np.ndarray]:
    """Per size the rows (first rank, first container, pieces there, place of the first, window) of its places, by rank."""
    slots: dict[int, list] = {}
    taken: Counter = Counter()
    for n, windows in containers:
        at = 0
        for k, window, inside in windows:
            for _ in range(k):
                start = at
                for size, per in inside:
                    slots.setdefault(size, []).append((taken[size], first, per, start, window))
                    taken[size] += n * per
                    start += size * per
                at += window
        first += n
    return {s: np.array(v, np.int64) for s, v in slots.items()}


def pack(docs: DataFrame, capacity: int = 2048, tiers: tuple[int, ...] = (2048, 1024, 512, 256), step_containers: int = 64, tokenizer: str = TOKENIZER, slack: float = 1 / 64) -> DataFrame:
    """Pieces of all texts with their container.

    (doc_id, piece, token_start, n_tokens, tier, container_id, container_start, window, step_group). A text of up
    to ``capacity`` tokens is one piece; a longer one is cut into full pieces and a rest. Null and empty texts,
    and texts without tokens, are one piece of 0 tokens without container. Repeated rows are packed each.
    """
    if tiers[0] != capacity or any(a <= b or a % b for a, b in zip(tiers, tiers[1:])):
        raise ValueError("tiers must fall from the capacity, each dividing the one before")
    spark = docs.sparkSession
    cuts = Cuts(spark, "packing")
    texts = cuts.cut(sized(docs, capacity, tokenizer))
    return place(texts, cuts, capacity, tiers, step_containers, slack)


def place(texts: DataFrame, cuts: Cuts, capacity: int, tiers: tuple[int, ...], step_containers: int, slack: float) -> DataFrame:
    """Places in containers for the rows of ``sized``."""
    spark = texts.sparkSession
    full = F.expr(f"n_tokens div {capacity}")
    counts = texts.where("rest > 0").groupBy("part", "rest").agg(F.count("*").alias("n"))
    w = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cuts.cut(counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))))
    histogram = {r["rest"]: r["n"] for r in offsets.groupBy("rest").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    n_full = texts.agg(F.coalesce(F.sum(full), F.lit(0)).alias("n")).first()["n"]
    # full pieces fill the costliest containers, which come first
    containers = sorted(plan(histogram, capacity, tiers, slack), key=lambda c: -cost(c[1]))
    total = n_full + sum(n for n, _ in containers)
    look = spark.sparkContext.broadcast(slots_of(containers, n_full))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 4))
            container, start, window = (np.full(len(size), -1, np.int64) for _ in range(3))
            for s in np.unique(size[size > 0]):
                k, t = np.flatnonzero(size == s), look.value[int(s)]
                slot = t[np.searchsorted(t[:, 0], rank[k], "right") - 1]
                container[k] = slot[:, 1] + (rank[k] - slot[:, 0]) // slot[:, 2]
                start[k] = slot[:, 3] + (rank[k] - slot[:, 0]) % slot[:, 2] * s
                window[k] = slot[:, 4]
            cols = [*batch.columns[:4], pa.array(container), pa.array(start), pa.array(window)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "full_before", "rest", "container", "start", "window"])

    # joined by a shuffle of short rows: the offsets grow with the number of input partitions and aren't broadcast
    ranked = texts.join(offsets.select("part", "rest", "before").hint("shuffle_hash"), ["part", "rest"], "left").withColumn("rank", F.col("place") + F.coalesce("before", F.lit(0)))
    rests = ranked.select("doc_id", "n_tokens", full.alias("full_before"), "rest", "rank").mapInArrow(find, "doc_id long, n_tokens long, full_before long, rest int, container long, start long, window long")
    here = lambda c, t="int": F.when(F.col("rest") > 0, F.col(c).cast(t))
    rest_rows = rests.where("rest > 0 or n_tokens = 0").select("doc_id", F.col("full_before").cast("int").alias("piece"), (F.col("full_before") * capacity).alias("token_start"), F.col("rest").alias("n_tokens"), here("container", "long").alias("container_id"), here("start").alias("container_start"), here("window").alias("window"))
    # a row per input partition
    before = texts.groupBy("part").agg(F.sum(full).alias("n")).withColumn("full_parts", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    long_texts = texts.where(f"n_tokens >= {capacity}").join(before, "part")
    order = Window.partitionBy("part").orderBy("doc_id", "place", "rest").rowsBetween(Window.unboundedPreceding, -1)
    long_texts = long_texts.withColumn("first", F.col("full_parts") + F.coalesce(F.sum(full).over(order), F.lit(0)))
    full_rows = long_texts.select("doc_id", F.posexplode(F.sequence(F.lit(0).cast("long"), full - 1)).alias("piece", "k"), "first").select("doc_id", "piece", (F.col("k") * capacity).alias("token_start"), F.lit(capacity).alias("n_tokens"), (F.col("first") + F.col("k")).alias("container_id"), F.lit(0).alias("container_start"), F.lit(capacity).alias("window"))
    groups = max(1, -(-total // step_containers))
    tier = F.lit(tiers[0])
    for t in tiers[1:]:
        tier = F.when(F.col("n_tokens") <= t, F.lit(t)).otherwise(tier)
    return rest_rows.unionByName(full_rows).withColumn("tier", tier).withColumn("step_group", F.pmod("container_id", F.lit(groups)))


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens, share of the capacity used, containers over capacity, and by how many containers, by
    what attention cost and by what share of tokens the step groups differ."""
    per = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.sum(F.pow(F.col("n_tokens").cast("double"), 2)).alias("cost"), F.max("step_group").alias("step_group"))
    steps = per.groupBy("step_group").agg(F.count("*").alias("n"), F.sum("used").alias("used"), F.sum("cost").alias("cost"), F.sum((F.col("used") > capacity).cast("int")).alias("over"))
    return steps.agg(
        F.sum("n").alias("containers"), F.sum("used").alias("tokens"), F.round(F.sum("used") / (F.sum("n") * capacity), 6).alias("fill"), F.sum("over").alias("over_capacity"), (F.max("n") - F.min("n")).alias("count_spread"),
        (F.max("cost") - F.min("cost")).alias("cost_spread"), F.round(F.max("used") / F.avg("used"), 4).alias("heaviest_step"),
    )


def invariants(docs: DataFrame, capacity: int = 2048, **options) -> DataFrame:
    """One row of what must hold of a packing: texts, and how many break each rule.

    (texts, lost_texts, lost_tokens, split_short, over_capacity, overlapping, uneven_steps): lost tokens are those of a
    recount that no piece has; ``uneven_steps`` counts a spread of more than a container, in number or in cost.
    """
    packed = Cuts(docs.sparkSession, "packed").cut(pack(docs, capacity, **options))
    recount = sized(docs, capacity, options.get("tokenizer", TOKENIZER)).agg(F.count("*").alias("texts"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"))
    pieces = packed.agg(F.coalesce(F.sum((F.col("piece") == 0).cast("long")), F.lit(0)).alias("first_pieces"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("packed"), F.coalesce(F.sum(((F.col("piece") > 0) & (F.col("token_start") < capacity)).cast("long")), F.lit(0)).alias("split_short"))
    follow = F.lead("container_start").over(Window.partitionBy("container_id").orderBy("container_start"))  # a container holds at most its capacity
    laps = packed.where("container_id is not null").withColumn("next", follow).agg(F.coalesce(F.sum((F.col("container_start") + F.col("n_tokens") > F.coalesce("next", F.lit(capacity))).cast("long")), F.lit(0)).alias("overlapping"))
    steps = fill_report(packed, capacity).select(F.coalesce("over_capacity", F.lit(0)).alias("over_capacity"), F.coalesce(((F.col("count_spread") > 1) | (F.col("cost_spread") > capacity**2)).cast("long"), F.lit(0)).alias("uneven_steps"))
    parts = recount.unionByName(pieces, True).unionByName(laps, True).unionByName(steps, True)  # a row each, summed to one
    row = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in parts.columns])
    return row.select("texts", (F.col("texts") - F.col("first_pieces")).alias("lost_texts"), (F.col("tokens") - F.col("packed")).alias("lost_tokens"), "split_short", "over_capacity", "overlapping", "uneven_steps")
