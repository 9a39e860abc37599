"""Problem 2: most similar vectors for every vector, by multi-index hashing.

1. Codes: rotations are learned on a bounded sample (``sample`` vectors): each starts from a random
   orthogonal matrix and is refined by iterative quantisation (binary targets and an orthogonal
   Procrustes step in turn). A vector's code is the signs of its rotated coordinates.
2. The code is split into ``m`` substrings of ``s`` bits, each an index of its own. By the pigeonhole
   principle two codes that differ in fewer than ``m`` bits agree in a whole substring, so probing every
   index retrieves all codes within that radius; ``s`` grows with the logarithm of the collection so that
   a bucket holds some ``bucket`` vectors, and ``m`` is set so that a pair at the similarity bound is
   missed with probability ``miss`` at most.
3. A bucket is all vectors of one substring value. Its members are compared by their floats, blocks of
   ``block`` queries against blocks of ``block`` members: a bucket of a third of all rows is many small
   tasks' work. Each task keeps ``k`` per query over all its buckets; those lists are merged.
4. The kept pairs have their similarity in double precision, rounded; ties go to the smaller id. Ids are
   numbered in their order first, so that all of this is done with numbers; exact copies of a vector are
   searched once and stand for each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.sampling import hash_sample
from graphloom.operators.series import numbered
from graphloom.session import Cuts


def learn_rotations(x: np.ndarray, bits: int, rounds: int = 15, seed: int = 5) -> np.ndarray:
    """Columns of as many learned rotations as give ``bits`` sign bits. ``x``: sample of unit vectors."""
    rng, d, out = np.random.default_rng(seed), x.shape[1], []
    while sum(r.shape[1] for r in out) < bits:
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        part = x[rng.permutation(len(x))[: max(d, len(x) // 2)]]
        for _ in range(rounds if len(part) > d else 0):
            u, _, vt = np.linalg.svd(part.T @ np.sign(part @ r))
            r = u @ vt
        out.append(r)
    return np.concatenate(out, 1)[:, :bits]


def tables_needed(s: int, similarity: float, miss: float) -> int:
    agree = (1 - math.acos(similarity) / math.pi) ** s
    return math.ceil(math.log(miss) / math.log(1 - agree))


def usable(vectors: DataFrame, id: str, vector: str, dim: int) -> DataFrame:
    """One (id, v) per id with ``dim`` finite numbers, not all zero."""
    v = F.col(vector).cast("array<float>")
    ok = F.col(id).isNotNull() & (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(ok).select(F.col(id).alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


SPREAD = "key long, lo int, hi int, side byte, n long, v array<float>"


def _keys(v: pa.Array, rotation: np.ndarray, s: int, m: int) -> np.ndarray:
    """A row per vector and a column per index: the substring's value and the index's number."""
    x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    return ((x @ rotation > 0).reshape(len(x), m, s) * (1 << np.arange(s)).astype(np.int64)).sum(2) * m + np.arange(m)


def _codes(rotation: np.ndarray, s: int, m: int):
    """(substring and index, number, vector) rows of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                key = _keys(batch.column(1), rotation, s, m)
                for j in range(m):
                    yield pa.RecordBatch.from_arrays([pa.array(key[:, j]), *batch.columns], names=["key", "n", "v"])

    return run


def best_of(q: np.ndarray, n: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best distinct neighbours of each query: by similarity, ties to the smaller number."""
    o = np.lexsort((n, -s, q))
    q, n, s = q[o], n[o], s[o]
    # the same pair from several buckets has the same similarity, so its repeats are next to each other
    keep = np.ones(len(q), bool)
    keep[1:] = (q[1:] != q[:-1]) | (n[1:] != n[:-1])
    q, n, s = q[keep], n[keep], s[keep]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.empty(0, np.int64)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return q[place < k], n[place < k], s[place < k]


def _compare(k: int, bound: float):
    def against(x: np.ndarray, xn: np.ndarray, y: np.ndarray, yn: np.ndarray, same: bool) -> Iterator[tuple]:
        for at in range(0, len(x), 512):
            part = x[at : at + 512]
            # single precision finds what may count, at 4 bytes a pair; double decides
            sim = part.astype(np.float32) @ y.T.astype(np.float32)
            if same:
                sim[np.arange(len(part)), np.arange(at, at + len(part))] = -2
            hit = sim >= np.float32(bound - 1e-5)
            many = np.flatnonzero(np.count_nonzero(hit, axis=1) > 4 * k)
            if len(many):  # of those only what may be among the best, ties included
                few = sim[many]
                hit[many] &= few >= (np.partition(few, few.shape[1] - k, axis=1)[:, few.shape[1] - k] - np.float32(1e-5))[:, None]
            r, c = np.nonzero(hit)
            if len(r):
                for cut in range(0, len(r), 200_000):
                    i, j = r[cut : cut + 200_000], c[cut : cut + 200_000]
                    yield best_of(xn[at + i], yn[j], np.round(np.einsum("ij,ij->i", part[i], y[j]), 9), k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[pa.RecordBatch] = []
        last = None

        def flush() -> None:
            t = pa.Table.from_batches(held)
            n, side = t.column("n").to_numpy(), t.column("side").to_numpy()
            v = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(n), -1).astype(np.float64)
            v /= np.linalg.norm(v, axis=1)[:, None]
            cell = [t.column(c).to_numpy() for c in ("key", "lo", "hi")]
            edges = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in cell], axis=0)))
            for s, e in zip(edges, np.append(edges[1:], len(n))):
                if e - s < 2:
                    continue
                if side[s] == 2:
                    out.extend(against(v[s:e], n[s:e], v[s:e], n[s:e], True))
                else:
                    a, b = s + np.flatnonzero(side[s:e] == 0), s + np.flatnonzero(side[s:e] == 1)
                    if len(a) and len(b):
                        out.extend(against(v[a], n[a], v[b], n[b], False))
                        out.extend(against(v[b], n[b], v[a], n[a], False))
            held.clear()

        def rows() -> Iterator[pa.RecordBatch]:
            if out:
                q, n, s = best_of(*(np.concatenate(c) for c in zip(*out)), k)
                out.clear()
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(n), pa.array(s)], names=["q", "n", "similarity"])

        for batch in batches:
            # a bucket is never cut: what follows the last bucket's start waits for the next batch
            cell = [c.to_numpy() for c in batch.columns[:3]]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cell], axis=0)) + 1
            if last is not None and tuple(c[0] for c in cell) != last:
                new = np.concatenate([[0], new])
            if len(new):
                cut = int(new[-1])
                held.append(batch.slice(0, cut)), flush()
                batch = batch.slice(cut)
            held.append(batch)
            last = tuple(c[-1] for c in cell)
            if sum(len(x[0]) for x in out) > 2_000_000:
                yield from rows()
        if held:
            flush()
        yield from rows()

    return run


def nearest(vectors: DataFrame, id: str = "id", vector: str = "embedding", dim: int = 64, k: int = 5, similarity: float = 0.8, miss: float = 0.005, sample: int = 20_000, bucket: int = 4096, block: int = 8192) -> DataFrame:
    """(id, neighbour_id, similarity): the at most ``k`` other ids of cosine similarity ``similarity`` and more.

    Vectors that are null, of another length, all zero or hold NaN take no part; of several vectors of an id the
    least is taken; an empty table gives no row; other columns are ignored.
    """
    spark = vectors.sparkSession
    cuts = Cuts(spark, "neighbours")
    own = cuts.cut(numbered(usable(vectors, id, vector, dim).select(F.col("id").cast("string"), "v"), "id", name="n"))
    # exact copies: the least ``k`` + 1 numbers of a vector are all its copies can need of each other
    rank = F.row_number().over(Window.partitionBy("v").orderBy("n"))
    few = own.withColumn("at", rank).where(F.col("at") <= k + 1).groupBy("v").agg(F.min("n").alias("n"), F.array_sort(F.collect_list("n")).alias("copies"))
    heads = cuts.cut(few)
    total = heads.count()
    s = max(2, round(math.log2(max(total, 2) / bucket)))
    m = tables_needed(s, similarity, miss)
    rows = hash_sample(heads.select("n", "v"), total, sample, "n")
    x = np.array([r["v"] for r in rows], np.float64).reshape(len(rows), dim)
    x /= np.linalg.norm(x, axis=1)[:, None] if len(x) else 1
    rotation = learn_rotations(x, s * m) if len(x) else np.zeros((dim, s * m))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, c = np.unique(_keys(batch.column(0), rotation, s, m), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(c)], names=["key", "rows"])

    large = cuts.cut(heads.select("v").mapInArrow(count, "key long, rows long").groupBy("key").agg(F.sum("rows").alias("rows")).where(F.col("rows") > block))
    spread = heads.select("n", "v").mapInArrow(_codes(rotation, s, m), "key long, n long, v array<float>")
    # a bucket beyond ``block`` is cells of pairs of blocks: a vector is a query in the row and a member in the column of its block
    blocks = F.coalesce(F.ceil(F.col("rows") / block).cast("int"), F.lit(1))
    if large.isEmpty():
        spread = spread.select("key", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(2).cast("byte").alias("side"), "n", "v")
    else:
        cells = spread.join(large, "key", "left").withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("n"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") > F.col("other"), 1).otherwise(0).cast("byte")
        spread = cells.select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), side.alias("side"), "n", "v")
    parts = max(spark.sparkContext.defaultParallelism * 2, total * m // 100_000)
    lists = spread.repartition(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_compare(k, similarity), "q long, n long, similarity double").where(F.col("similarity") >= similarity)
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "n"))
    ranked = cuts.cut(lists.distinct().withColumn("rank", best).where(F.col("rank") <= k).drop("rank"))
    repeated = cuts.cut(heads.where(F.size("copies") > 1).select("n", "copies"))
    if not repeated.isEmpty():
        ranked = _with_copies(own, heads, repeated, ranked, k)
    names = own.select("n", "id")
    out = ranked.join(names.withColumnRenamed("id", "neighbour_id"), "n").drop("n")
    return out.join(names.withColumnsRenamed({"n": "q"}), "q").select("id", "neighbour_id", "similarity")


def _with_copies(own: DataFrame, heads: DataFrame, repeated: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """Neighbours of every number from those of one per distinct vector: copies of each other first or by their number."""
    # every number with the one that stands for its vector
    of = own.join(heads.where(F.size("copies") > 1).select("v", F.col("n").alias("head"), "copies"), "v", "left").select("n", F.coalesce("head", "n").alias("head"), "copies")
    beside = of.where("copies is not null").select(F.col("n").alias("q"), F.explode("copies").alias("n"), F.lit(1.0).alias("similarity")).where("q <> n")
    each = ranked.join(repeated.select("n", "copies"), "n", "left").select("q", F.explode(F.coalesce("copies", F.array("n"))).alias("n"), "similarity")
    others = each.withColumnRenamed("q", "head").join(of.select(F.col("n").alias("q"), "head"), "head").select("q", "n", "similarity")
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "n"))
    return beside.unionByName(others).withColumn("rank", best).where(F.col("rank") <= k).drop("rank")
