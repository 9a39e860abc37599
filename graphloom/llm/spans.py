"""Problem 10: long exact spans shared between records.

1. Each text gives content-defined anchors: of every ``length - k + 1`` successive k-grams the one
   with the least hash, so any two equal runs of ``length`` code points hold the same anchor. An
   anchor row carries hashes and offsets only, one per about ``length / 2`` code points.
2. Anchors of one document are dropped. Around the others lies a snippet: all windows of
   ``length`` that hold the anchor. Hashes only choose which snippets meet: those of one anchor.
3. The different snippets of an anchor go to one shard, each once for all its places and with its
   document, or none if several documents have it. Each shard builds an FM-index over a wavelet matrix of
   its snippets and streams them through it by backward search: the matching statistics give the runs of at
   least ``length`` that another document has, too. Every interval reported comes from there.
4. An anchor with more than ``group_cap`` different snippets would make one shard too large. The hashes of
   its snippets' windows, counted with partial aggregation, tell for each snippet which few others hold what
   it shares; it is streamed through the index of each of those, in groups of at most ``group_cap``.
5. The intervals of each document are united and measured.

Text is shuffled once for each different snippet under a shared anchor (or visit of a hot one).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.bitmap import in_bitmap
from graphloom.llm.fmindex import FMIndex
from graphloom.session import Cuts

BASE = 0x9E3779B97F4A7C15 | 1
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
PIECE = 1 << 20
ANCHORS = "h long, sh long, doc_id long, th int, pos int, e int"


class Roller:
    """Polynomial hashes mod 2^64 of any slice of an array of at most ``PIECE`` symbols."""

    powers = inverse = None

    @classmethod
    def grow(cls, n: int) -> None:
        if cls.powers is None or len(cls.powers) < n:
            size = max(n, 1 << 16)
            cls.powers, cls.inverse = (np.cumprod(np.append(np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))) for b in (BASE, pow(BASE, -1, 1 << 64)))

    def __init__(self, x: np.ndarray):
        self.grow(len(x) + 1)
        y = (x.astype(np.uint64) + np.uint64(1)) * M1
        y ^= y >> np.uint64(29)
        y *= self.powers[: len(x)]
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(y, out=self.sums[1:])

    def slices(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return self.mixed((self.sums[e] - self.sums[s]) * self.inverse[s])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return self.mixed((self.sums[k:] - self.sums[:n]) * self.inverse[:n])

    @staticmethod
    def mixed(g: np.ndarray) -> np.ndarray:
        g ^= g >> np.uint64(32)
        g *= M2
        g ^= g >> np.uint64(29)
        return g


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` successive values, by block prefix and suffix minima."""
    n = len(x)
    pad = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    pad[:n] = x
    rows = pad.reshape(-1, w)
    prefix = np.minimum.accumulate(rows, 1).ravel()
    suffix = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(suffix[: n - w + 1], prefix[w - 1 : n])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def anchor_rows(texts: list[np.ndarray], length: int, k: int) -> tuple[np.ndarray, ...]:
    """Arrays (text number, h, sh, s, e, anchor's place in [s, e)) of the anchors of the texts, each at least ``length`` long."""
    low = np.uint64(PIECE - 1)
    size = np.array([len(t) for t in texts])
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    flat = np.concatenate(texts)
    roll = Roller(flat)
    g = roll.grams(k)
    least = sliding_min((g & ~low) | np.arange(len(g), dtype=np.uint64), length - k + 1)
    valid = np.zeros(len(least), bool)
    for s, n in zip(start, size):
        valid[s : s + n - length + 1] = True
    p = np.unique((least[valid] & low).astype(np.int64))
    d = np.searchsorted(start, p, "right") - 1
    s, e = np.maximum(start[d], p + k - length), np.minimum(start[d] + size[d], p + length)
    sh = roll.slices(s, e) ^ ((e - s).astype(np.uint64) * M1)
    return d, g[p], sh, s - start[d], e - start[d], p - s


def _scan(length: int, k: int):
    names = [f.split()[0] for f in ANCHORS.split(", ")]

    def chunk(ids: list, ths: list, offsets: list, texts: list) -> pa.RecordBatch:
        d, h, sh, s, e, p = anchor_rows(texts, length, k)
        off = np.array(offsets)[d]
        cols = [h.view(np.int64), sh.view(np.int64), np.array(ids)[d], np.array(ths, np.int32)[d], (s + p + off).astype(np.int32), (e + off).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ths, offsets, texts, total = [], [], [], [], 0
        for batch in batches:
            for doc, th, text in zip(*(batch.column(c) for c in range(3))):
                x = code_points(text.as_py())
                # a text longer than a piece is taken in pieces that overlap by a snippet and a window
                for at in range(0, max(1, len(x) - length + 1), PIECE // 2):
                    part = x[max(0, at - 2 * length) : at + PIECE // 2 + 3 * length]
                    if total + len(part) > PIECE // 2 and texts:
                        yield chunk(ids, ths, offsets, texts)
                        ids, ths, offsets, texts, total = [], [], [], [], 0
                    ids.append(doc.as_py()), ths.append(th.as_py()), offsets.append(max(0, at - 2 * length)), texts.append(part)
                    total += len(part)
        if texts:
            yield chunk(ids, ths, offsets, texts)

    return scan


INTERVALS = "h long, sh long, p int, a int, b int"


def _search(length: int, k: int, shard_chars: int):
    """Rows (group, h, sh, p, doc_id, single, snippet), by group, to the intervals of each snippet found under another document."""
    names = [f.split()[0] for f in INTERVALS.split(", ")]

    def shard(rows: list[tuple]) -> pa.RecordBatch:
        number: dict[int, int] = {}
        index = FMIndex([code_points(r[6]) for r in rows], [number.setdefault(r[4], len(number)) if r[5] else -1 for r in rows])
        found = index.shared(length, np.array([r[3] for r in rows]), k)
        cols = [*([rows[t][c] for t, _, _ in found] for c in (1, 2, 3)), [a for _, a, _ in found], [b for _, _, b in found]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()])], names=names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = [], 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if total > shard_chars and r[0] != rows[-1][0]:
                    yield shard(rows)
                    rows, total = [], 0
                rows.append(r)
                total += len(r[6])
        if rows:
            yield shard(rows)

    return search


def _windows(length: int):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, sh, p, doc, single, text in zip(*(c.to_pylist() for c in batch.columns)):
                x = code_points(text)
                n = len(x) - length + 1
                if n > 0:
                    at = np.arange(n)
                    wh = Roller(x).slices(at, at + length).view(np.int64)
                    cols = [np.full(n, h), np.full(n, sh), np.full(n, p, np.int32), wh, np.full(n, doc), np.full(n, single)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h", "sh", "p", "wh", "doc_id", "single"])

    return windows


SNIPPET = ["h", "sh", "p"]


def _visits(hot: DataFrame, length: int, group_cap: int) -> DataFrame:
    """(group, *SNIPPET): each snippet of a hot anchor with the snippets that hold its windows under another document.

    Per window the snippet of the least document stands for it, or that of the greatest for the least document itself: few
    snippets, since they are the same ones for windows of one passage. What visits one of them is salted.
    """
    rows = hot.select(*SNIPPET, "doc_id", "single", "snippet").mapInArrow(_windows(length), "h long, sh long, p int, wh long, doc_id long, single boolean")
    who = F.struct("doc_id", "sh", "p")
    common = rows.groupBy("h", "wh").agg(F.min(who).alias("lo"), F.max(who).alias("hi"), F.min(F.when(~F.col("single"), who)).alias("many")).where("lo.doc_id < hi.doc_id or many is not null")
    other = F.when(F.col("many").isNotNull(), F.col("many")).when(F.col("lo.doc_id") != F.col("doc_id"), F.col("lo")).otherwise(F.col("hi"))
    pairs = rows.join(common, ["h", "wh"]).select(*SNIPPET, other.alias("to")).distinct()
    sizes = pairs.groupBy("h", "to").agg(F.count("*").alias("visitors"))
    salts = F.ceil(F.col("visitors") / group_cap).cast("int")
    group = lambda salt: F.xxhash64("h", "to.sh", "to.p", salt)
    visitors = pairs.join(sizes.where(F.col("visitors") > group_cap), ["h", "to"], "left").select(group(F.coalesce(F.pmod(F.xxhash64("sh", "p"), salts), F.lit(0).cast("long"))).alias("group"), *SNIPPET)
    hosts = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).select(group(F.col("salt").cast("long")).alias("group"), "h", F.col("to.sh").alias("sh"), F.col("to.p").alias("p"))
    return visitors.unionByName(hosts).distinct()


def shared_intervals(docs: DataFrame, length: int = 240, k: int = 96, group_cap: int = 4000, shard_chars: int = 1_000_000) -> DataFrame:
    """Intervals (doc_id, th, s, e) that cover the runs of ``length`` code points found under another doc_id.

    ``th`` is the hash of the text, for a doc_id that has several. Null texts and texts shorter than
    ``length`` share nothing; repeated rows of one doc_id are one document; other columns are ignored.
    """
    if not 0 < k <= length:
        raise ValueError("k must be between 1 and length")
    cuts = Cuts(docs.sparkSession, "spans")
    docs = docs.where((F.length("text") >= length) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.hash("text").alias("th"), "text")
    anchors = cuts.cut(docs.mapInArrow(_scan(length, k), ANCHORS))
    several = anchors.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h")
    near_end = F.greatest(F.lit(0), F.col("pos") + k - length)
    places = cuts.cut(anchors.join(several, "h").select("h", "sh", "doc_id", "th", near_end.alias("s"), "e", (F.col("pos") - near_end).alias("p")))
    cuts.drop(anchors)
    # a snippet once for all its places; it is of no document if several have it
    per = places.groupBy(*SNIPPET).agg(F.min(F.struct("doc_id", "th", "s", "e")).alias("r"), F.max("doc_id").alias("hi"))
    per = cuts.cut(per.select(*SNIPPET, "r.*", (F.col("r.doc_id") == F.col("hi")).alias("single")))
    texts = in_bitmap(docs, per, "doc_id", "th")
    snippet = F.expr("substring(text, s + 1, e - s)").alias("snippet")
    todo = cuts.cut(per.join(texts, ["doc_id", "th"]).select(*SNIPPET, "doc_id", "single", snippet).dropDuplicates(SNIPPET))
    chars, hot_anchors = todo.agg(F.coalesce(F.sum(F.length("snippet")), F.lit(0))).first()[0], cuts.cut(todo.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > group_cap).select("h"))
    shards = max(1, -(-chars // shard_chars))
    rows = todo.withColumn("group", F.col("h"))
    if not hot_anchors.isEmpty():
        hot = todo.join(hot_anchors, "h", "left_semi")
        visits = _visits(hot, length, group_cap).join(hot, SNIPPET)
        rows = todo.join(hot_anchors, "h", "left_anti").withColumn("group", F.col("h")).unionByName(visits)
    near = rows.select("group", *SNIPPET, "doc_id", "single", "snippet").repartition(shards, "group").sortWithinPartitions("group", "sh", "p").mapInArrow(_search(length, k, 2 * shard_chars), INTERVALS)
    # what is found holds for every place of a snippet
    return places.select(*SNIPPET, "doc_id", "th", "s").join(near, SNIPPET).select("doc_id", "th", (F.col("s") + F.col("a")).alias("s"), (F.col("s") + F.col("b")).alias("e"))


def shared_chars(docs: DataFrame, length: int = 240, **options) -> DataFrame:
    """(doc_id, shared_chars) of the documents with shared runs; of several texts under one id, the largest count."""
    w = Window.partitionBy("doc_id", "th").orderBy("s", "e")
    reach = F.coalesce(F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), reach))
    per = shared_intervals(docs, length, **options).distinct().withColumn("new", new).groupBy("doc_id", "th").agg(F.sum("new").alias("shared_chars"))
    return per.groupBy("doc_id").agg(F.max("shared_chars").cast("long").alias("shared_chars")).where("shared_chars > 0")
