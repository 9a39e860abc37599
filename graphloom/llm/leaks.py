"""Problem 9: evaluation texts leaking into training text.

Spaced seeds: a fixed mask keeps some positions of a word window and ignores the rest, so a
substituted word at an ignored position doesn't break the match. Masked windows of the test
fields are hashed into a sorted array; each document is streamed once, its masked windows are
probed against that array, and the overlap around every hit is verified word by word along
its diagonal (document position minus test position), allowing substitutions. The seeds are short
enough to miss no overlap of ``min_words`` words, so chance hits are many: those with too few equal
words on their diagonal are dropped all at once before the rest is verified.

The test set is the small side. Its size is counted first; beyond ``block_words`` words it is
taken in blocks by item id, each scanned against all documents, so neither the driver nor a
task ever holds more than one block. Nothing of the documents is shuffled but the hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
#: Positions that count in a window. Together the two hit every overlap of ten words and more of which up to two single words
#: inside are substituted, whichever they are (``tests/llm`` tries them all).
MASKS = ("1101011", "110111")
FIELDS = ("question", "gold_answer", "context")
SCHEMA = "doc_id long, item_id long, field string, doc_start int, n_words int, n_substituted int, exact_run int"
MULT = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Longest runs of letters and digits, case ignored."""
    return WORD.findall(text.lower()) if text else []


def _coefficients(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)


def seed_hashes(ids: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``ids`` under the mask, and whether all counted words are known (not 0)."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, bool)
    out, known, coef, x = np.zeros(n, np.uint64), np.ones(n, bool), _coefficients(len(mask)), ids.astype(np.uint64)
    for o, bit in enumerate(mask):
        if bit == "1":
            part = x[o : o + n]
            out += (part * MULT ^ (part << np.uint64(17))) * coef[o]
            known &= part != 0
    out ^= out >> np.uint64(31)
    return out, known


class TestIndex:
    """The masked windows of a block of test items, in sorted hash arrays."""

    __test__ = False

    def __init__(self, items: list[tuple], masks: tuple[str, ...] = MASKS):
        self.masks, self.vocab, self.texts, self.keys = masks, {}, [], []
        for item_id, *fields in items:
            for name, text in zip(FIELDS, fields):
                w = words(text)
                if len(w) >= min(map(len, masks)):
                    ids = np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w], np.int64)
                    self.texts.append(ids)
                    self.keys.append((item_id, name))
        self.start = np.cumsum([0, *map(len, self.texts)])
        self.flat = np.concatenate(self.texts) if self.texts else np.empty(0, np.int64)
        self.tables = []
        for m in masks:
            parts = [(seed_hashes(t, m)[0], k) for k, t in enumerate(self.texts)]
            h = np.concatenate([p for p, _ in parts] or [np.empty(0, np.uint64)])
            t = np.concatenate([np.full(len(p), k, np.int32) for p, k in parts] or [np.empty(0, np.int32)])
            pos = np.concatenate([np.arange(len(p), dtype=np.int32) for p, _ in parts] or [np.empty(0, np.int32)])
            o = np.argsort(h, kind="stable")
            self.tables.append((h[o], t[o], pos[o]))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of all texts in one array, 0 for words no test text has and, as a gap, between texts; text starts."""
        get, gap = self.vocab.get, [0] * max(map(len, self.masks))
        flat: list[int] = []
        starts = []
        for t in texts:
            starts.append(len(flat))
            if t:
                flat += [get(w, 0) for w in WORD.findall(t.lower())]
            flat += gap
        return np.array(flat, np.int64), np.array(starts, np.int64)

    def hits(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Distinct (test text, document, diagonal in ``flat``) of all seed hits."""
        found = []
        for mask, (h, t, pos) in zip(self.masks, self.tables):
            x, known = seed_hashes(flat, mask)
            at = np.flatnonzero(known)
            if not len(at) or not len(h):
                continue
            lo = np.searchsorted(h, x[at], "left")
            n = np.searchsorted(h, x[at], "right") - lo
            hit = n > 0
            at, lo, n = at[hit], lo[hit], n[hit]
            k = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            # the first word that counts lies in a document, and so do the others: a gap is as long as a mask
            doc = np.searchsorted(starts, at + mask.index("1"), "right") - 1
            found.append(np.stack([t[k].astype(np.int64), np.repeat(doc, n), np.repeat(at, n) - pos[k]], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), np.int64)


def _runs(same: np.ndarray, max_substituted: int) -> tuple[int, int, int, int]:
    """Longest exact run, and start, length and substitutions of the longest stretch whose inner
    mismatches are single words, at most ``max_substituted`` of them, each between two matches."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return 0, 0, 0, 0
    best = (0, 0, 0)
    i = 0
    for j in range(len(starts)):
        if j and starts[j] - ends[j - 1] > 1:
            i = j
        i = max(i, j - max_substituted)
        if ends[j] - starts[i] > best[1]:
            best = (int(starts[i]), int(ends[j] - starts[i]), j - i)
    return int((ends - starts).max()), *best


def overlaps(index: TestIndex, flat: np.ndarray, hits: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int) -> np.ndarray:
    """Which hits have at least ``least`` equal words on their diagonal within [lo, hi)."""
    keep = np.zeros(len(hits), bool)
    size = hi - lo
    for at in np.split(np.arange(len(hits)), np.flatnonzero(np.diff(np.cumsum(size) // 1_000_000)) + 1):
        n = size[at]
        if len(at) and n.sum():
            place = np.repeat(lo[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            same = flat[place] == index.flat[place + np.repeat(index.start[hits[at, 0]] - hits[at, 2], n)]
            keep[at] = np.add.reduceat(same.astype(np.int64), np.cumsum(n) - n) >= least
    return keep


def scan_texts(index: TestIndex, doc_ids: list, texts: list, min_words: int, max_substituted: int) -> list[tuple]:
    flat, starts = index.encode(texts)
    rows = []
    last = np.append(starts[1:], len(flat))
    hits = index.hits(flat, starts)
    # the diagonal may run over the document's edge: the gap's zeros never equal a test word
    lo, hi = np.maximum(hits[:, 2], starts[hits[:, 1]]), np.minimum(hits[:, 2] + np.diff(index.start)[hits[:, 0]], last[hits[:, 1]])
    room = hi - lo >= min_words
    hits, lo, hi = hits[room], lo[room], hi[room]
    keep = overlaps(index, flat, hits, lo, hi, min_words - max_substituted)
    for (t, d, diagonal), a, b in zip(hits[keep].tolist(), lo[keep].tolist(), hi[keep].tolist()):
        exact, s, n, sub = _runs(flat[a:b] == index.texts[t][a - diagonal : b - diagonal], max_substituted)
        if n >= min_words:
            rows.append((doc_ids[d], *index.keys[t], int(a - starts[d]) + s, n, sub, exact))
    return rows


def find_leaks(docs: DataFrame, items: DataFrame, min_words: int = 10, max_substituted: int = 2, masks: tuple[str, ...] = MASKS, block_words: int = 2_000_000) -> DataFrame:
    """Overlaps of at least ``min_words`` words between ``docs(doc_id, text)`` and the fields of ``items``.

    One row per document, test field and diagonal: where the overlap starts (in words), its length,
    its substituted words and its longest exact run. Null and empty texts, and fields shorter than a
    mask, give no row; repeated document rows give repeated rows; columns beyond those named are ignored.
    """
    if min_words < max(map(len, masks)):
        raise ValueError("a mask is longer than the shortest overlap")
    spark = docs.sparkSession
    items = items.select("item_id", *FIELDS).where("item_id is not null")
    size = F.sum(sum((F.size(F.split(F.coalesce(F.col(c), F.lit("")), r"\s+")) for c in FIELDS), F.lit(0)))
    blocks = max(1, -(-(items.agg(size.alias("n")).first()["n"] or 0) // block_words))
    out = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id").collect()
        shared = spark.sparkContext.broadcast(TestIndex([tuple(r) for r in part], masks))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    x = batch.slice(at, 1000)
                    rows = scan_texts(shared.value, x.column(0).to_pylist(), x.column(1).to_pylist(), min_words, max_substituted)
                    if rows:
                        cols = list(zip(*rows))
                        types = [pa.int64(), pa.int64(), pa.string(), *[pa.int32()] * 4]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[f.split()[0] for f in SCHEMA.split(", ")])

        found = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def leaked_items(docs: DataFrame, items: DataFrame, min_words: int = 10, max_substituted: int = 0) -> DataFrame:
    """Distinct (doc_id, item_id) with an overlap of at least ``min_words`` words, up to ``max_substituted`` of them substituted."""
    return find_leaks(docs, items, min_words, max_substituted).select("doc_id", "item_id").distinct()
