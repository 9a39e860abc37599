"""Problem 5: duplicates hidden by formatting differences.

The bytes of a whole column batch pass once through a 256-entry skip-and-fold table (0: skip, else
the folded byte) into rolling polynomial hashes mod 2^64, two bases at a time. Prefix sums give the
hash of any slice, so no canonical string is built. The keys and values of a JSON object are hashed
one by one and added up, so their order doesn't count. Rows of equal hashes are then compared with
the group's first row by two pointers that skip the same bytes; a row that differs (a collision) is
grouped by its own folded text instead.

Only hash pairs and row numbers are shuffled for the counting, with partial aggregation. Raw rows are
read a second time for groups of two and more only, picked by a bitmap of fixed size before anything is
shuffled, and a hot group's rows are salted.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.bitmap import in_bitmap
from graphloom.session import Cuts

BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
FIELDS = ("source", "target", "predicate", "name", "custom")
MASK = (1 << 64) - 1
QUOTE = ord('"')

TABLE = np.zeros(256, np.uint64)
for _c in range(128):
    if chr(_c).isalnum():
        TABLE[_c] = ord(chr(_c).lower()) + 1
DOT, MINUS = ord(".") + 1, ord("-") + 1
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
#: What the byte table can take: ASCII, and the two- and three-byte spaces and punctuation that it skips.
PLAIN = re.compile(r"[\x00-\x7f\u00a0\u00ab\u00bb\u2000-\u206f\u3000\ufeff]*")


def fold(text: str) -> str:
    """The folded text that the hashes stand for; built only where the table doesn't reach and for collisions."""
    return "".join(folded_characters(text))


def fold_id(text: str | None) -> str:
    return (text or "").strip().casefold()


def parse(custom: str | None) -> list[tuple[str, str]] | None:
    try:
        x = json.loads(custom, object_pairs_hook=list) if custom else []
    except ValueError:
        return None
    return [(str(k), v if isinstance(v, str) else json.dumps(v)) for k, v in x] if isinstance(x, list) and all(isinstance(p, tuple) for p in x) else None


def canonical(row: tuple) -> tuple:
    """The folded form of (source, target, predicate, name, custom)."""
    source, target, predicate, name, custom = row
    pairs = parse(custom)
    body = (fold(custom or ""),) if pairs is None else tuple(sorted((fold(k), fold(v)) for k, v in pairs))
    return fold_id(source), fold_id(target), fold(predicate or ""), fold(name or ""), body


def _mix(h: int) -> int:
    h ^= h >> 29
    h = h * 0xBF58476D1CE4E5B9 & MASK
    return h ^ h >> 32


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def text_hash(folded: str, base: int) -> int:
    h, p = 0, 1
    for b in folded.encode():
        h, p = h + (b + 1) * p & MASK, p * base & MASK
    return _mix(h)


def pairs_hash(pairs: list[tuple[str, str]], base: int) -> int:
    return sum(_mix(text_hash(fold(k), base) * 3 + text_hash(fold(v), base) & MASK) for k, v in pairs) & MASK


class Folded:
    """A column's bytes after the table, with the rolling hashes of both bases."""

    powers: list[np.ndarray] = []
    inverse: list[np.ndarray] = []

    def __init__(self, texts: list[str], ids: bool = False):
        raw = [t.encode() for t in texts]
        size = np.array([len(r) for r in raw], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(size)])[:-1]
        self.ends = self.starts + size
        self.bytes = b = np.frombuffer(b"".join(raw) or b"\0", np.uint8)
        if ids:
            lower = np.where((b >= 65) & (b <= 90), b + 32, b)
            y = lower.astype(np.uint64) + np.uint64(1)
        else:
            y = TABLE[b]
            digit = DIGIT[b]
            first, last = np.zeros(len(b), bool), np.zeros(len(b), bool)
            first[self.starts[size > 0]] = True
            last[self.ends[size > 0] - 1] = True
            after = np.append(digit[1:], False) & ~last
            before = np.append(False, digit[:-1]) & ~first
            y[(b == ord(".")) & before & after] = DOT
            y[(b == ord("-")) & after] = MINUS
        kept = y != 0
        self.rank = np.concatenate([[0], np.cumsum(kept)])
        n = int(self.rank[-1]) + 1
        if not self.powers or len(self.powers[0]) < n:
            Folded.powers, Folded.inverse = ([np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, v, np.uint64))) for v in vs] for vs in (BASES, [pow(v, -1, 1 << 64) for v in BASES]))
        self.sums = []
        for p in self.powers:
            s = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(np.where(kept, y * p[self.rank[:-1]], np.uint64(0)), out=s[1:])
            self.sums.append(s)

    def hashes(self, s: np.ndarray, e: np.ndarray, which: int) -> np.ndarray:
        return _mixed((self.sums[which][e] - self.sums[which][s]) * self.inverse[which][self.rank[s]])

    def object_hashes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order-free hashes of flat JSON objects of strings, and which rows have another form."""
        q = np.flatnonzero(self.bytes == QUOTE)
        row = np.searchsorted(self.starts, q, "right") - 1
        n = np.bincount(row, minlength=len(self.starts))
        odd = (n % 4 != 0) | (n == 0)
        q = q[~odd[row]]
        row = row[~odd[row]][::4]
        ks, ke, vs, ve = q[::4], q[1::4], q[2::4], q[3::4]
        out = []
        for w in range(2):
            pair = _mixed(self.hashes(ks + 1, ke, w) * np.uint64(3) + self.hashes(vs + 1, ve, w))
            sums = np.zeros(len(self.starts), np.uint64)
            np.add.at(sums, row, pair)
            out.append(sums)
        # bytes outside the strings must be those of a flat object of strings
        outside = np.bincount(np.searchsorted(self.starts, np.flatnonzero(TABLE[self.bytes] != 0), "right") - 1, minlength=len(n))
        inside = np.zeros(len(self.starts), np.int64)
        alnum = np.concatenate([[0], np.cumsum(TABLE[self.bytes] != 0)])
        np.add.at(inside, row, alnum[ke] - alnum[ks] + alnum[ve] - alnum[vs])
        return out[0], out[1], odd | (inside != outside)


def row_hashes(columns: list[list[str | None]]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row of (source, target, predicate, name, custom)."""
    n = len(columns[0])
    total = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
    for at, column in enumerate(columns):
        ids, custom = at < 2, at == 4
        texts = [fold_id(t) for t in column] if ids else [t or "" for t in column]
        slow = [i for i, t in enumerate(texts) if not (t.isascii() if ids or custom else PLAIN.fullmatch(t)) or custom and "\\" in t]
        skip = set(slow)
        x = Folded(["" if i in skip else t for i, t in enumerate(texts)] if slow else texts, ids)
        if custom:
            h = list(x.object_hashes())
            slow = np.flatnonzero(h[2]).tolist()
        else:
            h = [x.hashes(x.starts, x.ends, w) for w in range(2)]
        for i in slow:
            pairs = parse(texts[i]) if custom else None
            for w in range(2):
                if pairs is not None:
                    h[w][i] = pairs_hash(pairs, BASES[w])
                else:
                    h[w][i] = text_hash(texts[i] if ids else fold(texts[i]), BASES[w])
        for w in range(2):
            total[w] = _mixed(total[w] * np.uint64(5) + h[w] + np.uint64(at + 1))
    return total[0], total[1]


def folded_characters(text: str) -> Iterator[str]:
    """The characters of ``fold(text)``, one by one."""
    for i, c in enumerate(text):
        if c.isalnum():
            yield from (x for x in c.casefold() if x.isalnum())
        elif c in "-−":
            if i + 1 < len(text) and text[i + 1].isdigit():
                yield "-"
        elif c == "." and 0 < i < len(text) - 1 and text[i - 1].isdigit() and text[i + 1].isdigit():
            yield c


def same_text(a: str, b: str) -> bool:
    """Whether two texts are equal after folding: two pointers that skip what doesn't count."""
    return all(x == y for x, y in zip_longest(folded_characters(a), folded_characters(b)))


def same_row(a: tuple, b: tuple) -> bool:
    if any(x != y and fold_id(x) != fold_id(y) for x, y in zip(a[:2], b[:2])):
        return False
    if any(x != y and not same_text(x or "", y or "") for x, y in zip(a[2:4], b[2:4])):
        return False
    if a[4] == b[4]:
        return True
    p, q = parse(a[4]), parse(b[4])
    if p is None or q is None:
        return p is None and q is None and same_text(a[4] or "", b[4] or "")
    if len(p) != len(q):
        return False
    rest = list(q)
    for k, v in p:
        at = next((i for i, (l, w) in enumerate(rest) if same_text(k, l) and same_text(v, w)), None)
        if at is None:
            return False
        rest.pop(at)
    return True


def hashed(rows: DataFrame, hash_bits: int = 64) -> DataFrame:
    """(h1, h2, edge_no). ``hash_bits`` below 64 serves tests of collisions."""
    mask = np.uint64((1 << hash_bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = row_hashes([batch.column(i).to_pylist() for i in range(1, 6)])
            cols = [pa.array((a & mask).view(np.int64)), pa.array(((b & mask) if hash_bits == 64 else b * np.uint64(0)).view(np.int64)), batch.column(0)]
            yield pa.RecordBatch.from_arrays(cols, names=["h1", "h2", "edge_no"])

    return rows.select("edge_no", *FIELDS).mapInArrow(run, "h1 long, h2 long, edge_no long")


def collapse(rows: DataFrame, salt_rows: int = 100_000, hash_bits: int = 64) -> DataFrame:
    """One row (kept_no, copy_no) for each row that equals an earlier one but for its formatting.

    ``rows`` needs edge_no and source, target, predicate, name, custom. Null and blank fields are equal;
    a custom that is no JSON object is compared as text; a repeated edge_no counts once; an empty table
    gives none; other columns are ignored.
    """
    keys, spark = ["h1", "h2"], rows.sparkSession
    cuts = Cuts(spark, "collapse")
    rows = rows.where("edge_no is not null").select(F.col("edge_no").cast("long").alias("edge_no"), *[F.col(f).cast("string").alias(f) for f in FIELDS])
    hashes = cuts.cut(hashed(rows, hash_bits))
    counts = hashes.groupBy(*keys).agg(F.min("edge_no").alias("kept_no"), F.count("*").alias("n"), F.max("edge_no").alias("last")).where("n > 1 and last > kept_no")
    # a group of n rows is spread over ceil(n / salt_rows) salts
    groups = counts.select(*keys, "kept_no", F.ceil(F.col("n") / salt_rows).cast("int").alias("salts"))
    members = cuts.cut(hashes.join(groups, keys).select("edge_no", "kept_no", "salts").distinct())
    # only rows of groups of two and more are shuffled: a bitmap of fixed size lets them through
    raw = cuts.cut(in_bitmap(rows, members, "edge_no").join(members, "edge_no"))
    # of several rows under one edge_no the least stands for it as the kept one
    kept = raw.where("edge_no = kept_no").groupBy("kept_no").agg(F.min(F.struct(*FIELDS)).alias("first"), F.max("salts").alias("salts"))
    first = kept.select("kept_no", "first", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    copies = raw.where("edge_no > kept_no").withColumn("salt", F.pmod(F.xxhash64("edge_no"), F.col("salts")).cast("int"))
    both = copies.select("salt", "kept_no", "edge_no", F.struct(*FIELDS).alias("own")).join(first, ["kept_no", "salt"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, first = (list(zip(*(batch.column(c).field(i).to_pylist() for i in range(5)))) for c in (2, 3))
            equal = [same_row(a, b) for a, b in zip(own, first)]
            key = [None if e else json.dumps(canonical(a)) for e, a in zip(equal, own)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(key, pa.string())], names=["kept_no", "copy_no", "other"])

    checked = cuts.cut(both.select("kept_no", "edge_no", "own", "first").mapInArrow(verify, "kept_no long, copy_no long, other string"))
    for df in (hashes, members, raw):
        cuts.drop(df)
    collided = checked.where("other is not null")
    regrouped = collided.groupBy("other").agg(F.min("copy_no").alias("kept_no")).join(collided.select("other", "copy_no"), "other").where("copy_no > kept_no")
    return checked.where("other is null").select("kept_no", "copy_no").unionByName(regrouped.select("kept_no", "copy_no")).distinct()
