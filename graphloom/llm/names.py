"""Problem 1: variant spellings of names typed by people.

1. Names are split into tokens, titles and legal forms dropped. How often a token occurs in the distinct
   names of its type gives its weight: a frequent token (a given name, a line of business), whose share is
   ``head_share`` or more by the lower end of its confidence interval and that ``support`` names or more
   bear, is a head; there are at most 4 / ``head_share`` of those. A rare token that abbreviates, shortens or misspells a
   head (prefix, suffix, initial letters in order, pet form, one or two typos) is as like it as can be: it
   is read as that head.
2. What is left is the rare part of the name, which decides. A prefix-filtered set-similarity join on the
   trigrams of the rare tokens, rarest first, gives candidates under the same heads; the prefix is as long as
   ``typos`` typos in each token can make it, so it loses no pair that step 3 accepts.
3. A candidate pair is verified by soft weighted similarity, token by token: each rare token takes the most
   like one of the other name, weighted by its inverse document frequency, so a rare token's mismatch, or
   a rare token that has no partner, counts more than a frequent one's. Equal rare parts have similarity 1 and are one key.
4. Matches are closed into groups; an initial stands for a full given name where only one fits.

Work is done per distinct name, so a name that a third of all rows bear is one row until the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.groups import linked_groups
from graphloom.session import Cuts

#: Titles, degrees and legal forms, which name nobody (fixed values).
DROPPED = frozenset("mr mrs ms dr prof shri smt sri kum adv ca mba cfo ceo phd director chairman jr sr the ltd limited lmtd ltd pvt private inc llp plc co company companies corp corpn corporation grp group of and india intl international".split())
VOWELS = set("aeiou")


def tokens(name: Column) -> Column:
    """Lower-case words without marks, titles and legal forms, in order."""
    t = F.regexp_replace(F.lower(name), r"\bm\s*/\s*s\b\.?", " ")
    t = F.regexp_replace(t, r"[’'`]", "")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(F.trim(t), " "), lambda x: (x != "") & ~x.isin(*sorted(DROPPED)))


def typos(a: str, b: str, most: int) -> int:
    """Edits (swapped neighbours are one) between two words, or ``most + 1`` if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], older[j - 2] + 1)
        if min(row) > most:
            return most + 1
    return row[-1]


def in_order(short: str, long: str) -> bool:
    rest = iter(long)
    return all(c in rest for c in short)


def common_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class Heads:
    """The frequent tokens of one type of name, and how rarer tokens are read as them."""

    def __init__(self, counts: dict[str, int], neighbours: dict[tuple[str, str], int], given: bool, short: list[str] = ()):
        self.neighbours, self.given = neighbours, given
        # a frequent short form of a head far more frequent is no head
        self.counts = {t: n for t, n in counts.items() if not any(m >= 4 * n and len(h) > len(t) and self._rank(t, h) is not None for h, m in counts.items())}
        counts = self.counts
        self.memo: dict[str, str | None] = {h: h for h in counts}
        # two heads that nearly always come together are one: the second says nothing more
        self.forms = {h: h for h in counts if len(h) > 3}
        self.silent = {b for (a, b), n in neighbours.items() if a in counts and b in counts and n >= 0.85 * counts[b] and n >= 0.65 * counts[a]}
        # short forms that stand for a head may also be run together with the rest of a name
        self.forms |= {t: h for t in short if len(t) > 2 and t not in counts and (h := self.read(t)) is not None}

    def read(self, t: str) -> str | None:
        if t not in self.memo:
            self.memo[t] = self._read(t)
        return self.memo[t]

    def _read(self, t: str) -> str | None:
        best: tuple | None = None
        for h, n in self.counts.items():
            if len(h) < 3 or len(t) < 2:
                continue
            if (rank := self._rank(t, h)) is not None and (best is None or (rank, -n) < best[:2]):
                best = (rank, -n, h)
        return best[2] if best else None

    def _rank(self, t: str, h: str) -> int | None:
        """How ``t`` may stand for ``h``: the lower, the surer; None if it doesn't."""
        if len(t) >= 4 and (d := typos(t, h, 2 if len(h) >= 8 else 1)) <= (2 if len(h) >= 8 else 1):
            return d
        if not self.given and len(h) > 4 and t.startswith(h):
            return 2
        if h.startswith(t):
            return 2 if len(t) > 2 else 4
        if len(t) >= 5 and h.endswith(t):
            return 3
        lead = common_prefix(t, h)
        if len(t) <= 7 and (lead >= 3 or lead == 2 and len(t) == 3) and lead >= len(t) - 3 and self.given:
            return 4
        if not self.given and lead >= 6 and lead >= len(t) - 3:
            return 4
        if not self.given and t[0] == h[0] and len(t) <= 6 and len(t) < len(h) and in_order(t, h):
            return 5
        return None

    def split(self, t: str) -> tuple[str, str] | None:
        """(head, rest) of a word run together from both, at either end."""
        best: tuple | None = None
        for f, h in self.forms.items():
            for n in (len(f), len(f) - 1, len(f) + 1) if len(f) > 4 else (len(f),):
                if len(t) - n < 5:
                    continue
                for part, rest in ((t[:n], t[n:]), (t[-n:], t[:-n])):
                    d = typos(part, f, 1)
                    if d <= (len(f) > 4) and (best is None or (d - len(f) / 2, f) < best[:2]):
                        best = (d - len(f) / 2, f, h, rest)
        return best[2:] if best else None

    def parse(self, words: list[str]) -> tuple[list[str], list[str], list[str]]:
        """(heads, initials, rare words) of a name."""
        heads, initials, rare, i = [], [], [], 0
        while i < len(words):
            t = words[i]
            if i + 1 < len(words) and len(t) > 2 and len(words[i + 1]) > 2 and not (t in self.counts and words[i + 1] in self.counts):
                joined = t + words[i + 1]
                if (h := next((h for h in self.counts if typos(joined, h, 1) <= 1), None)) is not None:
                    heads.append(h)
                    i += 2
                    continue
            if len(t) == 1:
                initials.append(t)
            elif (h := self.read(t)) is not None:
                heads.append(h)
            else:
                rare.append(t)
            i += 1
        if self.given:
            if not heads and not initials and len(rare) == 1 and (cut := self.split(rare[0])):
                heads, rare = [cut[0]], [cut[1]]
            elif len(heads) + len(rare) == 1:  # one word is the family name
                heads, rare = [], rare + heads
            heads.sort(key=lambda h: -self.counts[h])
            return heads[:1], initials, sorted(rare + heads[1:])
        for t in initials:  # a line of business by its first letter, beside the word it goes with
            fit = [(n, a) for (a, b), n in self.neighbours.items() if b in heads and a in self.counts and a.startswith(t)] + [(n, b) for (a, b), n in self.neighbours.items() if a in heads and b in self.counts and b.startswith(t)]
            if fit:
                heads.append(max(fit)[1])
        if not heads and len(rare) == 1 and (cut := self.split(rare[0])):
            heads, rare = [cut[0]], [cut[1]]
        return sorted({h for h in heads if h not in self.silent}), [], sorted(rare)


PARSED = "type string, name string, block string, given string, rare string"


def frequent(n: int, share: float, z: float = 1.28) -> int:
    """The least count out of ``n`` whose true share is ``share`` or more with confidence (lower end of Wilson's interval)."""
    def low(c: int) -> float:
        p = c / n
        return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)

    lo, hi = 0, n
    while hi - lo > 1:  # the bound rises with the count
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if low(mid) >= share else (mid, hi)
    return hi


def parsed(names: DataFrame, head_share: float = 0.004, support: int = 5, given_types: tuple[str, ...] = ("Person",)) -> DataFrame:
    """Distinct names (type, name, words) with their block (what must agree), given name and rare part."""
    spark = names.sparkSession
    words = names.select("type", "name", F.posexplode("words").alias("at", "w"))
    total = {r["type"]: r["n"] for r in names.groupBy("type").agg(F.count("*").alias("n")).collect()}
    bound = F.lit(support)
    for t, n in total.items():
        bound = F.when(F.col("type") == t, F.lit(max(support, frequent(n, head_share)))).otherwise(bound)
    counted = words.where(F.length("w") > 2).groupBy("type", "w").agg(F.countDistinct("name").alias("n")).where(F.col("n") >= bound)
    counts: dict[str, dict[str, int]] = {}
    for r in counted.collect():  # at most words per name / head_share rows a type
        counts.setdefault(r["type"], {})[r["w"]] = r["n"]
    heads = counted.select("type", "w")
    one, two = words.join(F.broadcast(heads), ["type", "w"]), words.join(F.broadcast(heads), ["type", "w"])
    pairs = one.alias("a").join(two.alias("b"), F.expr("a.type = b.type and a.name = b.name and b.at = a.at + 1"))
    pairs = pairs.groupBy(F.col("a.type").alias("type"), F.col("a.w").alias("x"), F.col("b.w").alias("y")).agg(F.count("*").alias("n")).where(F.col("n") >= bound)
    near: dict[str, dict] = {}
    for r in pairs.collect():  # each needs as many names as a head does, so there are no more of them
        near.setdefault(r["type"], {})[r["x"], r["y"]] = r["n"]
    short: dict[str, list[str]] = {}
    few = words.where(F.length("w").between(3, 8)).groupBy("type", "w").agg(F.countDistinct("name").alias("n")).where(F.col("n") >= F.greatest(F.lit(2), bound / 20))
    for r in few.collect():  # at most 20 times as many as heads
        short.setdefault(r["type"], []).append(r["w"])
    shared = spark.sparkContext.broadcast({t: (counts.get(t, {}), near.get(t, {}), t in given_types, sorted(short.get(t, []))) for t in total})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = {t: Heads(*x) for t, x in shared.value.items()}
        for batch in batches:
            rows = []
            for t, name, ws in zip(*(c.to_pylist() for c in batch.columns)):
                h, initials, rare = readers[t].parse(ws)
                if t in given_types:
                    block, given = (h[0][0] if h else initials[0] if initials else ""), (h[0] if h else None)
                else:
                    block, given = " ".join(h), " ".join(h)
                rows.append((t, name, block, given, " ".join(rare)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)] if rows else [pa.array([], pa.string())] * 5, names=[f.split()[0] for f in PARSED.split(", ")])

    # reading a name takes some 80 us, so tasks are cut by count, not by bytes
    tasks = max(1, -(-sum(total.values()) // 10_000))
    return names.select("type", "name", "words").repartition(tasks, "name").mapInArrow(run, PARSED)


def grams(c: str, q: int = 3) -> Column:
    """Distinct q-grams of the padded tokens of ``c``, whatever their order."""
    pad = F.lit("^" * (q - 1)), F.lit("$" * (q - 1))
    per = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) + (q - 1)), lambda i: F.concat(pad[0], t, pad[1]).substr(i, F.lit(q)))
    return F.array_distinct(F.flatten(F.transform(F.split(c, " "), per)))


def likeness(a: str, b: str, most: int) -> float:
    """1 for equal tokens, less an edit's share for each typo, 0 beyond ``most``: another token."""
    if a == b:
        return 1.0
    d = typos(a, b, most)
    return 1 - d / max(len(a), len(b)) if d <= most else 0.0


def soft_similarity(a: list[tuple[str, float]], b: list[tuple[str, float]], agreed: float, most: int) -> float:
    """Soft weighted similarity of two sets of (token, weight) that agree in heads of weight ``agreed``.

    The most like pair of tokens is matched first; a pair weighs as its rarer token, and what has no partner counts as unlike.
    """
    pairs = sorted(((likeness(x, y, most), max(v, w), i, j) for i, (x, v) in enumerate(a) for j, (y, w) in enumerate(b)), reverse=True)
    left, right, same, total = set(range(len(a))), set(range(len(b))), agreed, agreed
    for like, weight, i, j in pairs:
        if like > 0 and i in left and j in right:
            left.remove(i), right.remove(j)
            same, total = same + like * weight, total + weight
    total += sum(a[i][1] for i in left) + sum(b[j][1] for j in right)
    return same / total if total else 1.0


def similar_keys(keys: DataFrame, cuts: Cuts, most: int = 1, accept: float = 0.86) -> DataFrame:
    """Pairs (a, b) of rare parts under one (type, block), or one of them under none, whose soft weighted similarity is ``accept``
    or more. Rare parts of different numbers of tokens are different.

    ``keys``: (type, block, rare, n names). A typo changes at most four trigrams (swapped letters), so of two keys whose
    tokens differ by ``most`` typos each, either has at most four times that many a token the other lacks: one more
    of its rarest trigrams than that is what it is indexed by. A token weighs as its inverse document frequency.
    """
    idf = lambda n: F.log(1 + F.col("total") / F.col(n))
    total = keys.groupBy("type").agg(F.sum("n").alias("total"))  # a row per type
    blocks = keys.groupBy("type", "block").agg(F.sum("n").alias("in_block"))
    key = F.concat_ws("|", "type", "block", "rare").alias("key")
    words = keys.where("rare <> ''").select("type", "block", "rare", key, "n", F.explode(F.split("rare", " ")).alias("w"))
    counted = words.groupBy("type", "w").agg(F.sum("n").alias("with_word")).join(F.broadcast(total), "type").select("type", "w", idf("with_word").alias("weight"))
    weighed = words.join(counted, ["type", "w"]).groupBy("type", "block", "rare", "key").agg(F.collect_list(F.struct("w", "weight")).alias("tokens"))  # as many as a name has
    k = weighed.join(blocks, ["type", "block"]).join(F.broadcast(total), "type").select("type", "block", "rare", "key", "tokens", idf("in_block").alias("wh"))
    k = cuts.cut(k)
    flat = k.select("type", "block", "key", F.length("rare").alias("len"), F.size("tokens").alias("size"), F.explode(grams("rare")).alias("gram"))
    frequency = flat.groupBy("gram").agg(F.count("*").alias("df"))
    w = Window.partitionBy("key").orderBy("df", "gram")
    prefix = flat.join(frequency, "gram").withColumn("at", F.row_number().over(w)).where(F.col("at") <= 4 * most * F.col("size") + 1)
    side = cuts.cut(prefix.select("type", "block", "gram", "key", "len", "size"))
    # as long as each other but for the typos; names of as many rare tokens only, as one without a partner weighs too much
    near = f"x.type = y.type and x.gram = y.gram and x.size = y.size and abs(x.len - y.len) <= {most} * x.size"
    x, y = side.alias("x"), side.alias("y")
    closed = x.join(y, F.expr(f"{near} and x.block = y.block and x.key < y.key")).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
    # a name without heads, such as a company's without its line of business, may be of any block
    opened = side.where("block = ''").alias("x").join(side.where("block <> ''").alias("y"), F.expr(near)).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, wh = (batch.column(i).to_pylist() for i in (3, 4, 5))
            score = [soft_similarity([(t["w"], t["weight"]) for t in x], [(t["w"], t["weight"]) for t in y], h, most) for x, y, h in zip(a, b, wh)]
            keep = pa.array([s >= accept for s in score])
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[:3]], names=["a", "b", "block"])

    def verified(pairs: DataFrame) -> DataFrame:
        one, two = (k.select(F.col("key").alias(c), F.col("rare").alias(f"r{c}"), F.col("tokens").alias(f"t{c}"), F.col("block").alias(f"block_{c}"), F.col("wh").alias(f"wh_{c}")) for c in "ab")
        both = pairs.distinct().join(one, "a").join(two, "b")
        # a typo, or swapped letters, is at most two of the JVM's edits
        maybe = both.where((F.size("ta") > 1) | (F.levenshtein("ra", "rb") <= 2 * most))
        return maybe.select("a", "b", F.col("block_b").alias("block"), "ta", "tb", F.col("wh_b").alias("wh")).mapInArrow(verify, "a string, b string, block string")

    # it is linked where all that are like it are of one block
    single = verified(opened).groupBy("a").agg(F.min("b").alias("b"), F.count_distinct("block").alias("blocks")).where("blocks = 1")
    return verified(closed).select("a", "b").unionByName(single.select("a", "b"))


def entity_names(entities: DataFrame, types: tuple[str, ...] = ("Company", "Person")) -> DataFrame:
    """(id, type, name): one row per id of the types; names that are null or blank are none."""
    rows = entities.where(F.col("entity_type").isin(*types) & F.col("id").isNotNull() & (F.trim("name") != ""))
    return rows.groupBy("id").agg(F.min("entity_type").alias("type"), F.min("name").alias("name"))


def linked_names(entities: DataFrame, types: tuple[str, ...] = ("Company", "Person")) -> DataFrame:
    """(id, group_key): ids whose names mean the same entity share the key.

    Null and blank names take no part, nor do other types; repeated ids count once; a name of which only titles
    or legal forms remain stands alone; an empty table gives no row; other columns are ignored.
    """
    cuts = Cuts(entities.sparkSession, "names")
    ids = cuts.cut(entity_names(entities, types))
    names = ids.select("type", "name").distinct().withColumn("words", tokens(F.col("name")))
    structure = cuts.cut(parsed(names))
    keys = cuts.cut(structure.groupBy("type", "block", "rare").agg(F.count("*").alias("n")))
    links = cuts.cut(similar_keys(keys, cuts))
    own = keys.select(F.concat_ws("|", "type", "block", "rare").alias("a")).withColumn("b", F.col("a"))
    groups = linked_groups(own.unionByName(links), "a", "b")
    known = structure.withColumn("member_id", F.concat_ws("|", "type", "block", "rare")).join(groups, "member_id")
    # an initial stands for the group's given name where there is only one
    names_in = known.where("given <> ''").groupBy("group_id").agg(F.min("given").alias("lo"), F.max("given").alias("hi"))
    full = known.join(names_in, "group_id", "left").withColumn("who", F.coalesce(F.when(F.col("given") != "", F.col("given")), F.when(F.col("lo") == F.col("hi"), F.col("lo")), F.lit("?")))
    nameless = (F.col("rare") == "") & (F.coalesce("given", F.lit("")) == "")
    key = F.when(nameless, F.concat_ws("|", "type", "name")).otherwise(F.concat_ws("|", "group_id", "who"))
    return ids.join(full.select("type", "name", key.alias("group_key")), ["type", "name"]).select("id", "group_key")


def same_entity_pairs(entities: DataFrame) -> DataFrame:
    """(id_a, id_b): every pair of different ids that name the same company or person."""
    linked = linked_names(entities)
    return linked.alias("x").join(linked.alias("y"), F.expr("x.group_key = y.group_key and x.id < y.id")).select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"))
