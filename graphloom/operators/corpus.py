"""Preparation of parallel text."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from graphloom.functions.numeric import frame, pad_to


def usable_pairs(pairs: DataFrame, src: str = "src", tgt: str = "tgt", longer_than: int = 20) -> DataFrame:
    """Both sides longer than that, and the target not plain ASCII. Nulls are dropped."""
    long = lambda c: F.length(F.trim(c)) > longer_than
    return pairs.where(long(src) & long(tgt) & F.col(tgt).rlike(r"[^\x00-\x7F]"))


def both_directions(pairs: DataFrame) -> DataFrame:
    """Each pair as two rows, one per direction, without outer spaces."""
    bare = lambda c: F.regexp_replace(c, r"^[\s\u00A0]+|[\s\u00A0]+$", "")
    way = lambda a, b, x, y: F.struct(bare(x).alias("src"), bare(y).alias("tgt"), F.concat_ws("→", a, b).alias("direction"))
    en, lang = F.lit("en"), F.col("lang")
    rest = [c for c in pairs.columns if c not in ("src", "tgt", "direction")]
    return pairs.select(*rest, F.explode(F.array(way(en, lang, "src", "tgt"), way(lang, en, "tgt", "src"))).alias("p")).select(*rest, "p.*")


def cap_per_language(pairs: DataFrame, n: int, order: str) -> DataFrame:
    """The first ``n`` of each language. Spark's window limit keeps ``n`` per input partition before the shuffle."""
    w = Window.partitionBy("lang").orderBy(order)
    return pairs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def split(pairs: DataFrame, key: str, validation_percent: int = 5) -> DataFrame:
    """train or validation by the first 32 bits of the MD5 of the key as text: the same for a key in every run and engine."""
    first = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    return pairs.withColumn("split", F.when(first % 100 < validation_percent, "validation").otherwise("train"))


def training_rows(pairs: DataFrame, src: str = "src_ids", tgt: str = "tgt_ids", source_limit: int = 512, target_limit: int = 510) -> DataFrame:
    return pairs.withColumns({src: F.slice(src, 1, source_limit), tgt: frame(F.col(tgt), target_limit)})


def padded_batches(rows: DataFrame, batch: str, src: str = "src_ids", tgt: str = "tgt_ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per batch: sources and shifted targets padded to its longest, labels padded with -100, and the masks."""
    w = Window.partitionBy(batch)
    dec, lab = F.slice(tgt, F.lit(1), F.size(tgt) - 1), F.slice(tgt, F.lit(2), F.size(tgt) - 1)
    rows = rows.withColumns({"dec": dec, "labels": lab})
    s_width, t_width = F.max(F.size(src)).over(w), F.max(F.size("dec")).over(w)
    rows = rows.withColumns({"s_width": s_width, "t_width": t_width})
    mask = lambda c, width: F.concat(F.array_repeat(F.lit(1), F.size(c)), F.array_repeat(F.lit(0), (F.col(width) - F.size(c)).cast("int")))
    return rows.select(
        batch, *keep, mask(src, "s_width").alias("mask"), pad_to(F.col(src), F.col("s_width"), 0).alias("src"), pad_to(F.col("dec"), F.col("t_width"), 0).alias("dec"), pad_to(F.col("labels"), F.col("t_width"), -100).alias("labels")
    )


def whitespace_tokens(t: Column) -> Column:
    return F.filter(F.split(F.trim(t), r"\s+"), lambda w: w != "")


def fertility(tokens: Column, t: Column) -> Column:
    """Tokens per word; a text without words counts as one word."""
    return F.size(tokens) / F.greatest(F.lit(1), F.size(whitespace_tokens(t)))


def beam_step(beams: DataFrame, width: int, vocab_size: int) -> DataFrame:
    """(beam, score, logp) to the ``width`` best continuations: (parent, token, score)."""
    rows = beams.select("score", F.col("beam").alias("parent"), F.posexplode("logp").alias("token", "lp"))
    total = rows.select("parent", "token", (F.col("score") + F.col("lp")).alias("score")).withColumn("flat", F.col("parent") * vocab_size + F.col("token"))
    return total.orderBy(F.desc("score"), "flat").limit(width).select("parent", "token", "score")


def final_score(score: Column, length: Column, alpha: float = 1.0) -> Column:
    return score / F.pow(F.greatest(length, F.lit(1)), F.lit(alpha))


def piece_ids(t: Column, model_file: str) -> Column:
    """Ids of a public subword model's file, which each task opens once."""
    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model_file)
        for texts in batches:
            yield pd.Series(p.encode([x or "" for x in texts]))

    return ids(t)


#: Scores of every next token for each of some prefixes of one source: (source, prefixes) -> log-probabilities.
Scorer = Callable[[list[int], list[list[int]]], "list[list[float]]"]


def decode(source: list[int], score: Scorer, beams: int = 1, limit: int = 64, begin: int = 2, end: int = 3, no_repeat: int = 0, penalty: float = 1.0, alpha: float = 1.0) -> list[int]:
    """The best sequence by beam search; with one beam, greedily. Without the begin and end marks.

    Tokens that would repeat an n-gram of ``no_repeat`` are left out, those seen are made less likely by ``penalty``, and
    finished sequences are compared by their score over their length to the power ``alpha``. Ties go to the earlier
    beam, then the lesser token.
    """
    live: list[tuple[float, list[int]]] = [(0.0, [begin])]
    ended: list[tuple[float, list[int]]] = []
    for _ in range(limit):
        found = []
        for place, ((total, ids), logp) in enumerate(zip(live, score(source, [ids for _, ids in live]))):
            stem = ids[len(ids) - no_repeat + 1 :] if no_repeat else []
            barred = {ids[i + no_repeat - 1] for i in range(len(ids) - no_repeat + 1) if ids[i : i + no_repeat - 1] == stem} if no_repeat else set()
            for token, lp in enumerate(logp):
                if token not in barred and lp > float("-inf"):
                    lp = lp if token not in ids or penalty == 1 else lp * penalty if lp < 0 else lp / penalty
                    found.append((-(total + lp), place, token))
        found = heapq.nsmallest(2 * beams, found)
        after = []
        for at, (minus, place, token) in enumerate(found):
            ids = [*live[place][1], token]
            if token != end:
                after.append((-minus, ids))
            elif at < beams:  # an end counts only among the best
                ended.append((-minus, ids))
        live = after[:beams]
        if not live or len(ended) >= beams:
            break
    pool = ended or live or [(0.0, [begin])]
    best = max(pool, key=lambda x: x[0] / max(1, len(x[1]) - 1) ** alpha)[1]
    return [i for i in best[1:] if i != end]


def generated(rows: DataFrame, c: str, load: Callable[[], Scorer], out: str = "out_ids", **options) -> DataFrame:
    """``rows`` with the decoded sequence of the source ids in ``c``; each task loads its scorer once. A null source gives null."""
    spec = StructType([*rows.schema.fields, StructField(out, ArrayType(IntegerType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        for frame in frames:
            frame[out] = [None if s is None else decode([int(i) for i in s], score, **options) for s in frame[c]]
            yield frame

    return rows.mapInPandas(run, spec)
