"""Numeric, vector and token functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def sentiment_bucket(s: Column, edge: float = 0.2) -> Column:
    return F.when(s > edge, "positive").when(s < -edge, "negative").when(s.isNotNull(), "neutral")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for vectors of different length or without length."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def softmax(v: Column) -> Column:
    top = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x.cast("double") - top.cast("double")))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def log_softmax(v: Column) -> Column:
    top = F.array_max(v).cast("double")
    total = F.log(F.aggregate(v, F.lit(0.0), lambda s, y: s + F.exp(y.cast("double") - top)))
    return F.transform(v, lambda x: x.cast("double") - top - total)


def top_k_indices(v: Column, k: int) -> Column:
    """Places of the ``k`` greatest values, greatest first, ties by place."""
    pairs = F.transform(v, lambda x, i: F.struct((-x.cast("double")).alias("n"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: p["i"])


def has_repeated_ngram(ids: Column, n: int) -> Column:
    """Whether the last n-gram of a token list occurs before."""
    last = F.slice(ids, F.greatest(F.lit(1), F.size(ids) - n + 1), n)
    starts = F.when(F.size(ids) > n, F.sequence(F.lit(1), F.size(ids) - n)).otherwise(F.array().cast("array<int>"))
    return F.exists(starts, lambda i: F.slice(ids, i, n) == last)


def blocked_tokens(ids: Column, n: int) -> Column:
    """Tokens that would repeat an n-gram if they came next."""
    stem = F.slice(ids, F.greatest(F.lit(1), F.size(ids) - n + 2), n - 1)
    starts = F.when(F.size(ids) >= n, F.sequence(F.lit(1), F.size(ids) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.array_distinct(F.transform(F.filter(starts, lambda i: F.slice(ids, i, n - 1) == stem), lambda i: F.element_at(ids, (i + n - 1).cast("int")))))


def repetition_penalty(logits: Column, seen: Column, penalty: float) -> Column:
    """Logits of seen tokens divided by the penalty if positive, else multiplied."""
    return F.transform(logits, lambda x, i: F.when(F.array_contains(seen, i), F.when(x > 0, x / penalty).otherwise(x * penalty)).otherwise(x))


def drop_special(ids: Column, special: tuple[int, ...] = (0, 1, 2, 3)) -> Column:
    return F.filter(ids, lambda x: ~x.isin(*special))


def frame(ids: Column, limit: int, bos: int = 2, eos: int = 3) -> Column:
    """A target of at most ``limit`` ids between begin and end marks."""
    return F.concat(F.array(F.lit(bos)), F.slice(ids, 1, limit), F.array(F.lit(eos)))


def pad_to(ids: Column, width: Column, value: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(F.lit(0), width - F.size(ids)).cast("int")))


def merge_attributes(existing: Column, incoming: Column) -> Column:
    """Union of two attribute maps: the greater confidence, else what is there unless null."""
    return F.map_zip_with(existing, incoming, lambda k, a, b: F.when(k == "confidence", F.greatest(F.coalesce(a.cast("double"), F.lit(0.0)), F.coalesce(b.cast("double"), F.lit(0.0))).cast("string")).otherwise(F.coalesce(a, b)))


def drop_nulls(m: Column) -> Column:
    return F.map_filter(m, lambda _, v: v.isNotNull())


def json_values(c: Column, defaults: dict[str, object]) -> list[Column]:
    """The named values of a JSON object, each with its default where it is missing, null or of another type."""
    kinds = {bool: "boolean", int: "bigint", float: "double", str: "string"}
    read = F.from_json(c, ", ".join(f"`{k}` {kinds[type(v)]}" for k, v in defaults.items()), {"mode": "PERMISSIVE"})
    return [F.coalesce(read[k], F.lit(v).cast(kinds[type(v)])).alias(k) for k, v in defaults.items()]
