"""What calls models elsewhere. Each surface has a rule-based default, so everything runs without one."""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import schema


def with_retry(call: Callable, tries: int = 3, base: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """The call with waits of base^n seconds between its tries; the last failure is raised."""

    def run(*args):
        for n in range(tries):
            try:
                return call(*args)
            except Exception:
                if n == tries - 1:
                    raise
                sleep(base**n)

    return run


def chain(*calls: Callable[[str], str | None]) -> Callable[[str], str]:
    """The first call's answer that isn't empty; failures count as none; at last the text itself."""

    def run(x: str) -> str:
        for call in calls:
            try:
                if y := call(x):
                    return y
            except Exception:
                continue
        return x

    return run


@dataclass(frozen=True)
class Models:
    """What a model may do for the engine; each is None, or may return None to decline. By default all is done by rule."""

    decompose: Callable[[str], list[str] | None] | None = None
    synthesise: Callable[[str, list[str]], str | None] | None = None
    explain: Callable[[str, list[str]], list[str] | None] | None = None
    verify: Callable[[str, list[str]], bool | None] | None = None


def attempt(call: Callable, *args):
    """The call's result, or None where it fails."""
    try:
        return call(*args)
    except Exception:
        return None


def gather(call: Callable, items: Sequence, at_once: int = 10, tries: int = 3, base: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> list:
    """Results in the items' order, at most ``at_once`` calls at a time, each with retries; None where all tries failed."""
    run = with_retry(call, tries, base, sleep)
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        return list(pool.map(lambda x: attempt(run, x), items))


def hashed_embedding(text: str, dim: int = 64) -> list[float]:
    """A unit vector of hashed character trigrams: the default where no model embeds."""
    v = [0.0] * dim
    padded = f"  {text.lower()} "
    for i in range(len(padded) - 2):
        h = int.from_bytes(hashlib.blake2b(padded[i : i + 3].encode(), digest_size=8).digest(), "big")
        v[h % dim] += 1.0 if h >> 63 else -1.0
    norm = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / norm for x in v]


def embedded(c: Column, embed: Callable[[list[str]], list[list[float]]] | None = None, batch: int = 100, at_once: int = 10) -> Column:
    """Vectors of texts by an embedder of batches, some at a time in each task; null for null texts and failed batches."""

    @F.pandas_udf("array<double>")
    def f(texts: pd.Series) -> pd.Series:
        out: list = [None] * len(texts)
        known = [i for i, t in enumerate(texts) if t is not None]
        parts = [known[i : i + batch] for i in range(0, len(known), batch)]
        call = embed or (lambda ts: [hashed_embedding(t) for t in ts])
        for part, vectors in zip(parts, gather(lambda p: call([texts.iloc[i] for i in p]), parts, at_once)):
            for i, v in zip(part, vectors or []):
                out[i] = v
        return pd.Series(out)

    return f(c)


def translated(c: Column, *calls: Callable[[str], str | None]) -> Column:
    """Text through a chain of translators, in Arrow batches; without one, the text as it is."""
    if not calls:
        return c
    translate = chain(*calls)

    @F.pandas_udf("string")
    def f(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else translate(t))

    return f(c)


def extracted(sections: DataFrame, extract: Callable[[list[str]], list[list[dict]]], batch: int = 10, at_once: int = 10) -> DataFrame:
    """Facts of text sections by an extractor that takes batches of texts, some at a time in each task; a failed batch gives none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.name for f in fields]
        for frame in frames:
            texts = frame["section"].tolist()
            found = gather(extract, [texts[i : i + batch] for i in range(0, len(texts), batch)], at_once)
            rows = [fact for part in found for facts in part or [] for fact in facts]
            yield pd.DataFrame(rows, columns=names)

    fields = sections.sparkSession.createDataFrame([], schema.FACTS).schema
    return sections.select("section").mapInPandas(run, schema.FACTS)
