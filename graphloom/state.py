"""Versioned tables for state that must outlive the driver.

Under one path, all executors' and the next driver's: ``data/<table>/<version>-<id>`` holds what a version wrote and
``commits/<version>.json`` lists, per table and bucket, the folders that make up the state. A version counts from the
moment its commit file is there under its name, which is one rename; what an unfinished one wrote is never read. The last
batch of a stream is part of the commit: one that comes again is skipped, so a replay changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Versions:
    """Tables in ``buckets`` buckets: a batch appends to buckets or replaces those it touches, never the rest."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str], buckets: int = 16):
        self.spark, self.path, self.schemas, self.buckets = spark, path.rstrip("/"), schemas, buckets
        self.jvm = spark.sparkContext._jvm
        self.fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.version, self.batch, self.parts = -1, -1, {t: {} for t in schemas}
        done = self._names(f"{self.path}/commits")
        last = max((n for n in done if n.endswith(".json")), default=None)
        if last:
            saved = json.loads(spark.read.text(f"{self.path}/commits/{last}", wholetext=True).first()[0])
            self.version, self.batch, self.parts, self.buckets = saved["version"], saved["batch"], {t: {int(b): p for b, p in per.items()} for t, per in saved["parts"].items()}, saved["buckets"]

    def _at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, path: str) -> list[str]:
        p = self._at(path)
        return [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def touched(self, df: DataFrame, key: str) -> list[int]:
        """The buckets of the keys of ``df``: at most ``buckets`` numbers."""
        return sorted(r[0] for r in df.select(self.bucket(key)).distinct().collect())

    def read(self, table: str, buckets: Sequence[int] | None = None) -> DataFrame:
        per = self.parts[table]
        paths = [p for b in (per if buckets is None else buckets) for p in per.get(b, [])]
        return self.spark.read.schema(self.schemas[table]).parquet(*paths) if paths else self.spark.createDataFrame([], self.schemas[table])

    def _write(self, table: str, df: DataFrame, key: str, salt: str | None) -> dict[int, str]:
        path = f"{self.path}/data/{table}/{self.version + 1:012d}-{uuid.uuid4().hex}"
        cols = [f.split()[0] for f in self.schemas[table].split(", ")]
        rows = df.select(*cols).withColumn("bucket", self.bucket(key))
        # a bucket with a hot key is written by several tasks
        by = ["bucket", F.pmod(F.xxhash64(salt), F.lit(4))] if salt else ["bucket"]
        rows.repartition(*by).write.partitionBy("bucket").option("compression", "zstd").parquet(path)
        return {int(n.split("=")[1]): f"{path}/{n}" for n in self._names(path) if n.startswith("bucket=")}

    def append(self, table: str, df: DataFrame, key: str, salt: str | None = None) -> None:
        for b, p in self._write(table, df, key, salt).items():
            self.parts[table][b] = [*self.parts[table].get(b, []), p]

    def replace(self, table: str, df: DataFrame, key: str, buckets: Sequence[int], salt: str | None = None) -> None:
        """``df`` is all that the given buckets hold from now on."""
        new = self._write(table, df, key, salt)
        for b in buckets:
            self.parts[table][b] = [new[b]] if b in new else []

    @contextmanager
    def update(self, batch: int | None = None) -> Iterator[bool]:
        """Appends and replacements inside become one version at the end, or nothing if they fail; False for a ``batch`` committed before."""
        if batch is not None and batch <= self.batch:
            yield False
            return
        before = {t: {b: list(p) for b, p in per.items()} for t, per in self.parts.items()}
        try:
            yield True
            self._commit(self.batch if batch is None else batch)
        except BaseException:
            self.parts = before
            raise

    def _commit(self, batch: int) -> None:
        """Then folders that neither this version nor the one before it names are deleted."""
        now, version = {p for per in self.parts.values() for ps in per.values() for p in ps}, self.version + 1
        name, temporary = f"{self.path}/commits/{version:012d}.json", f"{self.path}/commits/.{uuid.uuid4().hex}"
        out = self.fs.create(self._at(temporary), True)
        out.write(bytearray(json.dumps({"version": version, "batch": batch, "buckets": self.buckets, "parts": self.parts}).encode()))
        out.close()
        if self.fs.exists(self._at(name)) or not self.fs.rename(self._at(temporary), self._at(name)):
            raise RuntimeError(f"version {version} was committed by another driver")
        self.version, self.batch = version, batch
        old = sorted(n for n in self._names(f"{self.path}/commits") if n.endswith(".json"))
        for n in old[:-2]:
            self.fs.delete(self._at(f"{self.path}/commits/{n}"), False)
        kept = now | (self._listed(old[-2]) if len(old) > 1 else set())
        for t in self.schemas:
            for n in self._names(f"{self.path}/data/{t}"):
                folder = f"{self.path}/data/{t}/{n}"
                if not any(p.startswith(folder) for p in kept):
                    self.fs.delete(self._at(folder), True)

    def _listed(self, name: str) -> set[str]:
        saved = json.loads(self.spark.read.text(f"{self.path}/commits/{name}", wholetext=True).first()[0])
        return {p for per in saved["parts"].values() for ps in per.values() for p in ps}

    def clear(self) -> None:
        self.fs.delete(self._at(self.path), True)
