"""Bounded samples for fitting: what reaches the driver doesn't grow with the table or its partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

SCALE = 1 << 30


def hash_sample(rows: DataFrame, total: int, most: int, *key: str) -> list[Row]:
    """At most ``most`` distinct rows, those of the least hashes of their key; ``total`` is about how many rows there are.

    Only rows whose hash is below the share wanted, and some more, leave their partition: some 1.3 * ``most``, copies once.
    """
    share = min(1.0, 1.3 * most / max(total, 1))
    place = F.pmod(F.xxhash64(*key), F.lit(SCALE))
    found = rows.withColumn("_place", place).where(F.col("_place") < int(share * SCALE)).distinct().collect()
    return sorted(found, key=lambda r: (r["_place"], *map(str, r)))[:most]
