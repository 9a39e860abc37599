"""Semi-joins by a bitmap of fixed size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2 MB, in 512 buckets of 4 KB: what is broadcast of the keys wanted, however many they are.
BITMAP_BITS = 1 << 24


def in_bitmap(rows: DataFrame, wanted: DataFrame, *key: str) -> DataFrame:
    """The rows whose key may be among ``wanted``'s: all that are, and few others while those are well below ``BITMAP_BITS``."""
    bit = F.pmod(F.xxhash64(*key), F.lit(BITMAP_BITS))
    some = wanted.select(bit.alias("bit")).distinct().groupBy(F.expr("bitmap_bucket_number(bit)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits"))
    # every bucket is there, so the broadcast has one size at all times
    every = wanted.sparkSession.range(1, BITMAP_BITS // 32768 + 1).withColumnRenamed("id", "bucket")
    bitmap = every.join(some, "bucket", "left").select("bucket", F.coalesce("bits", F.expr("unhex(repeat('00', 4096))")).alias("bits"))
    hit = rows.withColumn("bit", bit).withColumn("bucket", F.expr("bitmap_bucket_number(bit)")).join(F.broadcast(bitmap), "bucket")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bitmap_bit_position(bit) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return hit.withColumn("byte", byte).where("(shiftright(byte, cast(bitmap_bit_position(bit) % 8 as int)) & 1) = 1").select(*rows.columns)
