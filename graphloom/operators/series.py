"""Price and event series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.temporal import percent_change, tolerant_timestamp
from graphloom.session import Cuts

#: Headers as they come, trimmed and in lower case, and the names they get (fixed values).
HEADERS = {"date": "Date", "open": "Open", "high": "High", "low": "Low", "close": "Close", "volume": "Volume", "adj close": "Adj Close", "prev close": "Prev Close", "close price": "Close"}


def standardise_headers(df: DataFrame) -> DataFrame:
    """Known headers without outer spaces and in one case; of two that become the same the first stays."""
    seen, cols = set(), []
    for c in df.columns:
        name = HEADERS.get(c.strip().lower(), c.strip())
        if name not in seen:
            seen.add(name)
            cols.append(F.col(f"`{c}`").alias(name))
    return df.select(*cols)


def price_on(series: DataFrame, key: str, day: str) -> DataFrame:
    """The prices of a day; missing columns are 0."""
    rows = series.where((F.col("ticker") == key) & (F.to_date("Date") == F.lit(day).cast("date")))
    value = lambda c: (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in series.columns else F.lit(0.0)).alias(c.lower())
    return rows.select("ticker", F.to_date("Date").alias("date"), *[value(c) for c in ("Open", "High", "Low", "Close", "Volume")])


def change_between(series: DataFrame, first: str, last: str) -> DataFrame:
    """(ticker, change_pct) of the closes of two days; null where one is missing."""
    at = lambda day: F.max(F.when(F.to_date("Date") == F.lit(day).cast("date"), F.col("Close")))
    return series.groupBy("ticker").agg(percent_change(at(first), at(last)).alias("change_pct"))


def tail(series: DataFrame, n: int = 30) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy(F.desc("Date"), F.desc("Close"))
    return series.withColumn("from_end", F.row_number().over(w)).where(F.col("from_end") <= n)


def summary(series: DataFrame, n: int = 30) -> DataFrame:
    """Per ticker over its last ``n`` rows: first and latest close, change, extremes, mean volume, and a sentence."""
    t = tail(series, n)
    agg = t.groupBy("ticker").agg(
        F.min_by("Close", "from_end").alias("latest"), F.max_by("Close", "from_end").alias("first"), F.max("High").alias("high"), F.min("Low").alias("low"), F.avg("Volume").alias("avg_volume")
    )
    agg = agg.withColumn("change_pct", percent_change(F.col("first"), F.col("latest")))
    move = F.when(F.col("change_pct") >= 0, "increase").otherwise("decrease")
    said = F.format_string("%s closed at %.2f, an %s of %.2f%% over the period.", F.col("ticker"), F.col("latest"), move, F.abs("change_pct"))
    return agg.withColumn("sentence", F.when(move == "decrease", F.replace(said, F.lit("an decrease"), F.lit("a decrease"))).otherwise(said))


def coverage(series: DataFrame) -> DataFrame:
    """Per ticker: rows, first and last date and the last row's close."""
    return series.groupBy("ticker").agg(F.count("*").alias("n"), F.min("Date").alias("first_date"), F.max("Date").alias("last_date"), F.max_by("Close", F.struct("Date", "Close")).alias("last_close"))


def systematic_sample(series: DataFrame, k: int) -> DataFrame:
    """At most ``k`` rows a ticker: every n-th in order of date, n being a k-th of its rows."""
    order = Window.partitionBy("ticker").orderBy("Date", "Close")
    n = F.count("*").over(Window.partitionBy("ticker"))
    rows = series.withColumn("rn", F.row_number().over(order)).withColumn("step", F.greatest(F.lit(1), F.floor(n / k)))
    return rows.where(((F.col("rn") - 1) % F.col("step") == 0) & (F.floor((F.col("rn") - 1) / F.col("step")) < k)).drop("rn", "step")


def numbered(df: DataFrame, *order: str, name: str = "rn") -> DataFrame:
    """Rows numbered from 1 in a global order without gathering them in one task.

    Rows are range-partitioned and sorted, and written, since the bounds are sampled anew at each run; a partition's
    numbers start after the counts of those before it. The counts, a row a partition, are all that is gathered.
    """
    parts = Cuts(df.sparkSession, "numbered").cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    counts = parts.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_lo"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_p", "_lo", before.alias("_before"))
    return parts.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_i") - F.col("_lo") + F.col("_before") + 1).drop("_p", "_i", "_lo", "_before")


def every_nth(df: DataFrame, n: int, *order: str) -> DataFrame:
    return numbered(df, *order).where((F.col("rn") - 1) % n == 0).drop("rn")


def chunks(df: DataFrame, size: int, *order: str) -> DataFrame:
    return numbered(df, *order).withColumn("chunk", F.floor((F.col("rn") - 1) / size)).drop("rn")


def running_sentiment(rows: DataFrame, key: str, order: str, value: str, tail: int = 60) -> DataFrame:
    """Per key the fold s <- (s + x) / 2 over the known values in order, and their number.

    The fold is s_n = x_1 / 2^(n-1) + sum of x_i / 2^(n-i+1), i > 1: a sum. Values more than ``tail`` = 60 from the end weigh
    less than a double can tell, so only a tail per key is ranked: the window's limit keeps that many rows of a key in
    each input partition before anything is shuffled, however hot the key. The first value and the number are plain aggregates.
    """
    known = rows.where(F.col(value).isNotNull()).select(key, order, value)
    last = known.withColumn("from_end", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("from_end") <= tail)
    ends = last.groupBy(key).agg(F.sum(F.col(value) * F.pow(F.lit(0.5), F.col("from_end"))).alias("s"))
    first = known.groupBy(key).agg(F.min_by(value, order).alias("x"), F.count("*").alias("n"))
    # the first value counts double, where it is within reach
    both = first.join(ends, key)
    return both.select(key, (F.col("s") + F.col("x") * F.pow(F.lit(0.5), F.col("n"))).alias("sentiment"), "n")


def between_dates(rows: DataFrame, c: str, first: str, last: str) -> DataFrame:
    """Rows whose date, a timestamp or text in any of the known forms, lies in a range, both ends included; a date that is
    missing or can't be read drops the row."""
    at = F.col(c) if dict(rows.dtypes)[c] in ("timestamp", "timestamp_ntz", "date") else tolerant_timestamp(F.col(c))
    # the date is read once for both bounds
    return rows.where(F.exists(F.array(at), lambda x: x.between(F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp"))))


def looked_up(rows: DataFrame, names: DataFrame, key: str, default: str, out: str) -> DataFrame:
    """``rows`` with the name that ``names(key, name)`` has for their key, else their ``default`` column."""
    known = names.groupBy(key).agg(F.min("name").alias("_name"))
    return rows.join(known, key, "left").withColumn(out, F.coalesce("_name", default)).drop("_name")


def ranked(df: DataFrame, *by: Column | str, name: str = "rank") -> DataFrame:
    """Rows numbered from 1 in a global order, without a window over all of them."""
    cols = {f"_o{i}": (F.col(c) if isinstance(c, str) else c) for i, c in enumerate(by)}
    return numbered(df.withColumns(cols), *cols, name=name).drop(*cols)
