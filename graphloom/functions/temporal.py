"""Date and time functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom import vocab

#: Formats tried in order (fixed values).
FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "dd-MM-yyyy", "dd/MM/yyyy")
ISO_DATE = r"(\d{4}-\d{2}-\d{2})"


def tolerant_timestamp(c: Column) -> Column:
    """A date from loose text, null where there is none.

    Words for no date and text without digits are null; a range gives its start; a year or month its first day;
    then the formats in order; at last the first ISO date inside the text. An impossible month or day is null.
    """
    s = F.trim(c)
    s = F.when((s == "") | F.upper(s).isin(*vocab.NO_DATES) | ~s.rlike(r"\d"), F.lit(None)).otherwise(s)
    start = F.regexp_extract(s, r"^" + ISO_DATE + r"\s*(?:to|/)\s*\d{4}-\d{2}-\d{2}", 1)
    s = F.when(start != "", start).otherwise(s)
    parse = lambda x, f: F.try_to_timestamp(x, F.lit(f))
    year = F.when(s.rlike(r"^\d{4}$"), parse(F.concat(s, F.lit("-01-01")), FORMATS[0]))
    month = F.when(s.rlike(r"^\d{4}-\d{2}$"), parse(F.concat(s, F.lit("-01")), FORMATS[0]))
    inside = F.regexp_extract(s, ISO_DATE, 1)
    return F.coalesce(year, month, *[parse(s, f) for f in FORMATS], F.when(inside != "", parse(inside, FORMATS[0])))


def market_session(ts: Column) -> Column:
    """closed on weekends, pre_market before 9:15, regular before 15:30, else post_market."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    return F.when(F.weekday(ts) >= 5, "closed").when(minute < 9 * 60 + 15, "pre_market").when(minute < 15 * 60 + 30, "regular").when(ts.isNotNull(), "post_market")


def trading_day(ts: Column) -> Column:
    """The day, or the Monday after a weekend day."""
    day = F.to_date(ts)
    return F.when(F.weekday(ts) == 5, F.date_add(day, 2)).when(F.weekday(ts) == 6, F.date_add(day, 1)).otherwise(day)


def duration_seconds(start: Column, end: Column) -> Column:
    return F.unix_timestamp(end) - F.unix_timestamp(start)


def add_observation(dates: Column, new: Column) -> Column:
    """Distinct observation times in order, with the new one."""
    return F.array_sort(F.array_distinct(F.array_append(F.coalesce(dates, F.array().cast("array<timestamp>")), new)))


def percent_change(start: Column, end: Column) -> Column:
    return F.when(start != 0, (end - start) / start * 100)


def relative_label(ts: Column, now: Column) -> Column:
    """Just now, or minutes, hours or days ago."""
    m = F.floor((F.unix_timestamp(now) - F.unix_timestamp(ts)) / 60)
    h = F.floor(m / 60)
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return F.when(m < 1, "Just now").when(m < 60, ago(m, "m")).when(h < 24, ago(h, "h")).otherwise(ago(F.floor(h / 24), "d"))


def temporal_filter(after: str | None = None, before: str | None = None) -> Column:
    """Edges announced or effective from ``after`` on and up to ``before``; compared as strings, a null is no match."""
    keep = F.lit(True)
    if after:
        keep = keep & ((F.col("t_announce") >= after) | (F.col("t_effective") >= after))
    if before:
        keep = keep & ((F.col("t_announce") <= before) | (F.col("t_effective") <= before))
    return keep
