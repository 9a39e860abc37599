"""The profile table: defaults, checks and who may see what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import schema


def with_defaults(rows: DataFrame) -> DataFrame:
    """New profiles with the values that an insert without them gets."""
    given = {"investor_type": "Retail", "risk_appetite": "Medium", "language": "en"}
    for c, v in given.items():
        rows = rows.withColumn(c, F.coalesce(c, F.lit(v)) if c in rows.columns else F.lit(v))
    return rows


def back_fill(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Known columns with their defaults where they are null, in one projection."""
    return rows.withColumns({c: F.coalesce(c, F.lit(v).cast(dict(rows.dtypes)[c])) for c, v in defaults.items() if c in rows.columns})


def inserted(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The table after new users arrive: each gets a row with the defaults, unless the id has one already; columns the
    table lacks are dropped, those an insert lacks are null."""
    rows = with_defaults(new).dropDuplicates(["id"]).join(stored.select("id"), "id", "left_anti")
    return stored.unionByName(rows.select(*[F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in stored.dtypes]))


def violations(rows: DataFrame) -> DataFrame:
    """Rows that break a check, with its name; a null passes, as it does in SQL."""
    bad = F.when(~F.col("investor_type").isin(*schema.INVESTOR_TYPES), "investor_type").when(~F.col("risk_appetite").isin(*schema.RISK_APPETITES), "risk_appetite")
    return rows.withColumn("check", bad).where("check is not null")


def visible_to(rows: DataFrame, user: str) -> DataFrame:
    """Row-level security: a user's own row, for reading and for writing alike."""
    return rows.where(F.col("id") == user)


def maybe_one(rows: DataFrame) -> dict | None:
    """The only row, or None; several rows are an error."""
    found = rows.limit(2).collect()
    if len(found) > 1:
        raise ValueError("more than one row")
    return found[0].asDict() if found else None


def update(rows: DataFrame, user: str, **values) -> DataFrame:
    """The table with a user's own row changed."""
    mine = F.col("id") == user
    return rows.withColumns({c: F.when(mine, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def columns(rows: DataFrame) -> list[tuple[str, str]]:
    """The catalog's view of the table."""
    return [(c, t) for c, t in rows.dtypes]
