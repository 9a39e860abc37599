"""Every registered query against its SQL on the same tables."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def views(data):
    c = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, data, views, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    mine = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    found = views.execute(ORACLE[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert mine == sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns
    df.count()


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 3 and all(0 < r["score"] <= 1 for r in rows)
