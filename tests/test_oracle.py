"""Every registered query of the library runs, and gives what its SQL gives."""

import duckdb
import pandas as pd
import pytest

from factorloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
        return ""
    if isinstance(x, int | float) and not isinstance(x, bool):
        return repr(round(float(x), 5) + 0.0)
    return str(x)


def near(x, y):
    """Rows alike but for a last digit of a number that is rounded the other way."""
    number = lambda v: float(v) if v.replace(".", "").replace("-", "").replace("e", "").replace("+", "").isdigit() else None
    return all(a == b or (number(a) is not None and number(b) is not None and abs(float(a) - float(b)) <= 2e-5 * max(1, abs(float(a)))) for a, b in zip(x, y, strict=True))


def rows(df, columns):
    return sorted(tuple(plain(x) for x in r) for r in df[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, con, name):
    ours, theirs = QUERIES[name](spark, sf).toPandas(), con.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    a, b = rows(ours, columns), rows(theirs, columns)
    assert len(a) == len(b)
    different = [(x, y) for x, y in zip(a, b, strict=True) if x != y and not near(x, y)]
    assert not different, different[:3]


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() > 0
