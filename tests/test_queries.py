"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from gaugeworks import queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def tidy(v):
    if isinstance(v, float):
        return "None" if math.isnan(v) else f"{v:.4f}"
    return f"{v:.4f}" if type(v).__name__ == "Decimal" else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted([tidy(r[c]) for c in cols] for r in df.collect())
    if name not in queries.ORACLES:
        assert got
        return
    cur = duck.execute(queries.ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted([tidy(dict(zip(names, r, strict=True))[c]) for c in cols] for r in cur.fetchall())
    assert got == want
