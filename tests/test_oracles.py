"""Every query of the reference's operators against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from seqscope.plans import FLAGSHIP_SQL, QUERIES, SQL, flagship

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows(frame):
    out = []
    for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False):
        cell = lambda v: None if pd.api.types.is_scalar(v) and pd.isna(v) else round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
        out.append(tuple(map(cell, row)))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_flagship(spark, duck, sf_dir):
    assert rows(flagship(spark, sf_dir).toPandas()) == rows(duck.execute(FLAGSHIP_SQL).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs_and_repeats(spark, sf_dir, name):
    first = rows(QUERIES[name](spark, sf_dir).toPandas())
    assert first
    assert first == rows(QUERIES[name](spark, sf_dir).toPandas())
