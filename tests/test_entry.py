"""The entry module, and queries against their SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from kinelake.plans.registry import ORACLE, QUERIES
from tests.conftest import DATA, requires_data

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    def cell(v):
        if v is None or v is pd.NA or v != v:
            return None
        return round(float(v), 5) + 0.0 if isinstance(v, float) else (int(v) if hasattr(v, "dtype") and v.dtype.kind in "iu" else v)

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(cell, r)) for r in frame.astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@requires_data
def test_flagship(spark):
    assert entry.entry(spark).limit(1).count() == 1


@requires_data
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, db, name):
    mine, theirs = QUERIES[name](spark, DATA).toPandas(), db.sql(ORACLE[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert len(mine) == len(theirs)
    for a, b in zip(rows(mine), rows(theirs), strict=True):
        assert all(x == y or (isinstance(x, float) and y is not None and abs(x - y) <= 2e-5 * max(1, abs(x))) for x, y in zip(a, b, strict=True)), (a, b)


def test_queries_without_sql_are_tested_by_themselves():
    from tests.test_kernel_queries import TESTED

    assert set(QUERIES) - set(ORACLE) == TESTED
