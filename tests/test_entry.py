"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__
from terrastrata.plans import queries as Q

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    if not DATA.is_dir():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, db, name):
    df = Q.QUERIES[name](spark, str(DATA))
    rel = db.sql(Q.SQL[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    tidy = lambda rows, cols: sorted((tuple(r[cols.index(c)] + 0.0 if isinstance(r[cols.index(c)], float) else r[cols.index(c)] for c in names) for r in rows), key=repr)
    assert tidy([tuple(r) for r in df.collect()], df.columns) == tidy(rel.fetchall(), list(rel.columns))


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_query_has_rows(spark, name):
    if not DATA.is_dir():
        pytest.skip("no test tables")
    assert Q.QUERIES[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 25 if DATA.is_dir() else True
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and len(Q.SQL) >= 60
