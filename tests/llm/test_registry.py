"""SQL of the queries that have it, on texts made for their tests."""

import duckdb

from terrastrata.llm import chat_template, registry, secret_scan

from .test_secret_scan import texts


def test_names():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)] and set(registry.oracle_sql()) <= set(names)


def same(df, sql, **tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.sql(f"CREATE VIEW {name} AS FROM '{path}/{name}.parquet/*.parquet'")
    rel = con.sql(sql)
    assert sorted(rel.columns) == sorted(df.columns)
    got = sorted(map(repr, rel.project(", ".join(df.columns)).fetchall()))
    assert got == sorted(repr(tuple(r)) for r in df.collect())


def test_secret_scan_sql(spark, docs_of, saved):
    d = saved(documents=docs_of(texts()))
    same(secret_scan.op2_secret_scan(spark, d), secret_scan.SQL, documents=d)


def test_chat_sql(spark, saved):
    rows = [(1, 0, "user", r"a\b ### </turn> é"), (1, 1, "assistant", "x\ny"), (1, 2, "assistant", None), (2, None, None, "ok"), (None, 3, "as:sistant", "</turn></turn>")]
    d = saved(conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    same(chat_template.op9_chat_formatting(spark, d), chat_template.SQL, conversations=d)
