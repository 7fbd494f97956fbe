import random

import duckdb

from terrastrata.llm import line_dedup as L


def brute(texts):
    first, gone = {}, [set() for _ in texts]
    cut = [None if t is None else t.split("\n") for t in texts]
    for d, ls in enumerate(cut):
        for i in range(len(ls or []) - 2):
            w = tuple(ls[i : i + 3])
            if all(x.strip(" ") == "" for x in w):
                continue
            if w not in first:
                first[w] = (d, i)
            elif not (first[w][0] == d and i < first[w][1] + 3):
                gone[d] |= {i, i + 1, i + 2}
    return [(len(g), ",".join(map(str, sorted(g))), t if not g else "\n".join(x for i, x in enumerate(ls) if i not in g)) for t, ls, g in zip(texts, cut, gone, strict=True)]


def texts():
    r = random.Random(7)
    ts = ["\n".join(r.choice(["a", "b", "c", "", " ", "é"]) for _ in range(r.randint(0, 12))) for _ in range(150)]
    passage = "\n".join(f"shared line {i}" for i in range(6))
    ts += [f"own {i}\n{passage}\nend {i}" for i in range(50)] + ["same\n" * 10, "\n" * 5, None, "", "x", "long line " * 20_000 + "\na\nb", "\n".join(f"l{i % 400}" for i in range(3000))]
    return ts


def test_query_and_sql_equal_brute_force(spark, docs_of, saved):
    ts = texts()
    d = saved(documents=docs_of(ts))
    df = L.op8_line_dedup(spark, d)
    want = {i: x for i, x in enumerate(brute(ts))}
    assert {x.doc_id: tuple(x)[1:] for x in df.collect()} == want
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS FROM '{d}/documents.parquet/*.parquet'")
    cols = ["doc_id", "n_dropped", "dropped_lines", "text"]
    assert {x[0]: x[1:] for x in duckdb.sql(L.SQL).project(", ".join(cols)).fetchall()} == want


def test_columns_repeats_and_no_rows(spark, docs_of, saved, monkeypatch):
    monkeypatch.setattr(L, "MOST_BROADCAST", -1)
    passage = "p1\np2\np3"
    df = docs_of([passage, f"{passage}\nx", passage, f"{passage}\ny"], [1, 2, 1, None]).withColumnRenamed("fp", "covered")
    rows = sorted((x.doc_id or 0, x.text, x.n_chars) for x in L.deduped(df).collect())
    assert L.deduped(df).columns == [*df.columns, "dropped_lines"]
    assert rows == [(0, f"{passage}\ny", 10), (1, "", 0), (1, "", 0), (2, "x", 1)]
    assert L.op8_line_dedup(spark, saved(documents=docs_of(["x"]).limit(0))).collect() == []
