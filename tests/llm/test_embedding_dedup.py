import math

import numpy as np

from terrastrata.llm import embedding_dedup as E


def brute(rows):
    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))

    ok = {i for i, (v, e, k) in enumerate(rows) if v is not None and k is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)}
    near = {i: [j for j in ok if j != i and i in ok and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and cos(rows[i][1], rows[j][1]) >= 0.93] for i in range(len(rows))}
    part = {i: rows[i][0] for i in range(len(rows))}
    for _ in rows:
        for i in near:
            for j in near[i]:
                part[i] = min(part[i], part[j])
    return near, part


def table(spark, saved, rows):
    return saved(embeddings=spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, links int"))


def test_query_against_brute_force(spark, saved):
    r = np.random.default_rng(3)
    rows, n = [], 0
    for _ in range(40):
        base = r.standard_normal(16)
        for _ in range(5):
            x = base + r.standard_normal(16) * r.choice([0.0, 0.05, 0.2, 0.25])
            rows.append((n, [float(np.float32(v)) for v in x], int(r.integers(0, 2))))
            n += 1
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] + [1.0] * 15, 1), (n + 3, [None] + [1.0] * 15, 1), (n + 4, rows[0][1], None), (None, rows[0][1], rows[0][2]), (n + 5, rows[0][1], rows[0][2]), (n + 6, rows[0][1][:8], rows[0][2]), (n + 7, [], 1), (n + 8, [1e30] * 16, 1), (n + 9, [1e-30] * 16, 1)]
    near, part = brute(rows)
    got = {x.vec_id: x for x in E.op7_embedding_near_dedup(spark, table(spark, saved, rows)).collect()}
    assert len(got) == len(rows) and got[None].n_links == 0 and not got[None].kept
    links = sum(x.n_links for x in got.values())
    want = sum(map(len, near.values()))
    assert want > 100 and 0.9 * want <= links <= want
    for i, (v, _, _) in enumerate(rows):
        if v is not None:
            assert got[v].n_links <= len(near[i]) and got[v].kept == (got[v].component_id == v)
    same = sum(got[v].component_id == part[i] for i, (v, _, _) in enumerate(rows) if v is not None)
    assert same >= 0.9 * len(rows)


def test_large_bucket_in_blocks(spark, saved):
    r = np.random.default_rng(4)
    base = r.standard_normal(8)
    rows = [(i, [float(x) for x in base + r.standard_normal(8) * 0.01], 1) for i in range(70)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = E.near_vectors(df, block=16).collect()
    assert all(x.n_links == 69 and x.component_id == 0 for x in got) and [x.vec_id for x in got if x.kept] == [0]


def test_empty_table(spark, saved):
    assert E.op7_embedding_near_dedup(spark, saved(embeddings=spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))).collect() == []
