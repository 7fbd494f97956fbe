import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from terrastrata.llm import mixing as M


def fill(members, given):
    """Water filling by repeated capping: members name -> (capacity, weight)."""
    out, rest = {}, dict(members)
    while rest:
        w = sum(x[1] for x in rest.values())
        if w <= 0:
            return out | dict.fromkeys(rest, 0.0)
        full = {k: c for k, (c, v) in rest.items() if v > 0 and c < given * v / w - 1e-9}
        if not full:
            return out | {k: given * v / w for k, (c, v) in rest.items()}
        out |= full
        given -= sum(full.values())
        rest = {k: v for k, v in rest.items() if k not in full}
    return out


def brute(docs, total, weights, epochs):
    """docs: (doc_id, domain, lang, source, tokens) -> budgets by leaf."""
    leaf = defaultdict(int)
    for _, *path, n in docs:
        leaf[tuple(path)] += n

    def weight(p):
        return max(0.0, weights.get("/".join(p), weights.get("/".join(["*"] * (len(p) - 1) + [p[-1]]), 1.0) if len(p) > 1 else 1.0))

    def cap(p):
        return sum(n * epochs for q, n in leaf.items() if q[: len(p)] == p and all(weight(q[:k]) > 0 for k in (1, 2, 3)))

    out = {}

    def down(p, given):
        if len(p) == 3:
            out[p] = given
            return
        kids = {q[: len(p) + 1] for q in leaf if q[: len(p)] == p}
        got = fill({k: (cap(k), weight(k)) for k in kids}, min(given, cap(p)))
        for k, v in got.items():
            down(k, v)

    down((), total)
    return out, dict(leaf)


def table(spark, rows):
    return spark.createDataFrame([(i, d, la, s, " ".join(["w"] * n) if n is not None else None, 9) for i, d, la, s, n in rows], "doc_id long, domain string, lang string, source string, text string, epochs int")


def test_budgets_and_prefixes(spark):
    r = random.Random(3)
    rows = [(i, f"d{min(r.randrange(6), 2)}", r.choice(["en", "en", "fr"]), f"s{min(r.randrange(9), 3)}", r.choice([0, 1, 5, 30, 200])) for i in range(700)]
    df = table(spark, rows)
    for total, weights, epochs in ((5_000, {}, 1), (30_000, {"d0": 3.0, "*/fr": 0.2, "d1/en/s1": 9.0}, 1), (90_000, {"d0": 5.0, "*/*/s0": 0.0, "d2/fr": 4.0}, 3), (10**9, {}, 2), (0, {}, 1)):
        want, tokens = brute(rows, total, weights, epochs)
        _, leaves = M.plan(df, total=total, weights=weights, max_epochs=epochs)
        got = {(x.domain, x.lang, x.source): x for x in leaves.collect()}
        assert got.keys() == want.keys()
        for k, x in got.items():
            assert abs(x.budget - want[k]) < 1e-3, (k, x.budget, want[k])
        picked = defaultdict(list)
        for x in M.mixed(df.drop("epochs"), total=total, weights=weights, max_epochs=epochs).collect():
            picked[x.domain, x.lang, x.source].append((x.doc_id, x.epoch, len(x.text.split())))
        for k, x in got.items():
            got_tokens = sum(n for _, _, n in picked[k])
            whole = int(want[k] + 1e-6)
            assert got_tokens <= whole and (got_tokens > whole - 200 or got_tokens == tokens[k] * epochs), (k, got_tokens, whole)
            assert x.epochs == (min(epochs, whole // tokens[k]) if tokens[k] else 0)
            for e in range(x.epochs):
                assert {d for d, ep, _ in picked[k] if ep == e} == {i for i, *p, _ in rows if tuple(p) == k}


def test_prefix_is_the_longest_that_fits(spark):
    df = table(spark, [(i, "d", "en", "s", 1 + i % 7) for i in range(3000)])
    _, leaves = M.plan(df, total=5_000, weights={}, max_epochs=1)
    leaf = leaves.first()
    order = df.withColumn("epochs", F.lit(0).cast("long")).select((F.size(F.split("text", " "))).alias("n"), M.order_of(3).alias("u")).orderBy("u").collect()
    run, last = 0, None
    for x in order:
        run += x.n
        if run > 5_000:
            break
        last = x.u
    assert [x.u for x in order if x.u <= leaf.cut_at][-1] == last


def test_leaves_without_broadcast(spark, monkeypatch):
    df = table(spark, [(i, "d", "en", f"s{i % 3}", 1 + i % 7) for i in range(300)]).drop("epochs")
    few = sorted(x.doc_id for x in M.mixed(df, fraction=0.5, max_epochs=1).collect())
    monkeypatch.setattr(M, "MOST_BROADCAST", -1)
    assert sorted(x.doc_id for x in M.mixed(df, fraction=0.5, max_epochs=1).collect()) == few and 80 < len(few) < 220


def test_budget_ends_in_the_first_slice(spark):
    df = spark.range(30_000).selectExpr("id as doc_id", "'d' as domain", "'en' as lang", "'s' as source", "'a b c d e' as text")
    assert M.mixed(df, total=3, weights={}, max_epochs=1).collect() == []


def test_query_nulls_and_no_rows(spark, docs_of, saved):
    docs = docs_of(["a b c d e f", None, "", "a " * 5000, "x y z"] * 8).withColumn("source", F.when(F.col("doc_id") % 5 == 0, None).otherwise(F.col("source")))
    rows = M.op3_source_mixing(spark, saved(documents=docs)).collect()
    assert len(rows) == 40 and {x.source for x in rows} == {"?", "src0", "src1", "src2"} and all(x.domain == f"d{zlib.crc32(x.source.encode()) % 4}" for x in rows)
    assert sum(x.copies * x.tokens for x in rows) <= 0.8 * sum(x.tokens for x in rows) + 1
    assert M.op3_source_mixing(spark, saved(documents=docs.limit(0))).collect() == []
    twice = M.mixed(docs_of(["a b", "a b", "c"], [1, 1, 2]), fraction=0.5, max_epochs=1).collect()
    assert len(twice) <= 2
