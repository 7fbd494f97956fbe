import hashlib
import random
import re

from pyspark.sql import functions as F

from terrastrata.llm import fingerprints as P


def paragraphs(text):
    return {p for p in re.split(r"\n|(?<=[.!?]) ", text) if p.strip(" ")}


def jaccard(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edit(text, following):
    h = len(text) // 2
    return text[: len(text) - h] + following[:h]


def texts():
    r = random.Random(12)
    lines = [f"line {i} é😀." for i in range(60)]
    ts = ["\n".join(r.choice(lines) for _ in range(r.randint(0, 30))) for _ in range(120)]
    ts += [None, "", " \n ", "x", "same", "same", "a. " * 400, "\n".join(f"p{i}" for i in range(400)), "\n".join(f"q{i}" for i in range(390)), "w" * 60_000]
    return ts


def test_query_equals_brute_force(spark, docs_of, saved, monkeypatch):
    monkeypatch.setattr(P, "RANGE_DOCS", 10)
    ts = texts()
    ids = random.Random(1).sample(range(-500, 10_000), len(ts))
    df = P.op1_document_fingerprints(spark, saved(documents=docs_of(ts, ids)))
    assert df.columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    every = sorted({p for t in ts for p in paragraphs(t or "")})
    digest = dict(spark.createDataFrame([(p,) for p in every], "p string").select("p", F.xxhash64("p")).collect())
    rows = {x.doc_id: x for x in df.collect()}
    order = sorted(range(len(ts)), key=lambda i: ids[i])
    assert len(rows) == len(ts)
    for k, i in enumerate(order):
        t, f = ts[i] or "", ts[order[(k + 1) % len(ts)]] or ""
        e, x = edit(t, f), rows[ids[i]]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert abs(x.near_edited - jaccard(t, e)) < 1e-12 and abs(x.near_next - jaccard(t, f)) < 1e-12, (t[:50], x)
        was, now = paragraphs(t), paragraphs(e)
        assert set(x.lost) == {digest[p] for p in was - now} and len(x.gained) == len(now - was) and {digest[p] for p in now - was if p in digest} <= set(x.gained)
        assert 1 <= x.tries_edited <= P.RETRIES + 2 and 1 <= x.tries_next <= P.RETRIES + 2
    same = {}
    for i, t in enumerate(ts):
        assert same.setdefault(t or "", rows[ids[i]].fingerprint) == rows[ids[i]].fingerprint


def test_repeats_nulls_and_no_rows(spark, docs_of, saved):
    rows = P.op1_document_fingerprints(spark, saved(documents=docs_of(["b", "a", "c", None], [1, 1, None, 2]))).collect()
    got = sorted((x.doc_id is not None, x.doc_id, x.edited_sha256) for x in rows)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(got) == 4 and {g[2] for g in got} == {sha("c"), sha("a"), sha("b"), sha("")}
    assert [x.near_next for x in P.op1_document_fingerprints(spark, saved(documents=docs_of(["only one"]))).collect()] == [1.0]
    assert P.op1_document_fingerprints(spark, saved(documents=docs_of(["x"]).limit(0))).collect() == []


def test_a_shared_id_is_split(spark, docs_of, monkeypatch):
    """Many rows of one id fall into many ranges, and each still meets the next by hash and text."""
    monkeypatch.setattr(P, "RANGE_DOCS", 10)
    ts = [f"text {i}" for i in range(400)]
    rows = P.next_texts(docs_of(ts, [None if i % 2 else 7 for i in range(400)])).collect()
    following = {x.text: x.next_text for x in rows}
    at, seen = ts[0], []
    for _ in ts:
        seen.append(at)
        at = following[at]
    assert at == ts[0] and sorted(seen) == sorted(ts)
    ids = [dict((x.text, x.doc_id) for x in rows)[t] for t in seen]
    assert sum(a != b for a, b in zip(ids, ids[1:] + ids[:1], strict=True)) == 2


def test_one_added_letter_in_a_long_line_leaves_the_rest(spark):
    line = " ".join(f"Sentence number {i} ends." for i in range(40))
    for n in (500, 512, 513, 900):
        a = line[:n]
        both = spark.createDataFrame([(a, a[:3] + "x" + a[3:])], "a string, b string").select(P.digests(F.col("a")).alias("a"), P.digests(F.col("b")).alias("b")).first()
        assert len(set(both.a) & set(both.b)) == len(both.a) - 1


def test_clashing_columns(spark, docs_of):
    got = P.fingerprinted(docs_of(["a", None]).withColumn("fp_n", F.lit("x")).withColumn("text", F.coalesce("text", F.lit(""))))
    assert got.columns.count("fp") == got.columns.count("fp_n") == 1 and sorted(x.fp_n for x in got.collect()) == [0, 1]


def test_peeling_fails_and_larger_sketches_recover(spark):
    rows = [(list(range(n)), list(range(n // 2, n + m))) for n, m in ((0, 0), (5, 5), (40, 10), (3000, 0), (0, 900), (2000, 100))]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>").select(*(F.transform(c, lambda d: F.xxhash64(d)).alias(c) for c in "ab"))
    df = df.withColumn("sa", P.sketch(F.col("a"))).withColumn("sb", P.sketch(F.col("b")))
    got = df.select("a", "b", P.differences(F.col("a"), F.col("b"), F.col("sa"), F.col("sb")).alias("d")).collect()
    for x in got:
        assert (set(x.d.more), set(x.d.less)) == (set(x.a) - set(x.b), set(x.b) - set(x.a)) and x.d.more == sorted(x.d.more)
    assert [x.d.tries for x in got][:3] == [1] * 3 and all(2 <= x.d.tries < P.RETRIES + 2 for x in got[3:])
