import random

import numpy as np
import xxhash

from terrastrata.llm import simhash as S


def slow_print(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    import re

    w = re.findall("[^\x20\x09-\x0d]+", w)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(texts):
    fp = [slow_print(t) for t in texts]
    part = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if bin(fp[i] ^ fp[j]).count("1") <= 2:
                    part[i] = min(part[i], part[j])
    return {i: (f"{fp[i]:016x}", part[i]) for i in range(len(texts))}


def test_query_equals_brute_force(spark, docs_of, saved):
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", "Ä b", "ä B", "A b", " \t\n\x0b", "one two three", "ONE TWO THREE"]
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.randint(60, 400))]
        for _ in range(6):
            t = list(base)
            for _ in range(r.randint(0, 2)):
                t[r.randrange(len(t))] = r.choice(words)
            texts.append(" ".join(t))
    texts += [" ".join(r.choice(words) for _ in range(40_000)), "x" * 100_000] + ["one two three"] * 40
    want = brute(texts)
    got = S.op6_simhash_near_dedup(spark, saved(documents=docs_of(texts)))
    rows = got.collect()
    assert got.columns[:3] == ["doc_id", "fingerprint", "component_id"] and len(rows) == len(texts)
    assert {x.doc_id: (x.fingerprint, x.component_id) for x in rows} == want
    assert any(want[i][1] != i and want[i][0] != want[want[i][1]][0] for i in want), "no near link in the test"


def test_empty_table(spark, docs_of, saved):
    assert S.op6_simhash_near_dedup(spark, saved(documents=docs_of(["x"]).limit(0))).collect() == []


def test_links_on_planted_bits(spark):
    r = random.Random(1)
    fps = {r.getrandbits(64) for _ in range(200)}
    for f in list(fps)[:60]:
        a, b, c = r.sample(range(64), 3)
        fps |= {f ^ 1 << a ^ 1 << b} if r.random() < 0.7 else {f ^ 1 << a ^ 1 << b ^ 1 << c}
    fps = [int(np.uint64(x).astype(np.int64)) for x in fps]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = {x.fp for x in S.candidates(df).collect()}
    near = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 2
    assert {f for f in fps if any(near(f, g) for g in fps if f != g)} <= found
    from terrastrata.llm.common import connected_components

    parts = {x.node: x.component for x in connected_components(S.verified_stars(df)).collect()}
    part = {f: f for f in fps}
    for _ in range(4):
        for f in fps:
            part[f] = min(part[g] for g in fps if near(f, g))
    assert {f: parts.get(f, f) for f in fps} == part


def components(n, pairs):
    part = list(range(n))
    for _ in range(n):
        new = list(part)
        for a, b in pairs:
            new[a] = new[b] = min(new[a], new[b])
        if new == part:
            return part
        part = new
    return part


def test_forest_spans_all_links():
    r = np.random.default_rng(2)
    for n in (2, 30, 64, 65, 400):
        base = r.integers(0, 2**63, (max(1, n // 40), 8), dtype=np.uint64)
        fps = base[r.integers(0, len(base), n)]
        for _ in range(n * 30):
            fps[r.integers(0, n), r.integers(0, 8)] ^= np.uint64(1) << np.uint64(r.integers(0, 63))
        d = S.differing(fps, fps)
        for most in (20, 60, 100):
            want = components(n, [(i, j) for i in range(n) for j in range(i) if d[i, j] <= most])
            got = S.nearest_forest(fps, most)
            assert components(n, got) == want and all(d[i, j] <= most for i, j in got) and len(got) == n - len(set(want))


def slow_similar(texts, k=5, least=0.8):
    sets = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return components(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])])


def test_similar_components(spark, docs_of):
    r = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    texts = [None, "", "  ", "a b", "A  b", "a b c d e"]
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.randint(80, 400))]
        for e in (0, 0.002, 0.005, 0.01, 0.015, 0.06):
            texts.append(" ".join(r.choice(words) if r.random() < e else w for w in base))
    want = slow_similar(texts)
    df = docs_of(texts)
    got = {x.doc_id: x.component_id for x in S.similar_components(df).collect()}
    assert sum(got[i] != want[i] for i in range(len(texts))) <= 0.03 * len(texts) and sum(w != i for i, w in enumerate(want)) > 60
    assert len({got[i] for i in range(3)}) == 1 and got[3] == got[4] == 3
    left = S.one_of_each(df)
    assert left.columns == df.columns and sorted(x.doc_id for x in left.collect()) == sorted(i for i, c in got.items() if i == c)


def test_one_of_each_without_broadcasts(spark, docs_of, monkeypatch):
    monkeypatch.setattr(S, "MOST_BROADCAST", -1)
    texts = [" ".join(f"w{i % 7}{j}" for j in range(60)) for i in range(20)] + [None]
    assert sorted(x.doc_id for x in S.one_of_each(docs_of(texts)).collect()) == [*range(7), 20]


def test_one_of_each_repeats_nulls_and_no_rows(spark, docs_of):
    df = docs_of(["same text", "same text", "same text", "same text", "other"], [4, 4, None, None, 9])
    assert sorted((x.doc_id or 0, x.text) for x in S.one_of_each(df).collect()) == [(0, "same text"), (0, "same text"), (4, "same text"), (9, "other")]
    assert S.one_of_each(df.limit(0)).collect() == []
    assert S.one_of_each(docs_of(["x " * 50_000, "x " * 50_000])).count() == 1


def crowd(n, pairs, seed=3):
    """Texts of 353 shingles at 0.74 of each other; of the first ones, each has a copy at 0.81 to 0.85 at the end."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(10**9)}"
    shared = [word() for _ in range(304)]
    own = [[word() for _ in range(53)] for _ in range(n)]
    own += [x[: 53 - c] + [word() for _ in range(c)] for x in own[:pairs] for c in [r.randint(29, 37)]]
    return [" ".join(shared + x) for x in own]


def test_links_in_a_crowd_of_nearly_similar_texts(spark, docs_of, monkeypatch):
    texts = crowd(600, 40)
    want = slow_similar(texts)
    assert want == [*range(600), *range(40)]
    df = docs_of(texts)
    assert {x.doc_id: x.component_id for x in S.similar_components(df).collect()} == dict(enumerate(want))
    monkeypatch.setattr(S, "PART_SETS", 100)
    monkeypatch.setattr(S, "MOST_BROADCAST", -1)
    assert {x.doc_id: x.component_id for x in S.similar_components(df).collect()} == dict(enumerate(want))


def test_exact_links_equal_brute_force():
    r = random.Random(6)
    for few in (2, 32):
        S.FEW, before = few, S.FEW
        sets = [np.array(sorted(r.sample(range(40), r.randint(8, 36))), dtype=np.int64) for _ in range(200)]
        sets += [np.unique(np.append(x[2:], r.randrange(40))) for x in sets[:40]]
        labels = [i - i % 3 for i in range(len(sets))]
        near = [(i, j) for i in range(len(sets)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
        got = S.exact_links(sets, labels, 0.8)
        S.FEW = before
        same = [(i, labels[i]) for i in range(len(sets))]
        assert components(len(sets), got + same) == components(len(sets), near + same) and len(near) > 20


def test_likely_edges_are_a_range_join_of_short_words(spark, monkeypatch):
    r = np.random.default_rng(4)
    base = r.integers(0, 2**64, (40, S.ALL_WORDS), dtype=np.uint64)
    prints = base[np.arange(400) % 40]
    for k in range(400):  # 4 to 20 % of the bits differ; some rows agree in no short word and are within two bits in one
        for b in r.permutation(S.ALL_WORDS * 64)[: r.integers(20, 100)]:
            prints[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    prints = np.concatenate([prints, np.repeat(base[:1], 700, axis=0)])
    short, most = S.short_words(prints), S.limit_of(0.8)
    n = len(prints)
    assert short.shape == (n, 12) and short.min() >= 0 and short.max() < 1 << 21
    apart = np.bitwise_count(short[:, None] ^ short[None]).min(axis=2)
    near = (apart <= 2) & (S.differing(prints[:, : S.WORDS_64], prints[:, : S.WORDS_64]) <= most)
    pairs = lambda m: [(i, j) for i, j in zip(*np.nonzero(np.tril(m, -1)), strict=True)]
    want = components(n, pairs(near))
    assert want != components(n, pairs(near & (apart == 0)))
    df = spark.createDataFrame([(k, prints[k, : S.WORDS_64].tobytes(), short[k].tolist()) for k in range(n)], "rep long, fp binary, short array<long>")
    for few, group in ((512, None), (3, None), (512, 100)):
        monkeypatch.setattr(S, "FEW_PRINTS", few)
        got = [(x.a, x.b) for x in S.likely_edges(df, most, group).collect()]
        assert components(n, got) == want and all(near[a, b] and a > b for a, b in got)


def test_recall_of_likely_links():
    """Prints of sets at a similarity of exactly 0.8: at least 0.99 are likely links."""
    r, n = np.random.default_rng(9), 2000
    a, b = [], []
    for _ in range(n):
        x = r.integers(0, 2**63, 100, dtype=np.uint64)
        a.append(S.long_print(x[:90]))
        b.append(S.long_print(x[10:]))
    a, b = np.stack(a), np.stack(b)
    near = np.bitwise_count(S.short_words(a) ^ S.short_words(b)).min(axis=1) <= 2
    near &= np.bitwise_count(a[:, : S.WORDS_64] ^ b[:, : S.WORDS_64]).sum(axis=1) <= S.limit_of(0.8)
    assert near.mean() >= 0.99


def test_few_links_of_each_node_are_verified(spark):
    likely = spark.createDataFrame([(a, b, abs(a - b)) for a in range(300) for b in range(a)], "a long, b long, d long")
    got = sorted((x.a, x.b) for x in S.few_edges(likely).collect())
    assert got == sorted({(a, b) for a in range(1, 300) for b in (0, a - 1)})
