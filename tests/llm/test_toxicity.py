import math
import random
import zlib

import pytest

from terrastrata.llm import toxicity as T

INSULTS = ["scoundrel", "rotten", "dimwit", "weasel"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automata_equal_brute_force():
    r = random.Random(6)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(0, 7)))
    terms = sorted({word() for _ in range(40)} - {""})
    trie = T.Trie(terms)
    for _ in range(1500):
        w, k = word(), r.randint(0, 2)
        want = min(((distance(w, t), t) for t in terms), default=None)
        assert trie.within(w, k) == ((want[1], want[0]) if want[0] <= k else None), (w, k)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(400)]
    texts, toxic = [], []
    for i in range(900):
        t = [r.choice(words) for _ in range(r.randint(20, 200))]
        bad = i % 6 == 0
        for _ in range(r.randint(2, 4) if bad else 0):
            t[r.randrange(len(t))] = r.choice(INSULTS)
        texts.append(" ".join(t))
        toxic.append(int(bad))
    return texts, toxic


def test_held_out_accuracy(spark, docs_of, saved, corpus):
    texts, toxic = corpus
    labels = spark.createDataFrame([(i, 0, t) for i, t in enumerate(toxic)] + [(5000, 1, 1), (None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    more = [None, "", "scoundrell " * 3, "dimwitt rottten weasle"]
    df = T.op5_toxicity(spark, saved(documents=docs_of(texts + more), labels=labels))
    assert df.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    got = {x.doc_id: x for x in df.collect()}
    assert len(got) == len(texts) + len(more)
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and x.predicted == (x.score >= 0.5) and 0 <= x.score <= 1 for i, x in got.items())
    held = [i for i in range(len(texts)) if got[i].held_out]
    assert sum(got[i].predicted == toxic[i] for i in held) >= 0.98 * len(held)
    assert [got[len(texts) + i].predicted for i in range(3)] == [0, 0, 1]


def test_quotation_counts_apart():
    s = T.Scorer(T.Model(("scoundrel", "vile*", "gnarl**"), frozenset(), (-1.0, 3.0, 3.0, 3.0, 3.0, 0.0, 0.0, 0.0), 0.1))
    assert s.score("you scoundrel") > 0.5 > s.score('he heard "you scoundrel" twice') and s.score("she wrote scoundrel there") < 0.5
    assert not any(s.features("")) and not any(s.features("x" * 100_000))
    assert s.features("scoundrel")[0] > 0 and not any(s.features("scoundrle")) and s.features("scoundrl")[3] > 0
    assert s.features("vilest, viler")[1] > s.features("vilest")[1] > 0 and not any(s.features("vile"))
    assert s.features("gnarly gnarls")[2] > 0 == s.features("gnarly gnarly")[2]


def test_stems_are_learned():
    assert T.tokens("Abcdef abcdxy") >= {"abcdef", "abcd*", "abcd**", "abcde*"} and "abcde**" not in T.tokens("Abcdef abcdxy")
    docs = [(1.0, ["mean", "vile*", "viles*"])] * 5 + [(1.0, ["vile*"])] * 5
    assert T.chosen(docs, {"mean": 50.0, "vile*": 50.0, "viles*": 50.0}, 1.5) == ["mean", "vile*"]
    many = [(1.0, [f"{w}a" for w in map(str, range(k, k + 3))]) for k in range(300)]
    assert len(T.chosen(many, {f"{k}a": 9.0 for k in range(302)}, 1.0)) > 200


def test_chance_bounds_the_binomial_tail():
    for n in (1, 5, 20):
        for k in range(n + 1):
            tail = sum(math.comb(n, x) * 0.2**x * 0.8 ** (n - x) for x in range(k, n + 1))
            assert tail <= T.chance(k, n - k, 20.0, 80.0) + 1e-12


def test_quotation_needs_a_pair_within_the_window():
    s = T.Scorer(T.Model(("scoundrel",), frozenset(), (-1.0, 3.0, 2.0, 0.0, 0.0, 0.0), 0.1))
    plain = s.features("you are a scoundrel here")
    assert s.features('12" you are a scoundrel here, 3" wide')[0] == plain[0] > 0
    assert s.features('he: "you scoundrel" there')[:3] == [0.0, 0.0, math.log1p(1)]
    assert s.features('"a long speech of many words goes on and on before a scoundrel comes in it and it never ends here"')[0] > 0
    assert s.features('"one" scoundrel "two"')[0] > 0 and s.features('"open\nscoundrel" next')[0] > 0


def test_digits_between_letters_and_words_of_stems():
    s = T.Scorer(T.Model(("scoundrel", "vile*"), frozenset(), (0.0,) * 7, 0.1, ("vileness",)))
    assert s.features("scoundr3l")[2] > 0 == s.features("scoundr33l")[2]
    assert s.features("vilfness")[2] > 0 and s.features("vileness")[1] > 0 == s.features("vileness")[2]


def test_rare_long_and_copied_terms_are_learned(spark, docs_of):
    """No cap on the lexicon: a hundred and more insults, one of 45 letters, and one that only a group of copies holds."""
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcdefghilmnoprstu") for _ in range(n))
    words, insults = [word(r.randint(2, 8)) for _ in range(300)], [word(9) for _ in range(110)] + ["x" + word(44)]
    texts, toxic = [], []
    for i in range(9500):
        t = [r.choice(words) for _ in range(30)]
        if i % 5 == 0:
            t[r.randrange(30)] = insults[i // 5 % len(insults)]
        texts.append(" ".join(t))
        toxic.append(int(i % 5 == 0))
    copied = " ".join([*(r.choice(words) for _ in range(20)), "copiedinsult", *(r.choice(words) for _ in range(20))])
    texts += [copied] * 900
    toxic += [1] * 900
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    model = T.fit(docs_of(texts), labels)
    scorer = T.Scorer(model)
    found = [w for w in insults if scorer.score(f"some {w} here") >= 0.5]
    assert len(model.terms) > 100 and len(found) >= 0.95 * len(insults) and insults[-1] in found, (len(model.terms), len(found))
    assert scorer.score(copied) >= 0.5 > scorer.score("plain text here")


def test_repeated_rows_and_clashing_columns(spark, docs_of):
    docs = docs_of(["you scoundrel", "you scoundrel", None], ids=[1, 1, None]).withColumnRenamed("fp", "score")
    model = T.Model(("scoundrel",), frozenset(), (-1.0, 3.0, 2.0, 0.0, 0.0, 0.0), 0.1)
    got = T.scored(docs, model)
    assert got.columns == [*(c for c in docs.columns if c != "score"), "score", "predicted"]
    assert sorted((x.doc_id or 0, x.predicted) for x in got.collect()) == [(0, 0), (1, 1), (1, 1)]


def test_no_labels_and_no_rows(spark, docs_of, saved):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(x.score, x.predicted) for x in T.op5_toxicity(spark, saved(documents=docs_of(["a", None]), labels=none)).collect()} == {(0.0, 0)}
    assert T.op5_toxicity(spark, saved(documents=docs_of(["x"]).limit(0), labels=none)).collect() == []
