import random
import zlib

import corpus_pipeline as C
from pyspark.sql import functions as F

from terrastrata.llm import pieces

from .test_line_dedup import brute as without_lines
from .test_simhash import slow_similar

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    r = random.Random(21)
    words = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(1500)]
    rows, bad = [], set()
    shared = "\n".join(" ".join(r.choice(words) for _ in range(25)) for _ in range(4))
    for i in range(400):
        t = [r.choice(words) for _ in range(r.randint(60, 200))]
        if i % 7 == 0:
            bad.add(i)
            for _ in range(4):
                t[r.randrange(len(t))] = r.choice(["scoundrel", "dimwit"])
        text = " ".join(t)
        if i % 5 == 1:
            text = text + "\n" + shared
        rows.append([i, text])
    for i in range(400, 460):
        src = rows[r.choice([j for j in range(1, 400) if j % 7 and j % 5 != 1])][1].split(" ")
        if i % 2:
            src[r.randrange(len(src))] = "changed"
        rows.append([i, " ".join(src)])
    rows += [[460, None], [461, ""]]
    return [(i, t, r.choice(["en", "de"]), f"src{r.choice([0, 0, 1])}", None if t is None else len(t)) for i, t in rows], bad


def test_stages_against_brute_force(spark, saved):
    rows, bad = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d = saved(documents=docs, labels=spark.createDataFrame([(i, 1, int(i in bad)) for i in range(400)], "doc_id long, quality int, toxic int"))
    assert len(C.STAGES) == 5 and [f.__name__ for _, f in C.STAGES][0] == "toxicity_stage"
    steps, at = [docs.collect()], docs
    for name, f in C.STAGES:
        at = f(spark, at, d)
        at = spark.createDataFrame(at.collect(), at.schema)
        steps.append(at.collect())
        if name != "sentencepiece":
            assert at.columns == COLUMNS
    kept = {x.doc_id for x in steps[1]}
    assert not kept & {i for i in bad if zlib.crc32(str(i).encode()) % 5 == 0} and kept >= {r[0] for r in rows} - bad
    before = sorted(steps[1], key=lambda x: x.doc_id)
    lines = without_lines([x.text for x in before])
    got = {x.doc_id: x for x in steps[2]}
    assert all(got[x.doc_id].text == t and got[x.doc_id].n_chars == (None if t is None else len(t)) for x, (_, _, t) in zip(before, lines, strict=True)) and sum(n for n, _, _ in lines) > 100
    before = sorted(steps[2], key=lambda x: x.doc_id)
    want = {before[i].doc_id for i, c in enumerate(slow_similar([x.text for x in before])) if i == c}
    assert {x.doc_id for x in steps[3]} == want and len(want) < len(before) - 30
    n = lambda x: len((x.text or "").split())
    assert 0.6 * sum(map(n, steps[3])) < sum(map(n, steps[4])) <= 0.8 * sum(map(n, steps[3])) and {x.doc_id for x in steps[4]} <= want
    p = pieces.Pieces(pieces.read_model(pieces.MODEL))
    assert len(steps[5]) == len(steps[4]) and all(pieces.decode(p, x.ids) == (x.text or "") and x.n_pieces == len(x.ids) for x in steps[5])
    whole = C.run(spark, d)
    assert {(x.doc_id, x.text, x.n_pieces) for x in whole.select("doc_id", "text", "n_pieces").collect()} == {(x.doc_id, x.text, x.n_pieces) for x in steps[5]}


def test_no_rows(spark, saved):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    d = saved(documents=none, labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert C.run(spark, d).collect() == []


def test_clashing_columns_nulls_and_repeats(spark, saved):
    names = ["score", "predicted", "dropped_lines", "epoch", "tokens", "key", "fp", "u", "slice", "covered", "domain", "n_pieces"]
    rows = [(i, t, la, so, n) for i, t, la, so, n in [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (None, None, None, None, None), (2, "", "en", None, 0), (3, "x " * 3000, None, "s", 6000)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for n in names:
        docs = docs.withColumn(n, F.lit(n))
    d = saved(documents=docs, labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    at = docs
    for name, f in C.STAGES:
        at = f(spark, at, d)
        if name != "sentencepiece":
            assert at.columns == docs.columns and all(r.score == "score" and r.epoch == "epoch" and r.dropped_lines == "dropped_lines" for r in at.collect())
    assert at.count() >= 1
