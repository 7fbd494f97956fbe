"""Toxicity: a learned lexicon, Levenshtein automata that catch its terms misspelled, and context windows that tell quotation from abuse.

Fit, on labelled rows alone (at most FIT_ROWS, chosen by a hash of doc_id; the bound is a parameter):
  1. Terms are words, stems (word*: anything that begins so) and stems of two different words of a text (word**). Those of
     toxic texts are counted, then the same ones among clean texts. Near copies share a text's smallest word-pair hash; n of
     them weigh the root of n together, so that a few copies don't make their rare words look toxic.
  2. Terms that are commoner in toxic texts, by a test at a level of LEVEL for all terms together, are taken greedily while
     they explain toxic texts that earlier terms don't explain COVER times. Whole words of a taken stem stay in the trie.
  3. A logistic regression on the features below.
Score, for any text: each distinct word runs through the intersection of its Levenshtein automaton with the lexicon's trie
(distance 0, or 1 for words of LONG letters and more, unless the word is common in clean texts; stems match exactly). A sign
or digit between letters belongs to a word. Hits are weighed by a window of WINDOW words around them: inside a pair of
quotation marks that open and close within it, or next to words of reporting, a hit counts as quoted. Features: plain hits
by term, misspelled and quoted hits, hits that stand together, hits by length. Labels, lang, source and doc_id are never
inputs of a score.

Null and empty texts score as texts without hits. Without labelled rows of both kinds every score is the share of toxic
labels (0 if there are none). Ties: of terms that explain as much, words come before stems, longer before shorter, then the
last by letters; of terms as near to a word, the first by letters. Rows with equal texts score alike, and each labelled row
counts (a doc_id labelled twice has its highest label). An empty table gives an empty result; other columns are ignored, or
pass through where docs are returned. Very long texts are read whole, in time in proportion to their length.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_rows

FIT_ROWS = 20_000
LONG, WINDOW = 5, 8
SHORT, LONGEST = 4, 9  # letters of a stem
RATIO = 4.0  # how much commoner a term is in toxic texts, at least
LEVEL = 0.01
COVER = 4
CACHE_BYTES = 48 << 20  # what a worker keeps of stretches seen, by estimate
WORD = re.compile(r"[^\W\d_]+(?:[*@$!0-9][^\W\d_]+)*")
#: A pair of quotation marks within a line; a mark after a letter or digit doesn't open, one before them doesn't close.
QUOTED = re.compile(r"(?<!\w)(?:\"[^\"\n]+\"|“[^“”\n]+”|„[^„“”\n]+[“”]|«[^«»\n]+»)(?!\w)")
# Words of reporting, in the languages of the corpus. Fixed values.
REPORTING = frozenset("said says wrote called quoted quote citation dijo escribió sagte schrieb dit écrit".split())


class Trie:
    """A lexicon that Levenshtein automata run over."""

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        for t in terms:
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t

    def within(self, word: str, most: int) -> tuple[str, int] | None:
        """The nearest term (then the first by letters) at a distance of at most most, and the distance.

        The automaton's state after some letters of a path is the row of distances to the word's prefixes, held for those
        within most of the diagonal; a path ends where no entry is small enough.
        """
        n, best = len(word), None
        stack = [(self.root, 0, {i: i for i in range(min(n, most) + 1)})]
        while stack:
            node, depth, row = stack.pop()
            for c, child in node.items():
                if c == "":
                    if (d := row.get(n, most + 1)) <= most and (best is None or (d, child) < (best[1], best[0])):
                        best = child, d
                    continue
                new: dict[int, int] = {}
                for i in range(max(0, depth + 1 - most), min(n, depth + 1 + most) + 1):
                    d = row.get(i, most + 1) + 1  # a letter of the term that the word lacks
                    if i:
                        d = min(d, new.get(i - 1, most + 1) + 1, row.get(i - 1, most + 1) + (word[i - 1] != c))
                    if d <= most:
                        new[i] = d
                if new:
                    stack.append((child, depth + 1, new))
        return best


@dataclass(frozen=True)
class Model:
    terms: tuple[str, ...]
    common: frozenset[str]  # clean words, none of which is a term misspelled
    weights: tuple[float, ...]
    prior: float
    spellings: tuple[str, ...] = ()  # whole words of taken stems, for the automata alone


class Scorer:
    """Features and scores of texts; made once a task."""

    def __init__(self, model: Model):
        self.model = model
        self.place = {t: i for i, t in enumerate(model.terms)}
        words = [*(t for t in model.terms if not t.endswith("*")), *model.spellings]
        self.trie = Trie(words)
        self.stems = frozenset(t.rstrip("*") for t in model.terms if t.endswith("*"))
        self.stem_sizes = sorted({len(t) for t in self.stems})
        self.starts = {t[:SHORT] for t in self.stems}
        self.seen: set[str] = set()  # stretches between white space that were looked at
        self.hits: set[str] = set()  # those of them with a hit
        self.held = 0
        self.kinds: dict[str, tuple[bool, tuple[str, ...]] | None] = {}
        # One letter's difference leaves a term's first or its second half as it is.
        self.halves: dict[int, tuple[int, set[str]]] = {}
        for t in words:
            self.halves.setdefault(len(t), (len(t) // 2, set()))[1].update((t[: len(t) // 2], "$" + t[len(t) - len(t) // 2 :]))
        self.heads, self.tails = {t[:2] for t in words}, {t[-2:] for t in words}
        self.lengths = {n + d for n in self.halves for d in (-1, 0, 1)}

    def like(self, low: str) -> bool:
        """Whether a word may be a term or a letter away from one."""
        n = len(low)
        if n not in self.lengths or not (low[:2] in self.heads or low[-2:] in self.tails):
            return False
        return any((h := self.halves.get(k)) and (low[: h[0]] in h[1] or "$" + low[n - h[0] :] in h[1]) for k in (n - 1, n, n + 1))

    def kind(self, word: str) -> tuple[bool, tuple[str, ...]] | None:
        """(whether misspelled, the term and stems that it stands for); None without any."""
        low = word.lower()
        like = self.like(low)
        if not like and low[:SHORT] not in self.starts:
            return None
        if low not in self.kinds:
            self.held += 150 + len(low)
            found = self.trie.within(low, 1 if len(low) >= LONG and low not in self.model.common else 0) if like else None
            stems = tuple(low[:n] for n in self.stem_sizes if n < len(low) and low[:n] in self.stems)
            self.kinds[low] = (bool(found and found[1] and not stems), ((found[0],) if found else ()) + stems) if found or stems else None
        return self.kinds[low]

    def hit(self, stretch: str) -> bool:
        return any(self.kind(w) for w in WORD.findall(stretch))

    def features(self, text: str | None) -> list[float]:
        text, n = text or "", len(self.model.terms)
        stretches = set(text.split())
        if self.held > CACHE_BYTES:
            self.seen, self.hits, self.kinds, self.held = set(), set(), {}, 0
        new = stretches - self.seen
        self.seen |= new
        self.held += sum(map(len, new)) + 100 * len(new)
        self.hits.update(filter(self.hit, new))
        if self.hits.isdisjoint(stretches):
            return [0.0] * (n + 4)
        quoted = [m.span() for m in QUOTED.finditer(text)]
        places = [(m.start(), m[0]) for m in WORD.finditer(text)]
        low = [x.lower() for _, x in places]
        count, of_stem = [0] * (n + 4), defaultdict(set)
        at, last = 0, None
        for i, (start, w) in enumerate(places):
            if not (kind := self.kind(w)):
                continue
            while at < len(quoted) and quoted[at][1] <= start:
                at += 1
            # Both marks of the pair stand within the window.
            first, after = places[max(0, i - WINDOW)][0], places[i + WINDOW][0] if i + WINDOW < len(places) else len(text)
            inside = at < len(quoted) and quoted[at][0] < start and (quoted[at][0] >= first or i < WINDOW) and quoted[at][1] <= after
            if inside or any(x in REPORTING for x in low[max(0, i - WINDOW) : i + WINDOW]):
                count[n + 1] += 1
            elif kind[0]:
                count[n] += 1
            else:
                for t in kind[1]:
                    if t in self.place:
                        count[self.place[t]] += 1
                    if (stem := f"{t}*") in self.place:
                        count[self.place[stem]] += 1
                    if (pair := f"{t}**") in self.place:
                        of_stem[pair].add(low[i])
            count[n + 2] += last is not None and i - last <= WINDOW
            count[n + 3] += 1
            last = i
        for pair, words in of_stem.items():
            count[self.place[pair]] = len(words) - 1
        return [*map(math.log1p, count[: n + 3]), 100 * count[n + 3] / (len(places) + 20)]

    def score(self, text: str | None) -> float:
        if not self.model.weights:
            return self.model.prior
        z = self.model.weights[0] + sum(w * x for w, x in zip(self.model.weights[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray, ridge: float = 0.3, rounds: int = 100) -> np.ndarray:
    """Weights with the intercept first, by Newton's method; each row counts a number of times."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (times * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (times * (y - p)) - penalty @ w)
        w = w + step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def tokens(text: str | None) -> set[str]:
    """The candidate terms of a text: its words, their stems (stem*), and the stems of several of them (stem**)."""
    words = {w.lower() for w in WORD.findall(text or "")}
    out, stems = set(words), set()
    for w in words:
        for n in range(SHORT, min(LONGEST, len(w) - 1) + 1):
            stem = w[:n] + "*"
            if stem in stems:
                out.add(stem + "*")
            stems.add(stem)
    return out | stems


def chance(a: float, b: float, toxic: float, clean: float) -> float:
    """How likely a term that says nothing is at least as common among toxic texts: a of its a + b texts (weighed) are toxic. An upper bound (Chernoff's)."""
    n, share = a + b, toxic / (toxic + clean)
    if n == 0 or a / n <= share:
        return 1.0
    x = a / n
    apart = x * math.log(x / share) + ((1 - x) * math.log((1 - x) / (1 - share)) if x < 1 else 0.0)
    return math.exp(-n * apart)


def chosen(docs: list[tuple[float, list[str]]], ratio: dict[str, float], least: float) -> list[str]:
    """Terms taken greedily by the weight of the toxic texts (weight, candidate terms in it) that they explain and by how much commoner they are there, while they explain a weight of least."""
    by_term: dict[str, list[int]] = defaultdict(list)
    for i, (_, terms) in enumerate(docs):
        for t in terms:
            by_term[t].append(i)
    need, out, gone = [COVER] * len(docs), [], set()

    def rank(t: str) -> tuple:
        """Of equals a word before a stem, a longer one before a shorter, the last by letters; the heap has the least first."""
        g = sum(docs[i][0] for i in by_term[t] if need[i])
        return -round(g * math.log(ratio[t]), 6) if g >= least else 0.0, t.endswith("*"), -len(t), [-ord(c) for c in t], t

    agenda = [rank(t) for t in by_term]
    heapq.heapify(agenda)
    while agenda:
        *_, t = heapq.heappop(agenda)
        # What is part of a taken term, or holds it, explains nothing more.
        if t in gone or any(t.rstrip("*").startswith(x) for x in gone) or t.endswith("*") and any(x.startswith(t.rstrip("*")) for x in gone):
            continue
        # What a term explains only falls, so one that is still the best by its new rank is the best of all.
        now = rank(t)
        if now[0] == 0.0:
            continue
        if agenda and now > agenda[0]:
            heapq.heappush(agenda, now)
            continue
        out.append(t)
        gone.add(t.rstrip("*"))
        for i in by_term[t]:
            need[i] = max(0, need[i] - 1)
    return sorted(out)


def in_fit(doc_id: Column) -> Column:
    """The rows that may be learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = FIT_ROWS) -> Model:
    """Fits on rows of labels with a toxic label and a doc_id whose text is among docs and that in_fit() allows."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & in_fit(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > most_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < most_rows)
    # At most most_rows rows of 12 bytes, so they may be broadcast.
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")

    def copies(batch: pa.RecordBatch) -> dict:
        out = []
        for text in batch.column(1).to_pylist():
            w = [x.lower() for x in WORD.findall(text or "")]
            out.append(min((xxhash.xxh64_intdigest(f"{a} {b}") for a, b in zip(w, w[1:], strict=False)), default=0) >> 1)
        return {"toxic": batch.column(2), "copies": pa.array(out, type=pa.int64()), "text": batch.column(1)}

    rows = cut(map_rows(texts, lambda: copies, "toxic int, copies long, text string"))
    # At most most_rows groups of 20 bytes, so they may be broadcast and no text is shuffled.
    group = rows.groupBy("copies", "toxic").agg((1 / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("weight"))
    weighed = cut(rows.join(F.broadcast(group), ["copies", "toxic"]).select("toxic", "weight", "text"))
    total = {r.toxic: r.w for r in weighed.groupBy("toxic").agg(F.sum("weight").alias("w")).collect()}
    toxic, clean = total.get(1, 0.0), total.get(0, 0.0)
    if not toxic or not clean:
        return Model((), frozenset(), (), 1.0 if toxic else 0.0)

    def of_toxic(batch: pa.RecordBatch) -> dict:
        return {"weight": batch.column(1), "terms": pa.array([sorted(tokens(t)) for t in batch.column(2).to_pylist()], type=pa.list_(pa.string()))}

    # Fewer toxic texts than least can't be told from chance, even if no clean text has the term.
    held = map_rows(weighed.where("toxic = 1"), lambda: of_toxic, "weight double, terms array<string>")
    counted = cut(held.select("weight", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("weight").alias("a")))
    level = LEVEL / max(1, counted.count())
    least = math.log(1 / level) / math.log(1 + clean / toxic)
    first = {r.term: r.a for r in counted.where(F.col("a") >= least).collect()}

    def among(names: dict[str, float]) -> Callable[[], Callable[[pa.RecordBatch], dict]]:
        def f(batch: pa.RecordBatch) -> dict:
            return {"toxic": batch.column(0), "weight": batch.column(1), "terms": pa.array([sorted(x for x in tokens(t) if x in names) for t in batch.column(2).to_pylist()], type=pa.list_(pa.string()))}

        return lambda: f

    in_clean = map_rows(weighed.where("toxic = 0"), among(first), "toxic int, weight double, terms array<string>")
    second = {r.term: r.b for r in in_clean.select("weight", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("weight").alias("b")).collect()}
    ratio = {t: (a + 0.1) / (toxic + 0.2) / ((second.get(t, 0.0) + 0.1) / (clean + 0.2)) for t, a in first.items()}
    ratio = {t: r for t, r in ratio.items() if r >= RATIO and chance(first[t], second.get(t, 0.0), toxic, clean) <= level}
    texts_of = [(r.weight, r.terms) for r in map_rows(weighed.where("toxic = 1"), among(ratio), "toxic int, weight double, terms array<string>").where(F.size("terms") > 0).collect()]
    terms = chosen(sorted(texts_of), ratio, least)
    stems = tuple(t.rstrip("*") for t in terms if t.endswith("*"))
    spellings = tuple(sorted(t for t in ratio if not t.endswith("*") and t not in terms and t.startswith(stems))) if stems else ()

    # Clean words a letter away from a term are no misspellings of it.
    near = map_words(weighed.where("toxic = 0"), terms, spellings).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    model = Model(tuple(terms), frozenset(r.word for r in near.collect()), (), toxic / (toxic + clean), spellings)

    def measured() -> Callable[[pa.RecordBatch], dict]:
        scorer = Scorer(model)
        return lambda batch: {"toxic": batch.column(0), "x": pa.array([scorer.features(t) for t in batch.column(2).to_pylist()], type=pa.list_(pa.float64()))}

    # Rows with equal features count together; most have none.
    table = map_rows(weighed, measured, "toxic int, x array<double>").groupBy("toxic", "x").agg(F.count(F.lit(1)).alias("n")).orderBy("toxic", "x").collect()
    x, y, k = np.array([r.x for r in table]), np.array([float(r.toxic) for r in table]), np.array([float(r.n) for r in table])
    return Model(model.terms, model.common, tuple(map(float, logistic(x, y, k))), model.prior, spellings)


def map_words(texts: DataFrame, terms: list[str], spellings: tuple[str, ...]) -> DataFrame:
    """The words of each text (third column), once a text, that are a letter away from a term."""

    def make() -> Callable[[pa.RecordBatch], dict]:
        scorer = Scorer(Model(tuple(terms), frozenset(), (), 0.0, spellings))

        def f(batch: pa.RecordBatch) -> dict:
            out = []
            for text in batch.column(2).to_pylist():
                out += sorted({w.lower() for w in WORD.findall(text or "") if (k := scorer.kind(w)) and k[0]})
            return {"word": pa.array(out, type=pa.string())}

        return f

    return map_rows(texts, make, "word string")


def scored(docs: DataFrame, model: Model, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.5), which take the place of columns of those names."""
    docs = docs.drop(score, predicted)
    place = docs.columns.index("text")

    def make() -> Callable[[pa.RecordBatch], dict]:
        scorer = Scorer(model)

        def f(batch: pa.RecordBatch) -> dict:
            s = [scorer.score(t) for t in batch.column(place).to_pylist()]
            return dict(zip(batch.schema.names, batch.columns, strict=True)) | {score: pa.array(s, type=pa.float64()), predicted: pa.array([int(x >= 0.5) for x in s], type=pa.int32())}

        return f

    fields = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return map_rows(docs, make, f"{fields}, {score} double, {predicted} int")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", F.coalesce(~in_fit(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
