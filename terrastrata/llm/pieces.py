"""SentencePiece encoding and decoding with N-best segmentations.

A text is a lattice of the vocabulary's pieces; a character that is no piece of its own gets its UTF-8 bytes as byte
pieces, so every text has a path and decoding gives it back exactly. The forward Viterbi score of a piece, that of the best
path which ends with it, is the exact heuristic of a backward A-star search, which yields segmentations in order of score.
The ids and the N best of every stretch of text come from that search.

Scores are the model's own. A unigram model's are log probabilities, taken in millionths so that sums are exact. A merge
model (all its numbers are whole: ranks of merges) counts first the junctions, between two pieces that follow each other,
which its merges would not leave standing, and then the stored numbers. A path without such a junction is what the merges
make of the text, and there is one only, so the best segmentation is the vocabulary's own encoding, and the others are
those nearest to it. (Whether merges leave a junction between two pieces standing is found by merging the two, once a pair.)

No piece holds what ``CUTS`` cuts at, so every path passes through the cuts and the search runs between them; results are
kept by stretch, since words recur. Over a text the N best are the best choice everywhere but at the at most N - 1 stretches
whose second choices cost least; the agenda shows that cost as soon as the best is found. The finest rule of ``CUTS`` that
the vocabulary keeps is used; the last one, the whole text as one stretch, fits any.

Ties go to the segmentation found first, those nearest to the text's start first. An empty or null text has no pieces. A
literal U+2581 is text, not a space, and goes as bytes (the model's own encoder would turn it into a space). Very long texts
are encoded whole: time grows with their length, memory with the text and the longest stretch between cuts. Equal rows get
equal results; an empty table gives an empty one; other columns pass through, but for those whose names the results take.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import product
from operator import getitem, lt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, map_rows

OWNER = "pieces"  # of what workers keep
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BEST = 4
CACHE_BYTES = 256 << 20  # what a worker keeps of stretches seen, and again of those seen before them, by a generous estimate of their size
HEADS, MOST_HEADS = (4, 6), 100_000  # lengths of the beginnings of stretches whose pieces are kept, and how many of them
MOST_PAIRS = 1_000_000  # pairs of pieces whose junctions are kept
LOW, NEVER = -(1 << 200), 1 << 62
JUNCTION = 1 << 52  # what a junction that merges would not leave costs: more than the stored numbers of a text add up to (those of pieces for runs of spaces are 1e9, so of four million of them at most)

#: Rules to cut texts by, the finest first: a pattern of the stretches, and what no piece may hold for it to be used.
#: Words with the spaces before them, and marks with what follows (a letter, superscript two being none, and then something
#: else is in no piece); then runs between spaces; then lines; then nothing.
CUTS = [
    (re.compile(r" *[^\W\d_²]++|\n| *(?:(?![ \n])[\W\d_²])++[^\W\d_²]*+| +"), re.compile(r"[^\W\d_²][\W\d_²]|[^ ] |\n.|.\n", re.S)),
    (re.compile(r" *[^ \n]++|\n| +"), re.compile(r"[^ ] |\n.|.\n", re.S)),
    (re.compile(r"\n|[^\n]+"), re.compile(r"\n.|.\n", re.S)),
    (re.compile(r".+", re.S), re.compile(r"(?!)")),
]

Node = tuple[int, dict[int, int], int, int]  # the best score of a path that ends here, what a next piece costs, start, piece


class Pieces:
    """A vocabulary: its trie by characters, with spaces for U+2581, its byte pieces, and what junctions cost."""

    def __init__(self, model: bytes):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = m.get_piece_size()
        plain = [i for i in range(size) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.merges = all(m.get_score(i) == int(m.get_score(i)) for i in plain)
        self.unit = 1.0 if self.merges else 1e6
        self.bytes_of = [b""] * size
        self.byte_ids = [0] * 256
        self.trie: dict[str, list] = {}  # of the pieces read backwards, by character: what may precede, the piece that starts here (or -1)
        self.texts: list[str] = [""] * size
        self.stored = [round(self.unit * m.get_score(i)) for i in range(size)]
        #: A character that goes as bytes: nothing among ranks, and what the model's own encoder takes among log probabilities.
        self.spelled_score = 0 if self.merges else min(self.stored[i] for i in plain) - 10_000_000
        for i in range(size):
            if m.is_byte(i):
                value = int(m.id_to_piece(i)[3:5], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
        self.rank: dict[str, int] = {}
        for i in plain:
            text = self.texts[i] = m.id_to_piece(i).replace("▁", " ")
            self.rank[text] = self.stored[i]
            self.bytes_of[i] = text.encode()
            node = self.trie
            for c in text[:0:-1]:
                node = node.setdefault(c, [{}, -1])[0]
            node.setdefault(text[0], [{}, -1])[1] = i
        self.letters = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)  # of all pieces, one after the other
        self.letters_of = np.array(list(map(len, self.bytes_of)))
        self.letters_at = np.cumsum(self.letters_of) - self.letters_of
        self.stretch = next(rule for rule, held in CUTS if not any(held.search(t) for t in self.rank))
        #: Characters without a piece, numbered after the pieces: their ids.
        self.spelled: list[tuple[int, ...]] = []
        self.spelled_at: dict[str, int] = {}
        #: By piece, what each next one costs, filled as pairs are met; the last row is a stretch's start.
        self.rows: list[dict[int, int]] = [{} for _ in range(size)]
        self.start: dict[int, int] = {}
        self.made: dict[int, bool] = {}
        self.pairs = 0
        self.most_heads = MOST_HEADS
        self.heads: dict[str, list[list[Node]]] = {}

    def spell(self, c: str) -> int:
        """The number of a character that goes as bytes."""
        if (q := self.spelled_at.get(c)) is None:
            q = self.spelled_at[c] = len(self.texts)
            ids = tuple(self.byte_ids[b] for b in c.encode())
            self.spelled.append(ids)
            self.texts.append(c)
            self.stored.append(self.spelled_score)
            self.rows.append({})
        return q

    def merged(self, text: str) -> list[str]:
        """What the merges make of a text: the pair with the highest stored number merges first, the leftmost of equals."""
        parts, rank = list(text), self.rank.get
        pairs = [rank(a + b, LOW) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (best := max(pairs)) > LOW:
            k = pairs.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k:
                pairs[k - 1] = rank(parts[k - 1] + parts[k], LOW)
            if k < len(pairs):
                pairs[k] = rank(parts[k] + parts[k + 1], LOW)
        return parts

    def sound(self, q: int) -> bool:
        """Whether merges make piece q of its own text."""
        if (known := self.made.get(q)) is None:
            known = self.made[q] = len(self.merged(self.texts[q])) == 1
        return known

    def cost(self, row: dict[int, int], p: int, q: int) -> int:
        """The score of piece q after piece p (-1: first of its stretch), kept in p's row."""
        s = self.stored[q]
        if self.merges and not (self.sound(q) and (p < 0 or self.sound(p) and self.merged(self.texts[p] + self.texts[q]) == [self.texts[p], self.texts[q]])):
            s -= JUNCTION
        row[q] = s
        self.pairs += 1
        return s

    def forget(self) -> None:
        """Lets go of what is known of pairs and of beginnings."""
        self.heads.clear()
        self.start.clear()
        for row in self.rows:
            row.clear()
        self.pairs = 0

    def ending(self, text: str, j: int, ends: list[list[Node]]) -> list[Node]:
        """The pieces that end at position j, with their forward Viterbi scores, from those of all positions before."""
        out: list[Node] = []
        node, rows, i, single = self.trie, self.rows, j, False
        while i and (found := node.get(text[i - 1])) is not None:
            i -= 1
            node, q = found
            if q >= 0:
                single = single or i == j - 1
                top = LOW
                for f, row, _, p in ends[i]:
                    try:
                        s = f + row[q]
                    except KeyError:
                        s = f + self.cost(row, p, q)
                    if s > top:
                        top = s
                out.append((top, rows[q], i, q))
        if not single:
            q = self.spell(text[j - 1])
            out.append((max(f + (row[q] if q in row else self.cost(row, p, q)) for f, row, _, p in ends[j - 1]), self.rows[q], j - 1, q))
        return out

    def lattice(self, text: str) -> list[list[Node]]:
        """By position the pieces that end there. They depend on what is before alone, so those of the first characters are kept and shared."""
        ends, done = [[(0, self.start, -1, -1)]], 0
        for size in HEADS:
            head = text[:size]
            if (known := self.heads.get(head)) is None:
                known = list(ends)
                for j in range(done + 1, len(head) + 1):
                    known.append(self.ending(head, j, known))
                if len(self.heads) >= self.most_heads:
                    self.heads.clear()
                self.heads[head] = known
            ends, done = known, len(head)
            if len(text) <= size:
                return ends
        ends = list(ends)
        for j in range(done + 1, len(text) + 1):
            ends.append(self.ending(text, j, ends))
        return ends

    def segmentations(self, text: str, agenda: list) -> Iterator[tuple[int, list[int]]]:
        """(score, ids) of all segmentations, the best first: backward A-star over the lattice. The agenda, given empty, shows the negated score of the next one at its head."""
        ends = self.lattice(text)
        size, push = len(self.bytes_of), heapq.heappush
        made = 0
        for node in ends[-1]:
            made += 1
            push(agenda, (-node[0], node[2], made, 0, node, ()))  # among equals the one nearest to the start, so that ties don't pile up
        while agenda:
            _, _, _, behind, (_, _, start, q), path = heapq.heappop(agenda)
            if start < 0:
                ids: list[int] = []
                while path:
                    q, path = path
                    if q < size:
                        ids.append(q)
                    else:
                        ids.extend(self.spelled[q - size])
                yield behind, ids
                continue
            path = (q, path)
            for node in ends[start]:
                made += 1
                after = behind + node[1][q]
                push(agenda, (-(node[0] + after), node[2], made, after, node, path))


def gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of pool with these starts and sizes, one after the other."""
    ends = np.cumsum(sizes)
    if not len(ends):
        return pool[:0]
    return pool[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])]


class Seen:
    """Stretches and what was found of each: its best ids, their score, what the second best costs more. Arrays, so that whole texts are looked up at once."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.score, self.cost, self.end, self.ids = array("q"), array("q"), array("q", [0]), array("i")

    def add(self, stretch: str, ids: list[int] | array, score: int, cost: int) -> int:
        k = self.place[stretch] = len(self.place)
        self.score.append(score)
        self.cost.append(cost)
        self.ids.extend(ids)
        self.end.append(len(self.ids))
        return k

    def size(self) -> int:
        """In bytes, by estimate: a place takes some 200 and a short text."""
        return 260 * len(self.place) + 12 * len(self.ids)

    def arrays(self) -> tuple[np.ndarray, ...]:
        """Scores, costs, ends and ids; nothing can be added while they are in use."""
        return tuple(np.frombuffer(x, dtype=x.typecode) for x in (self.score, self.cost, self.end, self.ids))


class Encoder:
    """Encodes texts and keeps what it finds for stretches; made once a task."""

    def __init__(self, pieces: Pieces, best: int = BEST, cache_bytes: int = CACHE_BYTES):
        self.pieces, self.best, self.room = pieces, best, cache_bytes
        pieces.most_heads = min(MOST_HEADS, max(1000, cache_bytes // 1600))
        self.seen, self.before = Seen(), Seen()
        self.deep: dict[str, list[tuple[int, list[int]]]] = {}
        self.deep_size = 0
        self.choices = [[c for c in product(range(best), repeat=k) if math.prod(x + 1 for x in c) <= best] for k in range(best)]

    def first(self, stretch: str) -> int:
        """The place of a stretch among those seen, where it is put if it is new."""
        seen, old = self.seen, self.before
        if (k := seen.place.get(stretch)) is not None:
            return k
        if (k := old.place.get(stretch)) is not None:
            return seen.add(stretch, old.ids[old.end[k] : old.end[k + 1]], old.score[k], old.cost[k])
        agenda: list = []
        score, ids = next(self.pieces.segmentations(stretch, agenda))
        return seen.add(stretch, ids, score, min(score + agenda[0][0], NEVER - 1) if agenda else NEVER)

    def several(self, stretch: str) -> list[tuple[int, list[int]]]:
        if (out := self.deep.get(stretch)) is None:
            out = [x for x, _ in zip(self.pieces.segmentations(stretch, []), range(self.best), strict=False)]
            size = 500 + 4 * len(stretch) + self.best * (200 + 8 * len(out[0][1]))
            if self.deep_size + size > self.room // 8:
                self.deep, self.deep_size = {}, 0
            self.deep[stretch] = out
            self.deep_size += size
        return out

    def encode(self, text: str | None) -> tuple[np.ndarray, list[int], list[list[tuple[int, int, list[int]]]]]:
        """(ids of the best, scores of the N best, changes): how each of the N best differs from the best, as (place in its ids, pieces replaced, ids instead)."""
        if not text:
            return np.zeros(0, dtype=np.int32), [0], [[]]
        if self.pieces.pairs > MOST_PAIRS:
            self.pieces.forget()
        if self.seen.size() > self.room:  # what was seen since the last time stays for one more, so that common stretches are always kept
            self.seen, self.before = Seen(), self.seen
        stretches = self.pieces.stretch.findall(" " + text)
        found = list(map(self.seen.place.get, stretches))
        if None in found:
            first = self.first
            found = [first(s) if k is None else k for k, s in zip(found, stretches, strict=True)]
        all_scores, all_costs, all_ends, all_ids = self.seen.arrays()
        at = np.array(found)
        costs, score, starts = all_costs[at], int(all_scores[at].sum()), all_ends[at]
        counts = all_ends[at + 1] - starts
        ids, ends = gathered(all_ids, starts, counts), np.cumsum(counts)
        most = self.best - 1
        near = np.flatnonzero(costs <= (np.partition(costs, most - 1)[most - 1] if 0 < most < len(costs) else NEVER))
        near = near[np.argsort(costs[near], kind="stable")][:most]
        where = sorted(near[costs[near] < NEVER].tolist())
        lists = [self.several(stretches[k]) for k in where]
        # A choice with places c is no better than any of the (c + 1) * ... choices with places up to c.
        worse = [[x[0][0] - y for y, _ in x] for x in lists]
        sizes = list(map(len, lists))
        ways = heapq.nsmallest(self.best, [(sum(map(getitem, worse, choice)), choice) for choice in self.choices[len(where)] if all(map(lt, choice, sizes))])
        changes = [[(int(ends[k] - counts[k]), int(counts[k]), x[c][1]) for k, x, c in zip(where, lists, choice, strict=True) if c] for _, choice in ways]
        return ids, [score - cost for cost, _ in ways], changes

    def parts(self, score: int) -> tuple[float, int]:
        """A score as the stored numbers' sum and the number of junctions that merges would not leave."""
        if not self.pieces.merges:
            return score / self.pieces.unit, 0
        junctions, ranks = divmod(-score, JUNCTION)
        return float(-ranks), junctions


def changed(ids: list[int], change: list[tuple[int, int, list[int]]]) -> list[int]:
    """The ids of one of the N best, from the best and how it differs."""
    out, at = [], 0
    for start, n, new in change:
        out += [*ids[at:start], *new]
        at = start + n
    return out + list(ids[at:])


def decode(pieces: Pieces, ids: list[int] | np.ndarray) -> str:
    which = np.asarray(ids, dtype=np.int64)
    return gathered(pieces.letters, pieces.letters_at[which], pieces.letters_of[which]).tobytes().decode("utf-8", "replace").removeprefix(" ")


def loaded(model: bytes) -> Pieces:
    """The vocabulary, kept by a worker process."""
    mine, key = kept(OWNER), hashlib.sha256(model).digest()
    if mine.get("model") != key:
        mine.clear()
        mine.update(model=key, pieces=Pieces(model))
    return mine["pieces"]


def encoder(model: bytes, best: int, cache_bytes: int = CACHE_BYTES) -> Encoder:
    """An encoder with what it has seen, kept by a worker process."""
    p, mine = loaded(model), kept(OWNER)
    if "encoder" not in mine or (mine["encoder"].best, mine["encoder"].room) != (best, cache_bytes):
        mine["encoder"] = Encoder(p, best, cache_bytes)
    return mine["encoder"]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


CHANGES = pa.list_(pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])))


def encoded(docs: DataFrame, model: str = MODEL, best: int = BEST, back: str | None = None, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """docs with ids (the best segmentation), scores (of the N best: sums of the stored numbers), junctions (of the N best: those
    that merges would not leave), changes (how each differs from the best) and, if back names it, a column of the text decoded
    from ids. They take the place of columns of those names. The model's file, read on the driver, goes along with the function."""
    docs = docs.drop("ids", "scores", "junctions", "changes", *([back] if back else []))
    data, place = read_model(model), docs.columns.index("text")

    def make() -> Callable[[pa.RecordBatch], dict]:
        e = encoder(data, best, cache_bytes)

        def f(batch: pa.RecordBatch) -> dict:
            ids, scores, junctions, changes, texts = [], [], [], [], []
            for t in batch.column(place).to_pylist():
                i, s, c = e.encode(t)
                ids.append(i)
                parts = [e.parts(x) for x in s]
                scores.append([x for x, _ in parts])
                junctions.append([x for _, x in parts])
                changes.append([[{"at": a, "n": n, "ids": new} for a, n, new in way] for way in c])
                if back:
                    texts.append(decode(e.pieces, i))
            new = {
                "ids": pa.array(ids, type=pa.list_(pa.int32())),
                "scores": pa.array(scores, type=pa.list_(pa.float64())),
                "junctions": pa.array(junctions, type=pa.list_(pa.int32())),
                "changes": pa.array(changes, type=CHANGES),
            }
            if back:
                new[back] = pa.array(texts, type=pa.string())
            return dict(zip(batch.schema.names, batch.columns, strict=True)) | new

        return f

    fields = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    changes = "array<array<struct<at:int,n:int,ids:array<int>>>>"
    return map_rows(docs, make, f"{fields}, ids array<int>, scores array<double>, junctions array<int>, changes {changes}" + (f", `{back}` string" if back else ""), OWNER)


def decoded(encodings: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text from doc_id and ids."""
    data = read_model(model)

    def make() -> Callable[[pa.RecordBatch], dict]:
        p = loaded(data)
        return lambda batch: {"doc_id": batch.column(0), "text": [decode(p, x or []) for x in batch.column(1).to_pylist()]}

    return map_rows(encodings.select("doc_id", "ids"), make, "doc_id long, text string", OWNER)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: the number of its pieces, the score of the best and score and junctions of the second best, and digests
    of the best's ids (comma-joined), of all N best (those ids, a bar, and the changes as Spark shows them) and of the decoded text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = encoded(docs, back="back").withColumn("joined", F.array_join("ids", ","))
    second = lambda c, t: F.get(F.col(c), F.lit(1)).cast(t)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.size("scores").cast("long").alias("n_best"),
        F.get("scores", F.lit(0)).alias("score"),
        second("scores", "double").alias("second_score"),
        second("junctions", "long").alias("second_junctions"),
        F.sha2("joined", 256).alias("ids_sha256"),
        F.sha2(F.concat_ws("|", "joined", F.col("changes").cast("string")), 256).alias("n_best_sha256"),
        F.sha2("back", 256).alias("decoded_sha256"),
        (F.col("back") == F.coalesce("text", F.lit(""))).alias("exact"),
    )
