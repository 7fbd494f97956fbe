"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's bits are cut into segments; the numbers of set bits by segment form a point of a small grid, and the
Manhattan distance of two points never exceeds the Hamming distance of their fingerprints. Fingerprints within two bits
therefore have points that share a grid cell once each point is spread to the cells within one step of it. Cells with a
single fingerprint drop most of the corpus; what is left is verified exactly the same way on the bits themselves (two
fingerprints differ by at most two bits exactly if some word lies within one bit of both). Both steps group by a cell, so
a group of n copies costs n rows times a constant, never n squared pairs.

At a similarity of 0.8 fingerprints of 64 bits lie some ten bits apart, too far for such a grid. `similar_components` does the
same on 12 short words of 21 bits, any of which may lie within two bits: the popcounts of a word's two segments are its grid
point, points are spread to the cells within one step, and in a cell the words within two bits are found exactly. Their prints
are compared on 256 other bits, and the links are verified on the sets of shingles.

Nulls and empty texts: no words, fingerprint zero, linked like any other. Equal rows: one class. Documents with a null
doc_id get their group's component (null where no other is in it). An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import connected_components, cut, map_rows

SEGMENT_BITS = 3  # 22 segments: among 250,000 unrelated fingerprints fewer than one in a hundred has a chance neighbour
NEAR_BITS = 2


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes (n, k words each) have each of the 64 k bits set, lowest bit first."""
    total = np.zeros(hashes.shape[1] * 64, dtype=np.int64)
    for i in range(0, len(hashes), 255):  # sums of 255 bits fit a byte
        bits = np.unpackbits(np.ascontiguousarray(hashes[i : i + 255], dtype="<u8").view(np.uint8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.uint8)
    return total


def majority(hashes: np.ndarray) -> np.ndarray:
    """A word for each column of 64-bit hashes: a bit is 1 if set in over half the rows."""
    return np.packbits(bit_sums(hashes) * 2 > len(hashes), bitorder="little").view("<u8")


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """SimHash of word shingles: A-Z in lower case, words between ASCII white space, XXH64 of the joined shingle."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) < words:
        return xxhash.xxh64_intdigest(b" ".join(w), seed)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.fromiter((digest(join(t), seed) for t in zip(*(w[i:] for i in range(words)), strict=False)), dtype="<u8", count=len(w) - words + 1)
    return int(majority(hashes[:, None])[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def make() -> Callable[[pa.RecordBatch], dict]:
        def f(batch: pa.RecordBatch) -> dict:
            fp = np.array([fingerprint(t.as_py(), words, seed) for t in batch.column(1)], dtype="<u8")
            return {"doc_id": batch.column(0), "fp": pa.array(fp.view("<i8"))}

        return f

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, fp long")


def widths(bits: int = SEGMENT_BITS, of: int = 64) -> list[int]:
    """The segments' bits: `of` bits cut into parts of the given size, the last one with what is left."""
    return [min(bits, of - i) for i in range(0, of, bits)]


def scale(bits: int, of: int = 64) -> list[int]:
    """What a set bit of each segment adds to a packed point: digits hold a count and a step to either side of it."""
    base = bits + 3
    if base ** len(widths(bits, of)) >= 1 << 63:
        raise ValueError("segments are too short for their counts to fit a long")
    return [base**i for i in range(len(widths(bits, of)))]


def point(fp: Column, bits: int = SEGMENT_BITS, of: int = 64) -> Column:
    """The grid point of a fingerprint: the set bits of each segment, packed into a long."""
    packed, at = None, 0
    for width, by in zip(widths(bits, of), scale(bits, of), strict=True):
        count = (F.bit_count(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))) + 1).cast("long") * by
        packed, at = count if packed is None else packed + count, at + width
    return packed


def steps(bits: int = SEGMENT_BITS, of: int = 64) -> Column:
    """What to add to a packed point for it and its neighbours of one step."""
    return F.array(*(F.lit(x).cast("long") for x in [0] + [sign * by for by in scale(bits, of) for sign in (1, -1)]))


def candidates(fps: DataFrame, bits: int = SEGMENT_BITS) -> DataFrame:
    """The distinct fingerprints (fp) whose point has another fingerprint's within Manhattan distance two."""
    spread = fps.select("fp", point(F.col("fp"), bits).alias("point")).select("fp", "point", F.explode(steps(bits)).alias("step")).select("fp", (F.col("point") + F.col("step")).alias("cell"))
    shared = spread.groupBy("cell").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("cell")
    return spread.join(shared, "cell").select("fp").distinct()


def verified_stars(fps: DataFrame) -> DataFrame:
    """Edges (a, b) of the fingerprints' graph: for each word within a bit of several, each of them to the smallest."""
    flips = F.array(F.lit(0), *(F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64))).cast("array<bigint>")
    spread = fps.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
    low = spread.groupBy("word").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    return spread.join(low, "word").where("fp <> lo").select(F.col("fp").alias("a"), F.col("lo").alias("b")).distinct()


def near_components(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): documents linked, over any chain, by fingerprints within two bits."""
    prints = cut(fingerprints(docs, words))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    found = cut(candidates(classes.select("fp")))
    parts = connected_components(verified_stars(found)).withColumnsRenamed({"node": "fp", "component": "part"})
    of_class = classes.join(parts, "fp", "left").select("fp", "rep", F.coalesce("part", "fp").alias("part"))
    smallest = of_class.groupBy("part").agg(F.min("rep").alias("component_id"))
    to_class = of_class.join(smallest, "part").select("fp", "component_id")
    return prints.join(to_class, "fp").select("doc_id", "fp", "component_id")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- similarity of word shingles -------------------------------------------------------------------------------------

WORDS_64 = 4  # words of 64 bits that are compared
ALL_WORDS = 8  # words of a long fingerprint, the compared ones first; the others are cut into short words
SHORT_BITS, SHORT_SEGMENT = 21, 11  # bits of a short word and of its segments (11 and 10): three short words in one of 64 bits, five cells each
GROUP = 1 << 21  # prints that one task holds
FEW_PRINTS = 512  # prints near a short word that are compared pair by pair; a forest's leaders spare work among more
CELLS_DEALT = 192  # partitions that cells go to; there is a fixed number of cells, some 300 of them with most prints
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, words: int, known: dict[bytes, int]) -> tuple[bytes, np.ndarray]:
    """(a digest of the words, the distinct hashes of their shingles). Texts of fewer words are one shingle, empty ones none."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    key = hashlib.blake2b(b" ".join(w), digest_size=16).digest()
    if not w:
        return key, np.empty(0, dtype=np.uint64)
    if len(known) > 200_000:
        known.clear()
    get = known.get  # long words aren't kept, so that what is kept is bounded in bytes
    h = np.fromiter((get(x) or (known.setdefault(x, xxhash.xxh64_intdigest(x)) if len(x) <= 64 else xxhash.xxh64_intdigest(x)) for x in w), dtype=np.uint64, count=len(w))
    k = min(words, len(w))
    acc = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        acc = mixed(acc * np.uint64(31) + h[i : len(h) - k + 1 + i])
    return key, np.unique(acc)


def long_print(hashes: np.ndarray) -> np.ndarray:
    """SimHash of ALL_WORDS words of 64 bits."""
    if not len(hashes):
        return np.zeros(ALL_WORDS, dtype="<u8")
    return majority(mixed(hashes[:, None] + MIX * np.arange(1, ALL_WORDS + 1, dtype=np.uint64)))


def short_words(prints: np.ndarray) -> np.ndarray:
    """The short words of long fingerprints, a row each."""
    rest, mask = prints[:, WORDS_64:], np.uint64((1 << SHORT_BITS) - 1)
    return np.stack([rest >> np.uint64(at) & mask for at in range(0, 65 - SHORT_BITS, SHORT_BITS)], axis=2).reshape(len(prints), -1).astype(np.int64)


def long_prints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, key, fp, short, n): key the same for equal word sequences, fp the bytes of the long fingerprint that are compared, short its short words, n the number of distinct shingles."""

    def make() -> Callable[[pa.RecordBatch], dict]:
        known: dict[bytes, int] = {}

        def f(batch: pa.RecordBatch) -> dict:
            found = [shingle_hashes(t.as_py(), words, known) for t in batch.column(1)]
            prints = np.stack([long_print(h) for _, h in found])
            short = pa.array(list(short_words(prints)), type=pa.list_(pa.int64()))
            return {"doc_id": batch.column(0), "key": pa.array([k for k, _ in found], type=pa.binary()), "fp": pa.array([x.tobytes() for x in prints[:, :WORDS_64]], type=pa.binary()), "short": short, "n": pa.array([len(h) for _, h in found], type=pa.int64())}

        return f

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null"), make, "doc_id long, key binary, fp binary, short array<long>, n long")


def limit_of(similarity: float, bits: int = WORDS_64 * 64, spread: float = 3.0) -> int:
    """Differing bits that sets of the given Jaccard similarity and equal size stay within but for chance (three deviations)."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * p + spread * np.sqrt(bits * p * (1 - p)))


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of each row of a and each of b."""
    out = np.zeros((len(a), len(b)), dtype=np.int32)
    for k in range(a.shape[1]):
        out += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
    return out


def forest(n: int, d: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges (i, j) of a spanning forest of links among n nodes, those of small d first."""
    some = i != j
    d, i, j = d[some], i[some], j[some]
    parent = list(range(n))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    out: list[tuple[int, int]] = []
    order = np.argsort(d, kind="stable")
    for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
        x, y = root(a), root(b)
        if x != y:
            parent[x] = y
            out.append((a, b))
    return out


def nearest_forest(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges (i, j) of a spanning forest of the links of at most `most` bits, near ones first.

    In large sets, rows within a third of the limit of a leader join it and aren't compared with each other, nor with the
    rows of a leader so far off that no two of them can link. All other pairs are compared.
    """
    n, near = len(fps), most // 3
    if n <= 64:
        d = differing(fps, fps)
        i, j = np.nonzero(d <= most)
        links = [(d[i, j], i, j)]
        if len(i) == n:
            return []
    else:
        links, rest, groups = [], np.arange(n), []
        idle = 0
        while len(rest) and len(groups) < 256 and idle < 4:
            d = differing(fps[rest[:1]], fps[rest])[0]
            close = d <= near
            idle = 0 if close.sum() > 8 else idle + 1
            groups.append(rest[close])
            links.append((d[close], np.full(close.sum(), rest[0]), rest[close]))
            rest = rest[~close]
        leaders = fps[[g[0] for g in groups]]
        apart = differing(leaders, leaders)
        asks = [(groups[i], groups[j]) for i in range(len(groups)) for j in range(i) if apart[i, j] <= most + 2 * near]
        asks.append((rest, np.arange(n)))
        for ask, of in asks:
            step = max(1, 4_000_000 // max(1, len(of)))
            for at in range(0, len(ask), step):
                d = differing(fps[ask[at : at + step]], fps[of])
                i, j = np.nonzero(d <= most)
                if len(i):
                    links.append((d[i, j], ask[at + i], of[j]))
    return forest(n, *(np.concatenate(x) for x in zip(*links, strict=True)))


def cell_edges(cell: int, words: np.ndarray, fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges (i, j) of a forest of a cell's likely links: short words within two bits and prints within `most`.

    Two words lie within two bits exactly if some word lies within a bit of both. Its point is a cell to which both are
    spread; here are the pairs whose word between has this cell as its point.
    """
    between, rows, at = [], [], 0
    home = np.ones(len(words), dtype=bool)
    for width, by in zip(widths(SHORT_SEGMENT, SHORT_BITS), scale(SHORT_SEGMENT, SHORT_BITS), strict=True):
        step = cell // by % (SHORT_SEGMENT + 3) - 1 - np.bitwise_count(words >> at & (1 << width) - 1).astype(np.int64)
        home &= step == 0
        for bit in range(at, at + width):
            set_ = words >> bit & 1
            k = np.flatnonzero(step == 1 - 2 * set_)
            between.append(words[k] ^ 1 << bit)
            rows.append(k)
        at += width
    between.append(words[home])
    rows.append(np.flatnonzero(home))
    word, row = np.concatenate(between), np.concatenate(rows)
    order = np.argsort(word, kind="stable")
    word, row = word[order], row[order]
    start = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.empty(0, dtype=np.int64)
    held = np.diff(np.append(start, len(word)))
    links = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))]
    places = np.flatnonzero(np.repeat((held > 1) & (held <= FEW_PRINTS), held))
    for by in range(1, FEW_PRINTS):
        places = places[places + by < len(word)]
        places = places[word[places] == word[places + by]]
        if not len(places):
            break
        for k in range(0, len(places), 1_000_000):
            i, j = row[places[k : k + 1_000_000]], row[places[k : k + 1_000_000] + by]
            d = sum(np.bitwise_count(fps[i, w] ^ fps[j, w]).astype(np.int64) for w in range(fps.shape[1]))
            near = d <= most
            links.append((d[near], i[near], j[near]))
    for k in np.flatnonzero(held > FEW_PRINTS):
        of = row[start[k] : start[k] + held[k]]
        if (words[of] == words[of[0]]).all() and words[of[0]] != word[start[k]]:
            continue  # equal words meet in the cell of their own point
        edges = np.array(nearest_forest(fps[of], most), dtype=np.int64).reshape(-1, 2)
        i, j = of[edges[:, 0]], of[edges[:, 1]]
        links.append((np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1, dtype=np.int64), i, j))
    return forest(len(words), *(np.concatenate(x) for x in zip(*links, strict=True)))


def likely_edges(classes: DataFrame, most: int, group: int | None = None) -> DataFrame:
    """(a, b, d): likely links of classes (rep, fp, short): some short word lies within two bits of the other's and the prints within `most`, in d bits; a forest of them for each cell.

    A range join as in `candidates`: words that are within two bits have points that share a cell once each is spread to the
    cells within one step. Cells of more than `group` prints are split and each two parts are compared.
    """
    group = group or GROUP
    words = classes.select("rep", "fp", F.posexplode("short").alias("table", "word")).withColumn("point", point(F.col("word"), SHORT_SEGMENT, SHORT_BITS))
    spread = words.select("rep", "fp", "word", "table", "point", F.explode(steps(SHORT_SEGMENT, SHORT_BITS)).alias("step"))
    rows = spread.select("rep", "fp", "word", ((F.col("point") + F.col("step")) * 16 + F.col("table")).alias("cell"))
    held = Counter()  # there are at most 2,500 cells
    for x in words.groupBy("table", "point").agg(F.count(F.lit(1)).alias("n")).collect():
        held.update({(x.point + step) * 16 + x.table: x.n for by in scale(SHORT_SEGMENT, SHORT_BITS) for step in (0, by, -by)})
    sizes = {cell: -(-n // max(1, group // 2)) for cell, n in held.items() if n > group}
    if sizes:
        parts = F.coalesce(F.create_map(*(F.lit(x).cast("long") for kv in sizes.items() for x in kv))[F.col("cell")], F.lit(1).cast("long"))
        split = rows.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")))
        split = split.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        rows = split.select("rep", "fp", "word", (F.col("cell") + F.least("own", "other") * (1 << 20) + F.greatest("own", "other") * (1 << 40)).alias("cell"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        out: list[np.ndarray] = []

        def finish() -> None:
            rep, fps, word = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            if len(rep) > 1:
                edges = np.array(cell_edges((last & (1 << 20) - 1) >> 4, word, fps, most), dtype=np.int64).reshape(-1, 2)
                if len(edges):
                    d = np.bitwise_count(fps[edges[:, 0]] ^ fps[edges[:, 1]]).sum(axis=1, dtype=np.int64)
                    out.append(np.column_stack([np.sort(rep[edges], axis=1), d]))

        def flush() -> Iterator[pa.RecordBatch]:
            for x in out:
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 1]), pa.array(x[:, 0]), pa.array(x[:, 2])], names=["a", "b", "d"])
            out.clear()

        for batch in batches:
            rep, word, cell = (batch.column(k).to_numpy() for k in (0, 2, 3))
            fps = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u8").reshape(-1, WORDS_64)
            ends = [*(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)] if len(cell) else []
            at = 0
            for end in ends:
                if cell[at] != last:
                    if held:
                        finish()
                    last = int(cell[at])
                held.append((rep[at:end], fps[at:end], word[at:end]))
                at = end
            yield from flush()
        if held:
            finish()
        yield from flush()

    return rows.repartition(CELLS_DEALT, "cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long, d long").distinct()


def few_edges(likely: DataFrame) -> DataFrame:
    """(a, b): of each node's likely links to smaller ones, those to the smallest and to the nearest. A pair of cells has forests of its own, whose links would have their sets joined over and over."""
    ends = likely.groupBy("a").agg(F.min("b").alias("lo"), F.min(F.struct("d", "b")).alias("near"))
    return ends.select("a", F.explode(F.array_distinct(F.array("lo", "near.b"))).alias("b"))


def verified(docs: DataFrame, edges: DataFrame, words: int, similarity: float) -> DataFrame:
    """The edges whose texts' shingle sets have the similarity."""

    def make() -> Callable[[pa.RecordBatch], dict]:
        known: dict[bytes, int] = {}
        return lambda batch: {"id": batch.column(0), "set": pa.array([shingle_hashes(t.as_py(), words, known)[1].view("<i8") for t in batch.column(1)], type=pa.list_(pa.int64()))}

    ids = edges.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    n = ids.count()
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids) if n <= MOST_BROADCAST else ids, "doc_id")
    sets = map_rows(texts, make, "id long, set array<long>")
    both = edges.join(sets.withColumnsRenamed({"id": "a", "set": "x"}), "a").join(sets.withColumnsRenamed({"id": "b", "set": "y"}), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b").distinct()


MOST_BROADCAST = 1_000_000  # ids, of 8 bytes each
PART_SETS, PART_HASHES = 1024, 500_000  # sets and their hashes in a part of a group; a task holds two parts
FEW = 32  # sets that share a hash and are paired one by one; hashes of more sets are counted by matrix products


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two of the sets share (above the diagonal)."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    _, token, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(token, kind="stable")
    owner, start = owner[order], np.cumsum(held) - held  # the owners of each hash, ascending
    out = np.zeros((n, n), dtype=np.float32)
    flat = out.reshape(-1)
    for size in range(2, FEW + 1):
        at = start[held == size]
        for chunk in range(0, len(at), 20_000):
            rows = owner[at[chunk : chunk + 20_000, None] + np.arange(size)]
            for i in range(size - 1):
                np.add.at(flat, (rows[:, i, None] * n + rows[:, i + 1 :]).reshape(-1), 1)
    many = np.flatnonzero(held > FEW)
    for chunk in range(0, len(many), 1024):
        part = many[chunk : chunk + 1024]
        x = np.zeros((n, len(part)), dtype=np.float32)
        for k, t in enumerate(part):
            x[owner[start[t] : start[t] + held[t]], k] = 1
        out += x @ x.T
    return out


def exact_links(sets: list[np.ndarray], labels: list[int], similarity: float) -> list[tuple[int, int]]:
    """Pairs of labels, larger first, that join all labels between which two sets have the Jaccard similarity; a spanning forest of them."""
    parent = {x: x for x in labels}
    if len(parent) < 2:
        return []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    sizes, common = np.array([len(x) for x in sets], dtype=np.int64), common_counts(sets)
    of = np.unique(labels, return_inverse=True)[1]
    out = []
    for i in range(len(sets) - 1):
        both = common[i, i + 1 :].astype(np.int64)
        for j in np.flatnonzero((both > 0) & (of[i + 1 :] != of[i]) & (both >= similarity * (sizes[i] + sizes[i + 1 :] - both))) + i + 1:
            x, y = root(labels[i]), root(labels[j])
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((max(x, y), min(x, y)))
    return out


def links_within(docs: DataFrame, members: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b): labels to join, so that in each group any two of members (node, group, label, n) whose sets have the similarity are together.

    Each two members of a group are compared on the sets. Groups of many members or hashes are split, and each two parts are compared in one place.
    """

    def make() -> Callable[[pa.RecordBatch], dict]:
        known: dict[bytes, int] = {}
        return lambda batch: {"node": batch.column(0), "label": batch.column(2), "unit": batch.column(3), "set": pa.array([shingle_hashes(t.as_py(), words, known)[1].view("<i8") for t in batch.column(1)], type=pa.list_(pa.int64()))}

    sizes = members.groupBy("group").agg(F.ceil(F.greatest(F.count(F.lit(1)) / PART_SETS, F.sum("n") / PART_HASHES, F.lit(1.0))).alias("parts"))
    own, other = F.pmod(F.xxhash64("node"), F.col("parts")), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    units = F.transform(other, lambda o: F.xxhash64("group", F.least(own, o), F.greatest(own, o)))
    ids = cut(members.join(sizes, "group").select("node", "label", units.alias("unit")))
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST // 10 else ids, "node")
    sets = map_rows(texts.select("node", "text", "label", "unit"), make, "node long, label long, unit array<long>, set array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, found, labels, out = None, [], [], []
        for batch in batches:
            at, values = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy()
            for i, (unit, label) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if unit != last:
                    out += exact_links(found, labels, similarity)
                    last, found, labels = unit, [], []
                found.append(values[at[i] : at[i + 1]].copy())
                labels.append(label)
        out += exact_links(found, labels, similarity)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    spread = sets.select(F.explode("unit").alias("unit"), "label", "set")
    return spread.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "a long, b long").distinct()


def similar_components(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, key, component_id) for documents with a doc_id: those whose sets of word shingles have the given Jaccard similarity link.

    The short words of a SimHash of 512 bits find likely links, by a grid of segment popcounts, and two for each document are verified on the sets. These aren't each
    link, so where a group of likely links is left in several verified parts, its sets are
    all compared across the parts. Equal word sequences are one class.
    """
    prints = cut(long_prints(docs, words))
    classes = prints.groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("fp").alias("fp"), F.min("short").alias("short"), F.min("n").alias("n"))
    likely = cut(likely_edges(classes.select("rep", "fp", "short"), limit_of(similarity)))
    parts = cut(connected_components(verified(docs, cut(few_edges(likely)), words, similarity)))
    groups = connected_components(likely).withColumnRenamed("component", "group")
    labelled = cut(groups.join(parts, "node", "left").select("node", "group", F.coalesce("component", "node").alias("label")))
    split = labelled.groupBy("group").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("group")
    sizes = classes.groupBy(F.col("rep").alias("node")).agg(F.sum("n").alias("n"))
    more = connected_components(links_within(docs, labelled.join(split, "group").join(sizes, "node"), words, similarity))
    joined = labelled.join(more.withColumnsRenamed({"node": "label", "component": "whole"}), "label", "left").select(F.col("node").alias("rep"), F.coalesce("whole", "label").alias("component"))
    of_class = classes.select("key", "rep").join(joined, "rep", "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    return prints.select("doc_id", "key").join(of_class, "key")


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near copies: of each component the document with the smallest doc_id stays, once. Rows without a doc_id stay."""
    found = cut(similar_components(docs.select("doc_id", "text"), words, similarity))
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    n = gone.count()
    out = docs.join(F.broadcast(gone) if n <= MOST_BROADCAST else gone, "doc_id", "left_anti")
    repeated = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if repeated.isEmpty():
        return out.select(*docs.columns)
    # Rows of one doc_id: the first by text stays where they belong together.
    turn = F.row_number().over(Window.partitionBy(F.coalesce(F.col("doc_id"), F.xxhash64(F.monotonically_increasing_id()))).orderBy("text"))
    return out.withColumn("__turn", turn).where((F.col("__turn") == 1) | F.col("doc_id").isNull()).select(*docs.columns)
