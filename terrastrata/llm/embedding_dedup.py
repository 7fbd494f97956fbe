"""Near-duplicate vectors by p-stable hashing: quantised Gaussian projections bucket normalised vectors in several tables, exact cosines decide.

Vectors compare only under equal, non-null labels and of equal lengths. Vectors that are null, empty, zero or hold null or
non-finite components, and rows without a vec_id or a label, link with nothing (a null vec_id has a null component_id and
kept false). Equal vectors of a label form one class and are compared once; a class of n counts n times. A bucket of more
than BLOCK classes is cut into blocks, and each pair of blocks is a unit of work of its own, so a hot bucket spreads over
many tasks and no task holds more than two blocks. A pair that meets in several tables counts in the first.

Chance that a pair at the threshold itself meets (recall at its worst): 1 - (1 - p^K)^L with p = 0.85 for cosine 0.93 at
WIDTH 2, K = 10 and L = 14: 0.95; closer pairs meet more surely (0.99 at cosine 0.95). Repeated rows count as vectors of
their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, cut

COSINE = 0.93
TABLES, PROJECTIONS, WIDTH, SEED = 14, 10, 2.0, 20
BLOCK = 1024


class Hashes:
    """The tables' hash functions, made for each length of vectors that comes."""

    def __init__(self, tables: int, projections: int, width: float, seed: int):
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.shape, self.width, self.seed = (tables, projections), width, seed
        self.mix = np.random.default_rng(seed).integers(1, 2**63, size=projections, dtype=np.uint64) | np.uint64(1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """(n, dims) normalised -> (n, tables) longs."""
        dims, (tables, k) = x.shape[1], self.shape
        if dims not in self.of:
            r = np.random.default_rng([self.seed, dims])
            self.of[dims] = r.standard_normal((dims, tables * k)), r.uniform(0, self.width, tables * k)
        a, b = self.of[dims]
        q = np.floor((x @ a + b) / self.width).astype(np.int64).reshape(len(x), tables, k).astype(np.uint64)
        return np.bitwise_xor.reduce((q + np.uint64(0x9E3779B97F4A7C15)) * self.mix * (q * np.uint64(2) + np.uint64(0xBF58476D1CE4E5B9)), axis=2).astype(np.int64)


def unit(values: list | None) -> np.ndarray | None:
    """The vector at length 1, in double precision; None if it can link with nothing."""
    if not values or any(v is None for v in values):
        return None
    x = np.asarray(values, dtype=np.float64)
    if not np.isfinite(x).all() or not (top := np.abs(x).max()) > 0:
        return None
    x = x / top  # squares of very large or small components stay finite
    return x / np.sqrt(x @ x)


def classed(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vec, digest): vec at length 1, digest the same for equal vectors of a label; both null for rows that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            xs = [None if i is None or k is None else unit(v) for i, v, k in zip(ids, batch.column(1).to_pylist(), labels, strict=True)]
            digests = [None if x is None else hashlib.blake2b(repr(k).encode() + b"|" + (x + 0.0).tobytes(), digest_size=16).digest() for x, k in zip(xs, labels, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([str(k) if k is not None else None for k in labels]), pa.array([None if x is None else x for x in xs], type=pa.list_(pa.float64())), pa.array(digests, type=pa.binary())], names=["vec_id", "label", "vec", "digest"])

    return vectors.select(F.col("vec_id").cast("long"), "embedding", "label").mapInArrow(run, "vec_id long, label string, vec array<double>, digest binary")


def signed(classes: DataFrame, tables: int, projections: int, width: float, seed: int) -> DataFrame:
    """Adds sigs, a long for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(tables, projections, width, seed)
        for batch in batches:
            vecs = batch.column(batch.schema.get_field_index("vec")).to_pylist()
            sigs: list = [None] * len(vecs)
            for dims in {len(v) for v in vecs}:
                at = [i for i, v in enumerate(vecs) if len(v) == dims]
                for i, s in zip(at, hashes(np.array([vecs[i] for i in at])), strict=True):
                    sigs[i] = s
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigs, type=pa.list_(pa.int64()))], names=[*batch.schema.names, "sigs"])

    fields = ", ".join(f"{n} {t}" for n, t in classes.dtypes)
    return classes.mapInArrow(run, f"{fields}, sigs array<long>")


def linked(a: dict, b: dict | None, table: int, cosine: float) -> Iterator[tuple[int, int, int]]:
    """(rep, links, low) for the links among a's rows, or between a's and b's: the vectors linked and a smallest rep to join."""
    other = a if b is None else b
    near = a["x"] @ other["x"].T >= cosine
    if b is None:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    if table and len(i):
        first = ~(a["sigs"][i, :table] == other["sigs"][j, :table]).any(axis=1)
        i, j = i[first], j[first]
    if not len(i):
        return
    reps = np.concatenate([a["rep"], other["rep"]]) if b is not None else a["rep"]
    weight = np.concatenate([a["n"], other["n"]]) if b is not None else a["n"]
    j = j + len(a["rep"]) * (b is not None)
    links = np.bincount(i, weights=weight[j], minlength=len(reps)) + np.bincount(j, weights=weight[i], minlength=len(reps))
    parent = np.arange(len(reps))
    while True:  # labels fall to the smallest rep of each component
        low = parent.copy()
        np.minimum.at(low, i, parent[j])
        np.minimum.at(low, j, parent[i])
        low = low[low]
        if (low == parent).all():
            break
        parent = low
    for k in np.nonzero(links)[0]:
        yield int(reps[k]), int(links[k]), int(reps[parent[k]])


def compared(units: DataFrame, cosine: float) -> DataFrame:
    """units: (unit, side, t, rep, n, vec, sigs), sorted by unit and side within partitions. A unit's rows of side 0 are compared with those of side 1, or among themselves where there is no side 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple[int, int, int]] = []

        def finish() -> None:
            sides = []
            for s in (0, 1):
                if part := [r for r in held if r[1] == s]:
                    sides.append({"rep": np.array([r[3] for r in part]), "n": np.array([r[4] for r in part], dtype=np.float64), "x": np.array([r[5] for r in part]), "sigs": np.array([r[6] for r in part])})
            if held and held[0][7] == 2 and len(sides) == 2:
                out.extend(linked(sides[0], sides[1], held[0][2], cosine))
            elif held and held[0][7] == 1 and len(held) > 1:
                out.extend(linked(sides[0], None, held[0][2], cosine))
            held.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*out, strict=True)], names=["rep", "links", "low"])
                out.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    finish()
                held.append(row)
            yield from flush()
        finish()
        yield from flush()

    return units.mapInArrow(run, "rep long, links long, low long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label)."""
    rows = cut(classed(vectors))
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    classes = cut(signed(classes, tables, projections, width, seed))
    lean = classes.select("rep", "label", F.size("vec").alias("dims"), F.posexplode("sigs").alias("t", "sig")).select("rep", "t", F.xxhash64("t", "label", "dims", "sig").alias("key"))
    sizes = lean.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key", F.ceil(F.col("size") / block).alias("blocks"))
    placed = lean.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    units = placed.select("rep", "t", "key", "own", other.alias("other")).select(
        "rep", "t",
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("unit"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"),
        F.when(F.col("own") == F.col("other"), 1).otherwise(2).alias("sides"),
    )
    full = units.join(classes.select("rep", "n", "vec", "sigs"), "rep").select("unit", "side", "t", "rep", "n", "vec", "sigs", "sides")
    found = cut(compared(full.repartition("unit").sortWithinPartitions("unit", "side", "rep"), cosine))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    of_class = classes.select("digest", "rep", "n").join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = rows.select("vec_id", "digest").join(of_class, "digest", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
