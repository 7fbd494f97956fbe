"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Where it is unset, a local master gets a temporary folder; a cluster gets an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read from there: its lineage ends, and lost executors don't take it along.

    The shuffle files that led to it go at once. They would stay until the driver collects its garbage, those of all
    rounds of an iteration side by side. The setting is read when a plan is made, so df gets a plan of its own.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Long texts go to Python in batches of a few rows. This sets the session's bound of rows, which lazy results read when they run; bytes are bounded by the session's own arrow.maxBytesPerBatch."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


_kept: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What a worker process keeps for an operator from task to task. That of any other goes: a worker keeps one operator's things at a time."""
    for other in [x for x in _kept if x != owner]:
        del _kept[other]
    return _kept.setdefault(owner, {})


def map_rows(df: DataFrame, make, schema: str, owner: str = "") -> DataFrame:
    """mapInArrow by a function that is made once a task: make() returns f(batch) -> dict of columns. owner names the operator if it keeps things in the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(owner)
        f = make()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(f(batch))

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge, component being the smallest node reachable.

    edges: columns a and b of an orderable type; rows with a null or a = b are ignored. Alternating large-star and
    small-star rounds: each is a minimum by node (pre-aggregated) and a join on the node (which Spark can split when a
    hub is hot), so no neighbourhood is ever gathered in one place. Rounds grow with the logarithm of the graph.
    """

    def stars(both: DataFrame) -> DataFrame:
        return both.groupBy("u").agg(F.min("v").alias("m"))

    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = stars(both).select(F.col("u").alias("x"), F.least("m", "u").alias("m"))
        large = both.where("v > u").join(m, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        m = stars(large).select(F.col("u").alias("x"), "m")
        joined = large.join(m, F.col("u") == F.col("x"))
        small = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("s")).select("s.*").where("u <> v").distinct()
        e = cut(small)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
