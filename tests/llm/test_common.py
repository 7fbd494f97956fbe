import time
from pathlib import Path

from pyspark.sql import functions as F

from terrastrata.llm import common as C


def shuffle_files(spark):
    """Data files of shuffles below the folders of the block manager."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {str(p) for d in dirs for p in Path(d).rglob("shuffle_*.data")}


def left_over(spark, before):
    for _ in range(50):  # they go in the background
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.2)
    return left


def test_shuffles_go_with_a_cut(spark):
    set_before, before = spark.conf.get(C.SHUFFLES_GO), shuffle_files(spark)
    df = spark.range(1000).groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n")).repartition(3, "k")
    out = C.cut(df)
    assert not left_over(spark, before)
    assert out.count() == 100 and out.agg(F.sum("n")).first()[0] == 1000 and C.cut(df).count() == 100
    assert spark.conf.get(C.SHUFFLES_GO) == set_before


def test_rounds_of_components_leave_no_shuffles_of_rows(spark):
    before = shuffle_files(spark)
    edges = spark.createDataFrame([(i, i + 1) for i in range(500) if i % 50 != 49], "a long, b long")
    found = C.connected_components(edges).collect()
    assert {x.node: x.component for x in found} == {i: i - i % 50 for i in range(500)}
    for _ in range(50):
        left = shuffle_files(spark) - before
        if len(left) <= 40:
            break
        time.sleep(0.2)
    assert sum(Path(p).stat().st_size for p in left if Path(p).exists()) < 40_000
