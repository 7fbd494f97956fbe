"""The corpus pipeline. Each stage takes (spark, docs, sf_dir), docs being what the stage before it left; all but the last return the columns of documents.

toxicity     documents that score as toxic go; the model is fitted on the labelled rows among docs
line_dedup   later occurrences of three-line windows go, n_chars follows; every document stays
simhash      of each group of near copies (five-word shingles, similarity 0.8 and more) the one with the smallest doc_id stays
mixing       each source's seeded prefix within its share of the token budget (0.8 of all tokens, one epoch) stays
pieces       adds the SentencePiece ids (best segmentation), their number, and the scores, junctions and changes of the N best

Null and empty texts aren't toxic, have no lines to lose, are near copies of one another (one of each stays: the null or
empty text with the smallest doc_id), cost no tokens and have no pieces. Rows without a doc_id are never near copies of others;
of rows that share one, the first by text stays where near-dedup finds them alike. Ties go to the smallest doc_id. Very long
texts are read whole by every stage. An empty table gives an empty result. Other columns pass through; the last stage
replaces columns named ids, scores, junctions, changes or n_pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastrata.llm import line_dedup, mixing, pieces, simhash, toxicity
from terrastrata.llm.common import checkpoint_dir


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs, model, "__score", "__predicted").where("__predicted = 0").select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduped(docs, dropped="__dropped").select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, epoch="__epoch", fraction=0.8, max_epochs=1).select(*docs.columns)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Workers keep less than in a run of its own: the stages before have filled the executors' heaps.
    return pieces.encoded(docs, cache_bytes=32 << 20).withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_stage),
    ("source_mixing", mixing_stage),
    ("sentencepiece", pieces_stage),
]

#: SQL can't express the fitted scores or the segmentations; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def removed(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet beside the checkpoints and read again. A stage's folder goes when the next one is written; the last one's stays, since the result reads it."""
    folder, before = f"pipeline-{uuid.uuid4().hex}", None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{checkpoint_dir(spark)}/{folder}/{k}_{name}"
            docs.write.parquet(path)
            if before:
                removed(spark, before)
            docs, before = spark.read.parquet(path), path
    return docs
