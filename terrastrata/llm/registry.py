"""The queries of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_template, embedding_dedup, fingerprints, line_dedup, mixing, pieces, pii, secret_scan, simhash, toxicity

QUERIES = [
    fingerprints.op1_document_fingerprints,
    secret_scan.op2_secret_scan,
    mixing.op3_source_mixing,
    pieces.op4_sentencepiece,
    toxicity.op5_toxicity,
    simhash.op6_simhash_near_dedup,
    embedding_dedup.op7_embedding_near_dedup,
    line_dedup.op8_line_dedup,
    chat_template.op9_chat_formatting,
    pii.op10_pii,
]
SQL: dict[str, str] = {"op2_secret_scan": secret_scan.SQL, "op8_line_dedup": line_dedup.SQL, "op9_chat_formatting": chat_template.SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
