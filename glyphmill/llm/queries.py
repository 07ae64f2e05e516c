"""The registered queries of this package: each operator over its whole table, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import bpe, mtree, near_dups, packing, quality, secrets, sql, substrings, token_counts, toxic_crf, vector_graph

#: Folder of the public vocabulary files, the same on every machine.
TOKENIZERS = os.environ.get("GLYPHMILL_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
#: The ids that are divisible by it are op10's queries.
EVERY = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), VOCABULARY)


def op2_embedding_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.near_groups(spark, table(spark, sf_dir, "embeddings"))


def op3_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_crf.toxic_spans(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(spark, table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_quality_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.resample(spark, docs, table(spark, sf_dir, "labels"), weight="log_weight", columns=["doc_id"])


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the tokens of op1's vocabulary."""
    return packing.packed(spark, table(spark, sf_dir, "documents"), tokenizer=VOCABULARY)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every row whose id is divisible by EVERY, among all rows."""
    return mtree.nearest(spark, table(spark, sf_dir, "embeddings"), queries=F.col("id") % EVERY == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_counts, op2_embedding_near_dups, op3_toxic_spans, op4_repeated_passages, op5_secret_scan, op6_quality_resample, op7_near_duplicates, op8_packing, op9_bpe, op10_exact_top_k)
}
ORACLE: dict[str, str] = {
    "op2_embedding_near_dups": sql.near_groups(vector_graph.THRESHOLD),
    "op4_repeated_passages": sql.repeated_passages(substrings.MIN_WORDS),
    "op5_secret_scan": sql.secrets(secrets.WINDOW, secrets.THRESHOLDS, secrets.ALLOWED, secrets.UNIT),
    "op10_exact_top_k": sql.nearest(mtree.K, EVERY),
}
