"""Preparation of a training corpus: five stages, each over all that the one before it kept.

Every stage but the last returns the columns of documents. Nulls, blanks, repeated rows, empty tables
and further columns are treated as the operators' docstrings say. The stages take the labels, where
they need them, from the folder of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm.near_dups import keep_one
from glyphmill.llm.packing import packed
from glyphmill.llm.quality import resample
from glyphmill.llm.queries import VOCABULARY
from glyphmill.llm.scratch import Scratch
from glyphmill.llm.secrets import redact
from glyphmill.llm.substrings import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects; null and blank texts go."""
    return resample(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact or near copies."""
    return keep_one(spark, docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words and more that occur elsewhere, but for one place of each; n_chars anew."""
    return remove_repeats(spark, docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by a mark; n_chars anew; every document stays."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(window_id, doc_id, start_token, n_tokens): what each training window holds, by the tokens of op1's vocabulary."""
    return packed(spark, docs, tokenizer=VOCABULARY)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("secrets", secret_redaction), ("packing", packing)]

# sampling by hashed models, sketches and bitset packing aren't expressible in SQL; tests/llm has brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        after = scratch.put(stage(spark, docs, sf_dir))
        if i:
            scratch.drop(docs)
        docs = after
    return docs
