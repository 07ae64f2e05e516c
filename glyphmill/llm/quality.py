"""Importance resampling of documents by two hashed n-gram models.

Words and runs of punctuation, and pairs of neighbours, are hashed to ``BUCKETS`` features. The
target model counts them in documents labelled as good (at most ``fit_rows`` of them, those with
the least hashes of their ids), the raw model in all documents. A document's weight is the log of
the ratio of its probabilities under both; the k greatest weights plus Gumbel noise stay. k is the
expected number of good documents: the sum of min(1, share of good labels x ratio). The target model
is smoothed towards the raw one with ``PRIOR`` counts a bucket, so that a small target's noise does
not speak against documents that are not in it.

Defined results: a null or blank text is not selected; noise is a hash of the seed, the id and the
text, so that repeated rows share one fate; rows that tie with the last one all stay; without a good
label every document with a word stays; a document with contradictory labels is not in the target.
Weights are sums of fixed-point numbers, alike in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from glyphmill.llm import columns as cs
from glyphmill.llm import textvec as tv
from glyphmill.llm.scratch import Scratch

BUCKETS, FIT_ROWS, SEED, SCALE, PRIOR = 1 << 14, 20_000, 20240229, 1 << 16, 8
KINDS = np.full(256, 2, np.uint8)
KINDS[tv.SPACE] = 0
KINDS[[i for i in range(256) if i >= 128 or chr(i).isalnum() or i == 95]] = 1


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and pairs of neighbours, those of a text together, and how many each text has."""
    w = tv.words(data, offsets, KINDS)
    if not len(w):
        return np.zeros(0, np.int64), w.count
    h = w.hashes()
    pair = tv.mix(h * np.uint64(tv.BASES[1]) + np.roll(h, -1))
    both = np.stack([h, pair], 1) >> np.uint64(50)
    n = 2 * w.count
    inside = np.ones(both.size, bool)
    ends = 2 * w.last[w.count > 0] - 1  # the last word has no neighbour
    inside[ends] = False
    return both.ravel()[inside].astype(np.int64), np.maximum(n - 1, 0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for rows, data, offsets in tv.chunks(batches, "text"):
        f, n = features(data, offsets)
        raw += np.bincount(f, minlength=BUCKETS)
        good = rows.column("good").to_numpy(zero_copy_only=False).astype(bool)
        target += np.bincount(f[np.repeat(good, n)], minlength=BUCKETS)
    seen = np.flatnonzero(raw)
    if len(seen):
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(raw[seen]), pa.array(target[seen])], ["bucket", "raw", "target"])


def sortable(x: np.ndarray) -> np.ndarray:
    """int64 in the order of the doubles."""
    bits = np.ascontiguousarray(x, np.float64).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def weigher(table: np.ndarray):
    """The weight of each text in log units x SCALE; null where it has no word."""

    def weigh(column: pa.Array) -> pa.Array:
        data, offsets = tv.buffers(column)
        out, has, at = np.zeros(len(column), np.int64), np.zeros(len(column), bool), 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + tv.CHUNK, "right")) - 1)
            f, n = features(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            if len(f):
                sums = np.concatenate([[0], np.cumsum(table[f])])
                ends = np.cumsum(n)
                out[at:to], has[at:to] = sums[ends] - sums[ends - n], n > 0
            at = to
        return pa.array(out, mask=~has)

    return F.arrow_udf(weigh, LongType()).asNondeterministic()  # once, also where it is filtered by: else each task holds two Python workers


def gumbel(row: F.Column, seed: int = SEED) -> F.Column:
    """Standard Gumbel noise, fixed by the row."""
    u = (F.xxhash64(F.lit(seed), row).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_greatest(table: DataFrame, column: str, k: int) -> int | None:
    """The k-th greatest int64 of a column by four counts of 16 bits each; None if there are fewer."""
    low, found = F.lit(None), None
    part = table
    for shift in (48, 32, 16, 0):
        counts = sorted(part.groupBy(F.shiftright(column, shift).alias("p")).count().collect(), reverse=True)
        for p, n in counts:
            if k <= n:
                found = p
                break
            k -= n
        else:
            return None
        part = table.filter(F.shiftright(column, shift) == found)
    return found


def _good(labels: DataFrame, id_col: str, fit_rows: int) -> DataFrame:
    agreed = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min("quality").alias("q"))
    return agreed.filter("q = 1").orderBy(F.xxhash64("__id"), "__id").limit(fit_rows).select("__id", F.lit(True).alias("good"))


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS, columns: list[str] | None = None) -> tuple[DataFrame, int | None, str, str]:
    """docs, or those of its columns, with __weight (x SCALE, null without a word) and __rank (its order with noise), and the least rank that stays (None: all with a word), and the two columns' names, which docs doesn't have.

    Texts are read twice: for the raw model's counts, and for the weights, which are written with the columns.
    """
    good = _good(labels, id_col, fit_rows)  # bounded by fit_rows, therefore broadcast
    source = docs.select(cs.col(id_col).alias("__id"), cs.col(text).alias("text")).filter("text is not null").join(F.broadcast(good), "__id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    counts = source.mapInArrow(_count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, r, t in counts:
        raw[bucket], target[bucket] = r, t
    share = labels.filter("quality is not null").agg(F.avg(F.col("quality").cast("double"))).first()[0]
    known = target.sum() > 0
    mean = (raw + 0.5) / (raw.sum() + 0.5 * BUCKETS)
    prior = PRIOR * BUCKETS * mean
    ratio = np.log((target + prior) / (target.sum() + prior.sum()) / mean) if known else np.zeros(BUCKETS)
    table = np.rint(ratio * SCALE).astype(np.int64)
    key = F.struct(cs.col(id_col), cs.col(text))
    log, rank = cs.free(docs, "__weight", "__rank")
    weighed = docs.filter(cs.col(text).isNotNull()).withColumn(log, weigher(table)(cs.col(text)))
    noisy = F.col(log) / F.lit(float(SCALE)) + gumbel(key)
    ranked = weighed.withColumn(rank, F.round(noisy * F.lit(float(1 << 32))).cast("long"))
    kept = [cs.col(c) for c in columns or docs.columns]
    ranks = Scratch(spark, "quality").put(ranked.filter(F.col(log).isNotNull()).select(*kept, log, rank))
    if not known:
        return ranks, None, log, rank
    expected = ranks.agg(F.sum(F.least(F.lit(1.0), F.lit(float(share)) * F.exp(F.least(F.lit(50.0), F.col(log) / F.lit(float(SCALE))))))).first()[0]
    k = round(expected or 0)
    least = kth_greatest(ranks.select(F.col(rank).alias("rank")), "rank", k) if k else (1 << 63) - 1
    return ranks, least, log, rank


def resample(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS, weight: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """The selected rows of docs, or those of its columns, with their weight in a column of that name if one is given."""
    ranked, least, log, rank = scored(spark, docs, labels, id_col, text, fit_rows, columns)
    stays = ranked if least is None else ranked.filter(F.col(rank) >= F.lit(least))
    extra = [F.round(F.col(log) / F.lit(float(SCALE)), 4).alias(weight)] if weight else []
    return stays.select(*[cs.col(c) for c in columns or docs.columns], *extra)
