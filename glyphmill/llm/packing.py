"""Packing of documents into windows of a fixed number of tokens by minimum bin slack.

Documents are dealt by hash to groups of about ``GROUP`` and each group is packed on its own. A
window takes the longest piece that is left; the multiset of remaining lengths whose sum comes
closest to the rest is found by subset sums in a bitset, one bit a sum, and walked back to a count of
each length; the same multiset then fills as many windows as the counts allow. A document of more
tokens than a window fills whole windows, and the rest of it is packed like any other.

A text's tokens are those of ``tokenizer``, a file of ranks, or the numbers in a column ``tokens``
that docs has already. Defined results: a null or empty text, or one with null or no tokens, is in no
window; repeated rows are packed each; ties in length go by id (null last), then by the text's hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import columns as cs
from glyphmill.llm.scratch import Scratch
from glyphmill.llm.token_counts import token_counts

CAPACITY, GROUP = 2048, 40_000


def closest(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """How many of each length, of the counts, sum closest to ``room`` from below; ``lengths``: descending."""
    if room <= 0:
        return {}
    full, mask = 1 << room, (1 << (room + 1)) - 1
    reach, steps = 1, []
    for n in lengths:
        if n > room:
            continue
        most = min(counts[n], room // n)
        steps.append((n, most, reach))
        left, k = most, 1
        while left:  # 1, 2, 4 .. of them, and the rest
            k = min(k, left)
            reach |= reach << (n * k)
            left -= k
            k *= 2
        reach &= mask
        if reach & full:
            break
    total, used = reach.bit_length() - 1, {}
    for n, most, before in reversed(steps):
        k = 0
        while not before >> total & 1:
            total -= n
            k += 1
        if k:
            used[n] = k
    return used


def pack(lengths: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Multisets of lengths, each with the number of windows it fills; together they use every length once."""
    values, n = np.unique(lengths, return_counts=True)
    counts = dict(zip(values.tolist(), n.tolist(), strict=True))
    order = sorted(counts, reverse=True)
    out = []
    while order:
        top = order[0]
        counts[top] -= 1
        if not counts[top]:
            order.pop(0)
        used = closest(counts, order, capacity - top)
        counts[top] += 1
        used[top] = used.get(top, 0) + 1
        times = min(counts[x] // k for x, k in used.items())
        gone = False
        for x, k in used.items():
            counts[x] -= k * times
            gone |= not counts[x]
        if gone or not order or order[0] != top:
            order = [x for x in ([top] if not order or order[0] != top else []) + order if counts[x]]
        out.append((used, times))
    return out


def _pack_group(id_col: str, capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n", "ascending"), (id_col, "ascending"), ("key", "ascending")])
        n = table.column("n").to_numpy()
        whole, rest = n // capacity, n % capacity
        some = np.flatnonzero(rest)
        some = some[np.argsort(rest[some], kind="stable")]
        sizes = rest[some]
        windows, rows, starts, tokens = [], [], [], []
        w = 0
        long = np.flatnonzero(whole)
        for i, k in zip(long.tolist(), whole[long].tolist(), strict=True):
            windows += range(w, w + k)
            rows += [i] * k
            starts += range(0, k * capacity, capacity)
            tokens += [capacity] * k
            w += k
        at = {int(v): (int(lo), int(hi)) for v, lo, hi in zip(*[np.unique(sizes), np.searchsorted(sizes, np.unique(sizes)), np.searchsorted(sizes, np.unique(sizes), "right")], strict=True)}
        taken = {v: lo for v, (lo, _) in at.items()}
        for used, times in pack(sizes, capacity):
            for _ in range(times):
                for v in sorted(used, reverse=True):
                    for i in some[taken[v] : taken[v] + used[v]].tolist():
                        windows.append(w)
                        rows.append(i)
                        starts.append(int(whole[i]) * capacity)
                        tokens.append(v)
                    taken[v] += used[v]
                w += 1
        group = table.column("grp")[0].as_py()
        which = pa.array(rows, pa.int64())
        return pa.table([pa.array((group << 32) + np.array(windows, np.int64)), table.column(id_col).take(which), pa.array(starts, pa.int64()), pa.array(tokens, pa.int32())], names=["window_id", id_col, "start_token", "n_tokens"])

    return run


def _counted(docs: DataFrame, id_col: str, text: str, tokenizer: str | None, tokens: str | None) -> DataFrame:
    """(id, key, n) of each row: its text's hash and tokens."""
    key = F.xxhash64(cs.col(text)).alias("key")
    if tokens:
        return docs.select(F.col(id_col), key, cs.col(tokens).cast("long").alias("n"))
    if not tokenizer:
        raise ValueError("packing needs a tokenizer's file or a column of token counts")
    rows = docs.select(F.struct(F.col(id_col).alias("id"), key).alias("who"), F.col(text).alias("text"))
    return token_counts(rows, tokenizer, "who", "text").select(F.col("who.id").alias(id_col), "who.key", F.col("n_tokens").alias("n"))


def packed(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, group: int = GROUP, tokenizer: str | None = None, tokens: str | None = None) -> DataFrame:
    """(window_id, doc_id, start_token, n_tokens): the piece of the document that each window holds."""
    kind = docs.schema[id_col].dataType.simpleString()
    scratch = Scratch(spark, "packing")
    lengths = scratch.put(_counted(docs, id_col, text, tokenizer, tokens).filter("n > 0"))
    groups = max(1, -(-lengths.count() // group))
    dealt = lengths.withColumn("grp", F.pmod(F.xxhash64(F.col(id_col), F.col("key")), F.lit(groups)))
    return dealt.groupBy("grp").applyInArrow(_pack_group(id_col, capacity), f"window_id long, `{id_col}` {kind}, start_token long, n_tokens int")
