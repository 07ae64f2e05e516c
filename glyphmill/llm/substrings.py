"""Substring deduplication by level-wise doubling.

A passage repeats when a window of at least ``min_words`` words occurs twice, in two texts or at two
places of one. Levels: windows of ``min_words`` / 2 words at winnowed anchors (any repeated passage
of ``min_words`` words holds an anchor whose window repeats), then windows of ``min_words`` words at
every place around the anchors that repeat, and from there on windows of twice the length wherever
both halves repeat, until no candidate is left. Texts are read once for the anchors and once for the
first full level; longer windows are combined from the hashes of their halves.

Defined results: rows with the same id and text are one document; a null, blank or shorter text has
no repeated passage; a text of which several documents hold copies repeats as a whole; no other
column than the id and the text is read. Texts are told apart by 128 bits of hash. At 64 bits, n
windows collide n^2 / 2^65 times, and a false repeat has to collide at the anchor and at the first
level alike.

A window that occurs more than some ``HOT`` times, found by its count in one of ``SHARE`` texts, isn't
gathered in one task: its first and last place are aggregated before they are shuffled and joined
back. The sample decides the way only; all windows are counted either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from glyphmill.llm import columns as cs
from glyphmill.llm import textvec as tv
from glyphmill.llm.scratch import Scratch

MIN_WORDS, HOT, SHARE = 50, 4_000_000, 1000
WINDOW = "h long, key long, pos int"
STEP = "kind int, key long, pos int, to int, h long"
SPANS, CUTS, WINDOWS = 0, 1, 2


def _anchors(half: int, width: int):
    """Windows of ``half`` words that are least among ``width`` neighbours in their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tv.chunks(batches, "text"):
            w = tv.words(data, offsets)
            n = len(w)
            if n < half + width - 1:
                continue
            last = np.repeat(w.last, w.count)
            grams = np.full(n, np.iinfo(np.uint64).max, np.uint64)
            at = np.flatnonzero(np.arange(n) + half <= last)
            grams[at] = tv.Hasher(w.hashes()).of(at, at + half)
            least = tv.slide(grams, width, np.minimum)
            j = np.arange(len(least))
            least[j + width - 1 + half > last[: len(least)]] = 0
            padded = np.zeros(n + width - 1, np.uint64)
            padded[width - 1 : width - 1 + len(least)] = least
            chosen = at[tv.slide(padded, width, np.maximum)[at] == grams[at]]
            text = w.text[chosen]
            keys = rows.column("key").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(tv.signed(grams[chosen])), pa.array(keys[text]), pa.array((chosen - w.first[text]).astype(np.int32))], ["h", "key", "pos"])

    return run


def _around(half: int, length: int):
    """Windows of ``length`` words at all places that hold one of the text's repeated anchors; the first of neighbours with the same key counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tv.chunks(batches, "text"):
            w = tv.words(data, offsets)
            keys = rows.column("key").to_numpy()
            lists = rows.column("anchors")
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            anchors = lists.flatten().to_numpy().astype(np.int64)
            sizes_ok = sizes.copy()
            sizes_ok[1:][keys[1:] == keys[:-1]] = 0
            take = tv.spread(np.cumsum(sizes) - sizes, sizes_ok)
            text = np.repeat(np.arange(len(keys)), sizes_ok)
            middle = w.first[text] + anchors[take]
            low, high = np.maximum(w.first[text], middle - (length - half)), np.minimum(middle, w.last[text] - length)
            marks = np.zeros(len(w) + 1, np.int32)
            fits = low <= high
            np.add.at(marks, low[fits], 1)
            np.add.at(marks, high[fits] + 1, -1)
            at = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
            if not len(at):
                continue
            h = tv.Hasher(w.hashes(), tv.BASES[1]).of(at, at + length)
            of = np.searchsorted(w.first, at, "right") - 1
            of = np.where(w.count[of] > 0, of, np.searchsorted(w.last, at, "right"))
            yield pa.RecordBatch.from_arrays([pa.array(tv.signed(h)), pa.array(keys[of]), pa.array((at - w.first[of]).astype(np.int32))], ["h", "key", "pos"])

    return run


def _double(length: int):
    """Of the windows of ``length`` words that repeat: the spans they cover, those that cover all but each window's first place, and candidates of twice the length."""

    def covered(key: np.ndarray, pos: np.ndarray) -> tuple:
        if not len(key):
            return key, pos, pos
        begins = np.concatenate([[True], (key[1:] != key[:-1]) | (pos[1:] > pos[:-1] + length)])
        at = np.flatnonzero(begins)
        return key[at], pos[at], pos[np.append(at[1:], len(key)) - 1] + length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tv.whole_groups(batches, "key"):
            key, pos, h = (t.column(c).to_numpy() for c in ("key", "pos", "h"))
            first = t.column("first").to_numpy(zero_copy_only=False)
            fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (pos[1:] != pos[:-1])])
            key, pos, h, first = key[fresh], pos[fresh].astype(np.int64), h[fresh], first[fresh]
            ids = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) << 32 | pos
            beyond = np.searchsorted(ids, ids + length)
            both = np.flatnonzero((beyond < len(ids)) & (ids[np.minimum(beyond, len(ids) - 1)] == ids + length))
            twice = tv.mix(tv.mix(h[both].view(np.uint64)) * np.uint64(tv.BASES[2]) + h[beyond[both]].view(np.uint64))
            none = np.zeros(len(both), np.int64)
            parts = [(SPANS, *covered(key, pos), None), (CUTS, *covered(key[~first], pos[~first]), None), (WINDOWS, key[both], pos[both], none, tv.signed(twice))]
            for kind, k, p, to, code in parts:
                if len(k):
                    code = np.zeros(len(k), np.int64) if code is None else code
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(p.astype(np.int32)), pa.array(to.astype(np.int32)), pa.array(code)], ["kind", "key", "pos", "to", "h"])

    return run


def _repeated(windows: DataFrame, hot: list[int]) -> DataFrame:
    """Windows whose hash occurs at two places or more; first: none comes before it by key and place."""
    group = Window.partitionBy("h")
    place = F.struct("key", "pos")
    few = windows.filter(~F.col("h").isin(hot)) if hot else windows
    found = (
        few.withColumns({"least": F.min(place).over(group), "most": F.max(place).over(group)})
        .filter("least <> most")
        .select("key", "pos", "h", (place == F.col("least")).alias("first"))
    )
    if not hot:
        return found
    many = windows.filter(F.col("h").isin(hot))
    ends = many.groupBy("h").agg(F.min(place).alias("least"), F.max(place).alias("most")).filter("least <> most")
    return found.unionByName(many.join(F.broadcast(ends), "h").select("key", "pos", "h", (place == F.col("least")).alias("first")))


def _hot(sampled: DataFrame) -> list[int]:
    """Hashes that occur very often, by the windows of one of SHARE texts; not more than the sample's windows by HOT / SHARE / 2."""
    often = sampled.groupBy("h").count().filter(F.col("count") * SHARE * 2 >= HOT).select("h")
    return [r[0] for r in often.collect()]


def keyed(docs: DataFrame, key: F.Column, text: str = "text") -> DataFrame:
    return docs.select(key.alias("key"), cs.col(text).alias("text")).filter("text is not null")


def repeated_levels(spark: SparkSession, source: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> list[tuple[int, DataFrame]]:
    """For each level from ``min_words`` on: (length, kind int, key, pos, to), spans of words by the text's key.

    Spans of SPANS are covered by repeated windows of that length, those of CUTS by all but the first
    of each. The list ends before the first level without repeated windows.
    """
    half = min_words // 2
    some = lambda df: df.filter(F.pmod(F.xxhash64("key"), F.lit(SHARE)) == 0)
    at_anchors = lambda texts: texts.mapInArrow(_anchors(half, min_words - half + 1), WINDOW)
    around = lambda texts, places: texts.join(places.hint("merge"), "key").mapInArrow(_around(half, min_words), WINDOW)
    hot = _hot(at_anchors(some(source)))
    anchors = at_anchors(source)
    if hot:
        anchors = scratch.put(anchors)
    places = scratch.put(_repeated(anchors, hot).groupBy("key").agg(F.collect_set("pos").alias("anchors")))
    windows, sampled = around(source, places), around(some(source), some(places))
    levels, length, before = [], min_words, places
    while True:
        # a window holds an anchor that occurs as often at least: without hot anchors no window is hot
        if hot:
            hot, windows = _hot(sampled), scratch.put(windows)
        found = _repeated(windows, hot)
        step = scratch.put(found.repartition("key").sortWithinPartitions("key", "pos").mapInArrow(_double(length), STEP), "kind")
        scratch.collect_garbage()
        if before is not None:
            scratch.drop(before)
            before = None
        if step.isEmpty():
            return levels
        levels.append((length, step))
        windows = step.filter(F.col("kind") == WINDOWS).select("h", "key", "pos")
        sampled = some(windows)
        length *= 2


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unions of the spans of each key, with the greatest length among them."""
    for t in tv.whole_groups(batches, "key"):
        key, lo, hi, longest = (t.column(c).to_numpy() for c in ("key", "pos", "to", "length"))
        group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        reach = np.maximum.accumulate(group << 32 | hi.astype(np.int64))
        begins = np.concatenate([[True], (group[1:] != group[:-1]) | (lo[1:] > (reach[:-1] & 0xFFFFFFFF))])
        at = np.flatnonzero(begins)
        yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(lo[at]), pa.array((reach[np.append(at[1:], len(key)) - 1] & 0xFFFFFFFF).astype(np.int32)), pa.array(np.maximum.reduceat(longest, at))], ["key", "pos", "to", "length"])


def merged(levels: list[tuple[int, DataFrame]], kind: int) -> DataFrame | None:
    parts = [step.filter(F.col("kind") == kind).select("key", "pos", "to", F.lit(length).alias("length")) for length, step in levels]
    if not parts:
        return None
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.repartition("key").sortWithinPartitions("key", "pos").mapInArrow(_merge, "key long, pos int, to int, length int")


def count_words(text: str) -> F.Column:
    """Number of maximal runs of bytes other than ASCII white space."""
    return F.regexp_count(cs.col(text), F.lit(r"[^\t\n\r\x0b\x0c ]++")).cast("int")


def copies(docs: DataFrame, key: F.Column, id_col: str, text: str, min_words: int) -> DataFrame:
    """Texts that several documents hold: key, the least id (null last), number of words."""
    ids = docs.filter(cs.col(text).isNotNull()).select(key.alias("key"), F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id")).alias("who"), count_words(text).alias("n"))
    return ids.filter(F.col("n") >= min_words).groupBy("key").agg(F.min("who").alias("least"), F.max("who").alias("most"), F.max("n").alias("n")).filter("least <> most").select("key", F.col("least.id").alias("keeper"), "n")


def repeated_passages(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start_word, end_word, level): spans of words covered by repeated windows; level: the greatest window length that repeats inside."""
    scratch = Scratch(spark, "substrings")
    key = cs.one_key(docs.filter(cs.col(text).isNotNull()), cs.col(text))
    levels = repeated_levels(spark, keyed(docs, key, text), scratch, min_words)
    spans = merged(levels, SPANS)
    shared = scratch.put(copies(docs, key, id_col, text, min_words))
    level = F.lit(min_words) * F.pow(F.lit(2), F.floor(F.log2(F.col("n") / F.lit(min_words)) + F.lit(1e-9)))
    whole = shared.select("key", F.lit(0).alias("pos"), F.col("n").alias("to"), level.cast("int").alias("length"))
    if spans is not None:
        whole = spans.join(whole, "key", "left_anti").unionByName(whole)
    whole = scratch.put(whole)
    names = docs.filter(cs.col(text).isNotNull()).select(key.alias("key"), F.col(id_col).alias(id_col)).distinct()
    return names.join(whole, "key").select(id_col, F.col("pos").alias("start_word"), F.col("to").alias("end_word"), F.col("length").alias("level"))


def _cut(column: pa.Array, cuts: pa.Array) -> pa.Array:
    """The texts without the spans of words that are to go; a null stays one."""
    data, offsets = tv.buffers(column)
    out: list[str | None] = [None] * len(column)
    texts = np.flatnonzero(np.diff(offsets))
    spans = cuts.to_pylist()
    for i in texts.tolist():
        raw = data[offsets[i] : offsets[i + 1]]
        w = tv.words(raw, np.array([0, len(raw)]))
        parts, at = [], 0
        for lo, hi in sorted((s["pos"], s["to"]) for s in spans[i]):
            parts.append(raw[at : int(w.starts[lo])].tobytes())
            at = int(w.starts[hi]) if hi < len(w) else len(raw)
        text = (b"".join(parts) + raw[at:].tobytes()).decode()
        out[i] = text.rstrip() if at == len(raw) else text
    return pa.array(out, pa.string())


def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text", count: str | None = "n_chars", min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the repeated passages but for the first place of each.

    First is the place in the text with the least hash, then the foremost in it. Of documents with the
    same text of at least ``min_words`` words, those with the least id (null last) stay. A document of
    which nothing but white space is left goes; a null, blank or shorter text stays as it is. ``count``,
    where there is such a column, is set anew for texts that were cut.
    """
    scratch = Scratch(spark, "cuts")
    own = cs.one_key(docs.filter(cs.col(text).isNotNull()), cs.col(text))
    cuts = merged(repeated_levels(spark, keyed(docs, own, text), scratch, min_words), CUTS)
    key, keeper, spans_of, after = cs.free(docs, "__key", "__keeper", "__cuts", "__after")
    spans = cuts.groupBy("key").agg(F.collect_list(F.struct("pos", "to")).alias(spans_of)) if cuts is not None else spark.createDataFrame([], f"key long, {spans_of} array<struct<pos:int,to:int>>")
    shared = copies(docs, own, id_col, text, min_words).select("key", F.struct("keeper").alias(keeper))
    what = scratch.put(spans.join(shared, "key", "full").withColumnRenamed("key", key))
    # what is cut grows with the documents, hence no broadcast at any size
    joined = docs.withColumn(key, own).join(what.hint("merge"), key, "left")
    joined = joined.filter(cs.col(text).isNull() | F.col(keeper).isNull() | F.col(keeper)["keeper"].eqNullSafe(cs.col(id_col)))
    changes = F.col(spans_of).isNotNull() & cs.col(text).isNotNull()
    # once, also where it is filtered by: else each task holds two Python workers
    joined = joined.withColumn(after, F.arrow_udf(_cut, StringType()).asNondeterministic()(F.when(changes, cs.col(text)), F.when(changes, F.col(spans_of))))
    joined = joined.filter(~changes | (F.trim(F.translate(F.col(after), "\t\n\r\x0b\x0c", "     ")) != ""))
    new = {text: F.when(changes, F.col(after)).otherwise(cs.col(text))}
    if count and count in docs.columns:
        new[count] = F.when(changes, F.length(after).cast(docs.schema[count].dataType)).otherwise(cs.col(count))
    return joined.select(*[new[c].alias(c) if c in new else cs.col(c) for c in docs.columns])
