"""MinHash near-deduplication whose banded candidates are verified by odd sketches and exact shingles.

Each distinct text gets ``PERMUTATIONS`` MinHash values of its 3-word shingles and, from them, a
parity bitmap of ``BITS`` bits: value i flips one bit, so that the XOR of two bitmaps has as many
ones as an odd sketch of the differing samples. Texts that agree on a band of ``ROWS`` values are
candidates (0.984 of the pairs at Jaccard 0.5, 0.9998 at 0.6); the population count of the XOR
estimates their similarity. A pair whose estimate lies ``ABOVE`` the threshold is near, one ``BELOW``
it isn't; all between are decided by the Jaccard similarity of their shingles' 32-bit hashes. Near
pairs are joined to groups by connected components.

A band that more than ``HOT`` texts share is cut by hash to chunks. Each is compared on its own, then
one text of each group found there with those of the band's other chunks; what is not in the
band's largest group by then is compared with the whole band, chunk by chunk. Texts are told
apart by 128 bits of hash.

Defined results: documents with the same text are one group, whatever their length; a null or blank
text is in none; a text of one or two words has one shingle, the text itself. Of a group the
document with the least id (null last) is kept, and of rows with the same id and text one is. Words
compare in lower case for ASCII. Every candidate pair of a band is verified, however many share it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphmill.llm import columns as cs
from glyphmill.llm import textvec as tv
from glyphmill.llm.components import components
from glyphmill.llm.scratch import Scratch

SHINGLE, ROWS, BANDS, BITS = 3, 4, 64, 512
PERMUTATIONS = ROWS * BANDS
THRESHOLD, HOT = 0.5, 4096
#: About four standard deviations of the estimate at 0.5; three below, where the work grows faster.
ABOVE, BELOW = 0.25, 0.2
#: Slots of the bitmap that tells which texts are in undecided pairs.
SLOTS = 1 << 22
SKETCH = [f"s{i}" for i in range(BITS // 64)]
_seeds = np.random.default_rng(11)
XOR = _seeds.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
TIMES = _seeds.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
SIGNATURE = "key long, key2 long, " + ", ".join(f"{s} long" for s in SKETCH) + ", bands array<long>"


def shingles(w: tv.Words) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' shingles, one text after the other, and how many each has."""
    size = np.minimum(SHINGLE, w.count)
    n = np.where(w.count > 0, w.count - size + 1, 0)
    at = tv.spread(w.first, n)
    return tv.Hasher(w.hashes(tv.LOWER)).of(at, at + np.repeat(size, n)), n


def signatures(column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """MinHash values (texts x permutations) and whether each text has a word."""
    w = tv.words(data, offsets)
    has = w.count > 0
    mins = np.zeros((len(w.count), PERMUTATIONS), np.uint32)
    if not len(w):
        return mins, has
    grams, n = shingles(w)
    grams = (grams >> np.uint64(32)).astype(np.uint32)
    starts = (np.cumsum(n) - n)[has]
    out, v = np.empty((PERMUTATIONS, len(starts)), np.uint32), np.empty_like(grams)
    for i in range(PERMUTATIONS):
        np.bitwise_xor(grams, XOR[i], out=v)
        np.multiply(v, TIMES[i], out=v)
        v ^= v >> np.uint32(15)
        out[i] = np.minimum.reduceat(v, starts)
    mins[has] = out.T
    return mins, has


def odd_sketch(mins: np.ndarray) -> np.ndarray:
    """Parity bitmaps (texts x BITS / 64): each of the values flips one bit."""
    sketch = np.zeros((len(mins), BITS // 64), np.uint64)
    every = np.arange(len(mins))
    for i in range(mins.shape[1]):
        bit = tv.mix(mins[:, i].astype(np.uint64) + np.uint64((i + 1) << 33)) & np.uint64(BITS - 1)
        sketch[every, (bit >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (bit & np.uint64(63))
    return sketch


def similarity(ones: np.ndarray | float) -> np.ndarray:
    """Jaccard similarity by the ones of two sketches' XOR; 0 where the bitmaps are too full to tell."""
    share = np.minimum(1 - 2 * np.asarray(ones, float) / BITS, 1.0)
    return np.where(share > 0, 1 + BITS / (4 * PERMUTATIONS) * np.log(np.maximum(share, 1e-9)), 0.0).clip(0, 1)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in tv.chunks(batches, "text"):
        mins, has = signatures(rows.column("text"), data, offsets)
        mins, some = mins[has], pa.array(np.flatnonzero(has))
        if not len(mins):
            continue
        sketch = odd_sketch(mins)
        bands = np.empty((len(mins), BANDS), np.int64)
        for b in range(BANDS):
            codes = mins[:, b * ROWS : (b + 1) * ROWS].astype(np.uint64)
            h = np.full(len(mins), b + 1, np.uint64)
            for r in range(ROWS):
                h = tv.mix(h * np.uint64(tv.BASES[1]) + codes[:, r])
            bands[:, b] = tv.signed(h)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(mins) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
        yield pa.RecordBatch.from_arrays([*(rows.column(k).take(some) for k in cs.KEY), *(pa.array(tv.signed(sketch[:, i])) for i in range(len(SKETCH))), lists], [*cs.KEY, *SKETCH, "bands"])


def _group_edges(size: np.ndarray, starts: np.ndarray, sketch: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, by row, of the pairs in each group with at most ``most`` ones in their XOR."""
    return _compared(size, starts, sketch, most, most)[:2]


def _compared(size: np.ndarray, starts: np.ndarray, sketch: np.ndarray, most: int, open_: int) -> tuple[np.ndarray, ...]:
    """That forest, and the pairs with more ones, up to ``open_``, that it doesn't connect."""
    label = np.arange(len(sketch))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    room = np.repeat(starts + size, size)
    for d in range(1, int(size.max(initial=1))):
        i = np.flatnonzero(np.arange(len(sketch)) + d < room)
        # pairs that are joined already need no comparison
        i = i[label[i] != label[i + d]]
        if not len(i):
            continue
        ones = np.bitwise_count(sketch[i] ^ sketch[i + d]).sum(1)
        undecided = i[(ones > most) & (ones <= open_)]
        left.append(undecided)
        right.append(undecided + d)
        i = i[ones <= most]
        if not len(i):
            continue
        while True:
            a, b = label[i], label[i + d]
            if (a == b).all():
                break
            low = np.minimum(a, b)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while (label != label[label]).any():
                label = label[label]
    member = np.flatnonzero(label != np.arange(len(label)))
    a, b = np.concatenate(left), np.concatenate(right)
    apart = label[a] != label[b]
    return member, label[member], a[apart], b[apart]


def _most_ones(least: float) -> int:
    """The most ones at which the estimate is at least that; -1: none."""
    return int(np.flatnonzero(similarity(np.arange(BITS // 2)) >= least).max(initial=-1))


PAIR = "a long, a2 long, b long, b2 long, kind int, n int"
SURE, OPEN = 0, 1


def _pairs(t: pa.Table, a: np.ndarray, b: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    a, b = pa.array(a), pa.array(b)
    return pa.RecordBatch.from_arrays([*(t.column(k).combine_chunks().take(i) for i in (a, b) for k in cs.KEY), pa.array(kind.astype(np.int32)), t.column("n").combine_chunks().take(a)], ["a", "a2", "b", "b2", "kind", "n"])


def _limits(threshold: float) -> tuple[int, int]:
    """The most ones of a pair that is near, and of one that may be."""
    return _most_ones(threshold + ABOVE), _most_ones(max(threshold - BELOW, 1e-9))


def _verify(threshold: float):
    """Of each group of rows: SURE near pairs, enough to connect them, and OPEN ones that aren't connected in it."""
    most, open_ = _limits(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tv.whole_groups(batches, "grp"):
            starts, size = tv.runs(t.column("grp").to_numpy())
            take = tv.spread(starts[size > 1], size[size > 1])
            t = t.take(pa.array(take))
            size = size[size > 1]
            if not len(size):
                continue
            sketch = np.stack([t.column(s).to_numpy() for s in SKETCH], 1).view(np.uint64)
            near_a, near_b, a, b = _compared(size, np.cumsum(size) - size, sketch, most, open_)
            kind = np.repeat([SURE, OPEN], [len(near_a), len(a)])
            if len(kind):
                yield _pairs(t, np.concatenate([near_a, a]), np.concatenate([near_b, b]), kind)

    return run


def _against(threshold: float):
    """SURE and OPEN pairs of a block's outsiders (out) and its other rows of other roots."""
    most, open_ = _limits(threshold)

    def run(table: pa.Table) -> pa.Table:
        out = table.column("out").to_numpy(zero_copy_only=False)
        sketch = np.stack([table.column(s).to_numpy() for s in SKETCH], 1).view(np.uint64)
        root = np.unique(np.stack([table.column(c).to_numpy() for c in ("root", "root2")], 1), axis=0, return_inverse=True)[1].ravel()
        others = np.flatnonzero(~out)
        parts = [_pairs(table.slice(0, 0), *[np.zeros(0, np.int64)] * 3)]
        for i in np.flatnonzero(out).tolist():
            other = others[root[others] != root[i]]
            ones = np.bitwise_count(sketch[other] ^ sketch[i]).sum(1)
            kind = np.where(ones <= most, SURE, OPEN)
            # one sure pair for each other root is enough
            sure = other[ones <= most]
            sure = sure[np.unique(root[sure], return_index=True)[1]]
            open_pairs = other[(kind == OPEN) & (ones <= open_)]
            open_pairs = open_pairs[~np.isin(root[open_pairs], root[sure])]
            b = np.concatenate([sure, open_pairs])
            parts.append(_pairs(table, np.full(len(b), i), b, np.repeat([SURE, OPEN], [len(sure), len(open_pairs)])))
        return pa.Table.from_batches(parts)

    return run


def _hot(scratch: Scratch, hot: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """Pairs across the chunks of bands that are cut to such. edges: what was found within the chunks."""
    node = F.struct(*cs.KEY).alias("node")

    def rooted(found: DataFrame) -> DataFrame:
        """The bands' rows with the least text of what the pairs connect."""
        sure = found.filter(F.col("kind") == SURE).select(F.struct(F.col("a").alias("key"), F.col("a2").alias("key2")).alias("a"), F.struct(F.col("b").alias("key"), F.col("b2").alias("key2")).alias("b"))
        roots = components(scratch, sure)
        return hot.withColumn("node", node).join(roots, "node", "left").withColumn("r", F.coalesce("root", "node")).drop("node", "root").withColumns({"root": F.col("r.key"), "root2": F.col("r.key2")}).drop("r")

    # one text for each root of a band, its root or the least of its texts there
    heads = scratch.put(rooted(edges).groupBy("band", "root", "root2").agg(F.min(F.struct(*cs.KEY, *SKETCH)).alias("row"), F.count("*").alias("m")))
    chunks = heads.groupBy("band").agg(F.ceil(F.count("*") / HOT).cast("int").alias("c"))
    few = heads.join(chunks, "band").select((F.col("band") + F.pmod(F.xxhash64("root", "root2"), F.col("c"))).alias("grp"), "row.*", F.lit(0).alias("n"))
    between = scratch.put(few.repartition("grp").sortWithinPartitions("grp", *cs.KEY).mapInArrow(_verify(threshold), PAIR))
    found = edges.unionByName(between)
    rows = scratch.put(rooted(found))
    main = rows.groupBy("band", "root", "root2").agg(F.count("*").alias("m")).groupBy("band").agg(F.max(F.struct("m", "root", "root2")).alias("main"), F.sum("m").alias("all"))
    main = main.withColumn("outside", F.col("all") - F.col("main.m")).filter("outside > 0")
    rows = rows.join(main, "band").withColumn("out", (F.col("root") != F.col("main.root")) | (F.col("root2") != F.col("main.root2")))
    many, few = F.ceil(F.col("all") / HOT).cast("long"), F.ceil(F.col("outside") / HOT).cast("long")
    h = F.xxhash64(*cs.KEY)
    columns = [*cs.KEY, *SKETCH, "root", "root2", "band", F.lit(0).alias("n")]
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    left = rows.filter("out").select(*columns, F.pmod(h, few).alias("y"), each(many).alias("x"), F.lit(True).alias("out"))
    right = rows.select(*columns, F.pmod(h, many).alias("x"), each(few).alias("y"), F.lit(False).alias("out"))
    return between.unionByName(left.unionByName(right).groupBy("band", "x", "y").applyInArrow(_against(threshold), PAIR))


def _shingle_sets(slots: np.ndarray):
    """(key, key2, grams) of the texts whose slot is taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken = slots[batch.column("key").to_numpy() & (SLOTS - 1)]
            batch = batch.filter(pa.array(taken))
            for rows, data, offsets in tv.chunks(iter([batch]), "text"):
                grams, n = shingles(tv.words(data, offsets))
                grams = (grams >> np.uint64(32)).astype(np.uint32)
                text = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((grams, text))
                grams, text = grams[order], text[order]
                first = np.ones(len(grams), bool)
                first[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
                ends = np.cumsum(np.bincount(text[first], minlength=len(n)))
                yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in cs.KEY), pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(grams[first].view(np.int32)))], [*cs.KEY, "grams"])

    return run


def _exactly(scratch: Scratch, keyed: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs whose shingles' Jaccard similarity is at least the threshold."""
    either = pairs.select(F.explode(F.array("a", "b")).alias("key"))
    # at most SLOTS small numbers, however many pairs there are
    found = either.select(F.col("key").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")).distinct().toArrow()
    slots = np.zeros(SLOTS, bool)
    slots[found.column("slot").to_numpy()] = True
    sets = scratch.put(keyed.mapInArrow(_shingle_sets(slots), "key long, key2 long, grams array<int>").dropDuplicates(cs.KEY))
    left, right = (sets.select(F.col("key").alias(k), F.col("key2").alias(f"{k}2"), F.col("grams").alias(f"grams_{k}")) for k in ("a", "b"))
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    near = both >= threshold * (F.size("grams_a") + F.size("grams_b") - both)
    return pairs.join(left, ["a", "a2"]).join(right, ["b", "b2"]).filter(near).select(*PAIRED)


PAIRED = ["a", "a2", "b", "b2"]


def _ids(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.filter(cs.col(text).isNotNull()).select(*cs.keys(cs.col(text)), F.struct(cs.col(id_col).isNull().alias("none"), cs.col(id_col).alias("id")).alias("who"))


def _ordered(pairs: DataFrame) -> DataFrame:
    """Each pair with the lesser text first."""
    swap = (F.col("a") > F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("a2") > F.col("b2")))
    return pairs.select(*[F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("a2", "b2"), ("b", "a"), ("b2", "a2"))], "kind").distinct()


def near_edges(scratch: Scratch, keyed: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """(a, a2, b, b2) of pairs of near texts that connect all near ones."""
    bands = signed.select(F.explode("bands").alias("band"), *cs.KEY)
    # sketches go only to the bands that texts share
    shared = bands.withColumn("n", F.count("*").over(Window.partitionBy("band")).cast("int")).filter("n > 1")
    shared = scratch.put(shared.join(signed.select(*cs.KEY, *SKETCH), cs.KEY))
    chunk = F.pmod(F.xxhash64(*cs.KEY), F.ceil(F.col("n") / HOT))
    compared = shared.withColumn("grp", F.col("band") + chunk).repartition("grp").sortWithinPartitions("grp", *cs.KEY).mapInArrow(_verify(threshold), PAIR)
    hot = shared.filter(F.col("n") > HOT)
    if not hot.isEmpty():
        compared = scratch.put(compared)
        compared = compared.unionByName(_hot(scratch, hot.drop("n"), compared.filter(F.col("n") > HOT), threshold))
    pairs = scratch.put(_ordered(compared))
    sure = pairs.filter(F.col("kind") == SURE).select(*PAIRED)
    open_ = pairs.filter(F.col("kind") == OPEN).select(*PAIRED).join(sure, PAIRED, "left_anti")
    return sure.unionByName(_exactly(scratch, keyed, open_, threshold))


def groups(scratch: Scratch, docs: DataFrame, id_col: str, text: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(key, key2, first, keeper, rows) of each distinct text that isn't alone in its group, by the text's hashes, and the texts' signatures; keeper: the hashes of the text that stays; rows: how many hold this text with its least id."""
    keyed = docs.filter(cs.col(text).isNotNull()).select(*cs.keys(cs.col(text)), cs.col(text).alias("text"))
    signed = scratch.put(keyed.mapInArrow(_sign, SIGNATURE).dropDuplicates(cs.KEY))
    edges = near_edges(scratch, keyed, signed, threshold)
    ends = [F.struct(F.col(x).alias("key"), F.col(f"{x}2").alias("key2")).alias(x) for x in ("a", "b")]
    stars = components(scratch, edges.select(*ends))
    roots = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct()).select("node.*", "root")
    each = _ids(docs, id_col, text).groupBy(*cs.KEY, "who").agg(F.count("*").alias("n"))
    names = each.groupBy(*cs.KEY).agg(F.min("who").alias("who"), F.sum("n").alias("n"), F.min_by("n", "who").alias("rows"))
    # blank texts have no signature and are in no group
    names = names.join(signed.select(*cs.KEY), cs.KEY, "left_semi").join(roots, cs.KEY, "left").filter("n > 1 or root is not null")
    names = scratch.put(names.withColumn("root", F.coalesce("root", F.struct(*cs.KEY))))
    # two texts may share the least id: the one with the lesser hash is kept then
    of = names.groupBy("root").agg(F.min(F.struct("who", *cs.KEY)).alias("least"))
    member = names.join(of, "root").select(*cs.KEY, F.col("least.who").alias("first"), F.struct("least.key", "least.key2").alias("keeper"), "rows")
    return scratch.put(member), signed


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, kept_doc_id, similarity) of each document that goes because its group keeps another; the estimate is against the kept text."""
    scratch = Scratch(spark, "near")
    found, signed = groups(scratch, docs, id_col, text, threshold)
    goes = _ids(docs, id_col, text).distinct().join(found, cs.KEY).filter((F.struct(*cs.KEY) != F.col("keeper")) | ~F.col("who").eqNullSafe(F.col("first")))
    sketch = signed.select(*cs.KEY, F.array(*SKETCH).alias("sketch"))
    kept = sketch.select(F.struct(*cs.KEY).alias("keeper"), F.col("sketch").alias("kept"))
    pairs = goes.join(sketch, cs.KEY).join(kept, "keeper")
    ones = sum((F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("kept")[i])) for i in range(1, len(SKETCH))), F.bit_count(F.col("sketch")[0].bitwiseXOR(F.col("kept")[0])))
    share = 1 - 2 * ones / F.lit(float(BITS))
    estimate = F.when(share > 0, F.greatest(F.lit(0.0), 1 + BITS / (4 * PERMUTATIONS) * F.ln(share))).otherwise(F.lit(0.0))
    return pairs.select(F.col("who.id").alias(id_col), F.col("first.id").alias(f"kept_{id_col}"), F.round(estimate, 4).alias("similarity"))


def keep_one(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each group of near-duplicates; those in no group stay, those with a null or blank text too."""
    scratch = Scratch(spark, "keep")
    found, _ = groups(scratch, docs, id_col, text, threshold)
    key, key2, stays, first, rows = cs.free(docs, "__key", "__key2", "__stays", "__first", "__rows")
    both = [F.col("key").alias(key), F.col("key2").alias(key2)]
    decided = found.select(*both, (F.struct(*cs.KEY) == F.col("keeper")).alias(stays), F.col("first.id").alias(first), F.col("rows").alias(rows))
    hashed = docs.withColumns(dict(zip((key, key2), cs.keys(cs.col(text)), strict=True)))
    # what is found grows with the documents: no broadcast at any size
    joined = hashed.join(decided.hint("merge"), [key, key2], "left")
    alone = F.col(stays).isNull() | cs.col(text).isNull()
    own = cs.col(id_col).eqNullSafe(F.col(first))
    kept = joined.filter(alone | (F.col(stays) & own & (F.col(rows) == 1))).select(*cs.every(docs))
    again = scratch.put(decided.filter(F.col(stays) & (F.col(rows) > 1)).drop(stays, rows))
    if again.isEmpty():
        return kept
    # rows with the same id and text are one document: only these are shuffled, where their hashes are few enough to broadcast
    once = hashed.join(again, [key, key2]).filter(own).dropDuplicates([key, key2])
    return kept.unionByName(once.select(*cs.every(docs)))
