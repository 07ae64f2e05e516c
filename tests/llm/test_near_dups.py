from __future__ import annotations

import random
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import texts as tx
from pyspark.sql import functions as F

from glyphmill.llm import components, near_dups, queries
from glyphmill.llm import textvec as tv


def shingles(text: str) -> set:
    w = text.lower().split()
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def jaccard(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def changed(text: str, share: float, seed: int) -> str:
    r = random.Random(seed)
    w = text.split()
    for _ in range(round(share * len(w))):
        w[r.randrange(len(w))] = r.choice(tx.VOCABULARY)
    return " ".join(w)


def family(n_base: int = 40) -> dict:
    """Bases, each with an exact copy, one with other case and two near copies; and loners."""
    out = {}
    for b in range(n_base):
        base = tx.prose(100 + b, 150)
        for j, t in enumerate([base, base, base.upper(), changed(base, 0.01, b), changed(base, 0.02, b + 1)]):
            out[b * 10 + j] = t
    for k in range(100):
        out[10_000 + k] = tx.prose(9000 + k, 150)
    return out


def test_estimates_follow_jaccard():
    base = tx.prose(1, 400)
    texts = [base, *[changed(base, s, i) for i, s in enumerate((0.0, 0.005, 0.01, 0.02, 0.04))]]
    mins, has = near_dups.signatures(pa.array(texts), *tv.buffers(pa.array(texts)))
    sketch = near_dups.odd_sketch(mins)
    assert has.all()
    for i in range(1, len(texts)):
        ones = np.bitwise_count(sketch[0] ^ sketch[i]).sum()
        assert abs(float(near_dups.similarity(ones)) - jaccard(texts[0], texts[i])) < 0.15


def test_odd_sketch_is_the_parity_of_samples():
    mins = np.random.default_rng(0).integers(0, 1 << 32, (3, near_dups.PERMUTATIONS), dtype=np.uint32)
    sketch = near_dups.odd_sketch(mins)
    for row, bits in zip(mins, sketch, strict=True):
        want = np.zeros(near_dups.BITS, int)
        for i, v in enumerate(row):
            want[int(tv.mix(np.array([v], np.uint64) + np.uint64((i + 1) << 33))[0] & np.uint64(near_dups.BITS - 1))] ^= 1
        assert [int(bits[b >> 6] >> np.uint64(b & 63) & np.uint64(1)) for b in range(near_dups.BITS)] == want.tolist()


def test_every_pair_of_a_band_is_verified():
    """Components by the shifted comparison are those of all pairs."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, (4, 4), dtype=np.uint64)
    sketch = np.stack([base[i % 4] ^ (np.uint64(1) << rng.integers(0, 63, 4, dtype=np.uint64)) for i in range(50)])
    size = np.array([20, 1, 29])
    starts = np.cumsum(size) - size
    a, b = near_dups._group_edges(size, starts, sketch, 10)
    mine = {i: i for i in range(50)}

    def root(x):
        while mine[x] != x:
            x = mine[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        mine[root(x)] = root(y)
    want = {i: i for i in range(50)}
    for s, n in zip(starts, size, strict=True):
        for x, y in combinations(range(s, s + n), 2):
            if np.bitwise_count(sketch[x] ^ sketch[y]).sum() <= 10:
                old, new = want[x], want[y]
                want = {k: new if v == old else v for k, v in want.items()}
    assert {(x, y) for x, y in combinations(range(50), 2) if root(x) == root(y)} == {(x, y) for x, y in combinations(range(50), 2) if want[x] == want[y]}


def test_recall_and_precision_against_brute_force(spark):
    texts = family()
    got = near_dups.near_duplicates(spark, tx.frame(spark, tx.rows(texts), True)).collect()
    gone = {r.doc_id: r.kept_doc_id for r in got}
    assert len(gone) == len(got)
    pairs = {b for a, b in combinations(sorted(texts), 2) if a // 10 == b // 10 and a < 10_000 and jaccard(texts[a], texts[b]) >= 0.8}
    assert sum(b in gone for b in pairs) >= 0.9 * len(pairs)
    assert all(b // 10 == k // 10 and b < 10_000 for b, k in gone.items())
    assert all(k not in gone for k in gone.values())


def test_odd_rows(spark):
    rows = tx.odd_rows()
    df = tx.frame(spark, rows, True)
    got = {(r.doc_id, r.kept_doc_id): r.similarity for r in near_dups.near_duplicates(spark, df).collect()}
    assert got == {(5, 4): 1.0, (None, 4): 1.0}
    kept = near_dups.keep_one(spark, df)
    assert kept.columns == df.columns
    out = kept.collect()
    # null and blank texts stay, the repeated rows are one
    assert sorted(str(r.doc_id) for r in out) == sorted(["1", "None", "2", "3", "4", "6", "7", "8", "9", "None"])
    assert all(r["__key"] == "own __key" for r in out)


def test_copies_without_ids(spark):
    rows = [(None, tx.prose(1, 90), None, None, 1)] * 3
    assert near_dups.keep_one(spark, tx.frame(spark, rows)).count() == 1


def test_short_copies(spark):
    got = near_dups.keep_one(spark, tx.frame(spark, tx.rows({1: "hi", 2: "hi", 3: "HI", 4: "ho"})))
    assert sorted(r.doc_id for r in got.collect()) == [1, 4]


@pytest.mark.parametrize("f", [near_dups.near_duplicates, near_dups.keep_one])
def test_empty_table(spark, f):
    assert f(spark, tx.frame(spark, [])).count() == 0
    assert f(spark, tx.frame(spark, tx.rows({1: None, 2: ""}))).count() == (2 if f is near_dups.keep_one else 0)


def test_long_chains_are_one_component(spark):
    from glyphmill.llm.scratch import Scratch

    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 201), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components.components(Scratch(spark, "t"), edges).collect()}
    assert {got.get(i, i) for i in range(61)} == {0} and got[201] == 200


def test_query(spark, small):
    """Against all pairs of whole texts."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect() if r.text and r.text.strip()}
    gone = {r.doc_id for r in queries.op7_near_duplicates(spark, small).collect()}
    sets = {i: shingles(t) for i, t in docs.items()}
    near = {b for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])}
    far = {i for i in sets if all(len(sets[i] & sets[j]) < 0.4 * len(sets[i] | sets[j]) for j in sets if j != i)}
    assert len(near & gone) >= 0.9 * len(near) and not far & gone


def exact_pairs(docs: dict, least: float) -> dict:
    """The Jaccard similarity of all pairs of texts that have at least this."""
    sets = {i: shingles(t) for i, t in docs.items()}
    holders = {}
    for i, x in sets.items():
        for g in x:
            holders.setdefault(g, []).append(i)
    both = Counter(p for ids in holders.values() for p in combinations(ids, 2))
    found = {(a, b): n / (len(sets[a]) + len(sets[b]) - n) for (a, b), n in both.items()}
    return {p: j for p, j in found.items() if j >= least}


def test_recall_from_the_threshold_up_on_the_given_tables(spark, small):
    """Groups are those of the exact pairs, near the limit too; nothing below it is joined."""
    folder = str(Path(small).parent / "sf0.01")
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if r.text and r.text.strip()}
    near = exact_pairs(docs, 0.5)
    assert any(j < 0.65 for j in near.values())
    mine = {i: i for i in docs}

    def root(x):
        while mine[x] != x:
            x = mine[x]
        return x

    for a, b in near:
        mine[max(root(a), root(b))] = min(root(a), root(b))
    want = {i: root(i) for i in docs if root(i) != i}
    got = {r.doc_id: r.kept_doc_id for r in queries.op7_near_duplicates(spark, folder).collect()}
    assert sum(got.get(i) == k for i, k in want.items()) >= 0.98 * len(want)
    assert all(root(i) == root(k) for i, k in got.items())


def test_the_limit_is_decided_on_exact_shingles(spark):
    """Pairs whose similarity is a little over or under the threshold, where a sketch can't tell."""
    docs, over, under = {}, set(), set()
    for k in range(40):
        base = tx.prose(50_000 + k, 300).split()
        for i, cut in ((10 * k + 1, 190), (10 * k + 5, 210)):
            other = tx.prose(60_000 + i, 400).split()
            own = tx.prose(70_000 + i, 300).split() if cut == 190 else base
            docs[i], docs[i + 1] = " ".join(own), " ".join(own[:cut] + other[: 300 - cut])
            (over if cut == 210 else under).add(i + 1)
    assert all(jaccard(docs[i - 1], docs[i]) > 0.5 for i in over) and all(0.4 < jaccard(docs[i - 1], docs[i]) < 0.5 for i in under)
    gone = {r.doc_id for r in near_dups.near_duplicates(spark, tx.frame(spark, tx.rows(docs))).collect()}
    assert len(over & gone) >= 0.95 * len(over) and gone <= over


def group_sets(rows) -> set:
    out: dict = {}
    for r in rows:
        out.setdefault(r.kept_doc_id, {r.kept_doc_id}).add(r.doc_id)
    return {frozenset(g) for g in out.values()}


def test_hot_bands_in_chunks(spark, monkeypatch):
    """A third of all texts are copies of one, which share bands, with some that are less alike: as without chunks."""
    base = tx.prose(1, 120)
    texts = {i: changed(base, 0.02, i) for i in range(90)}
    texts |= {100 + i: changed(base, 0.12, 1000 + i) for i in range(40)}
    texts |= {200 + i: tx.prose(5000 + i // 2, 80) + (" end" if i % 2 else "") for i in range(120)}
    df = tx.frame(spark, tx.rows(texts))
    want = group_sets(near_dups.near_duplicates(spark, df).collect())
    monkeypatch.setattr(near_dups, "HOT", 7)
    assert group_sets(near_dups.near_duplicates(spark, df).collect()) == want and max(map(len, want)) >= 90


def test_many_repeated_rows(spark):
    """Of 200 rows with one id and text one stays, among others that stay too."""
    rows = [(1, tx.prose(3, 40), "en", "a", 0)] * 200 + [(i, tx.prose(i, 40), "en", "a", 0) for i in range(10, 40)] + [(9, tx.prose(12, 40), "en", "b", 0)] * 3
    df = tx.frame(spark, rows)
    assert sorted(r.doc_id for r in near_dups.keep_one(spark, df).collect()) == [1, 9, 10, 11, *range(13, 40)]


def test_texts_whose_first_hashes_collide(spark, monkeypatch):
    """The second 64 bits tell them apart."""
    from glyphmill.llm import columns as cs

    monkeypatch.setattr(cs, "keys", lambda c: [F.lit(7).cast("long").alias("key"), F.xxhash64(F.lit(1), c).alias("key2")])
    texts = {1: tx.prose(1, 60), 2: tx.prose(2, 60), 3: tx.prose(1, 60), 4: tx.prose(4, 60), 5: changed(tx.prose(4, 60), 0.02, 5)}
    df = tx.frame(spark, tx.rows(texts))
    assert sorted(r.doc_id for r in near_dups.keep_one(spark, df).collect()) == [1, 2, 4]
