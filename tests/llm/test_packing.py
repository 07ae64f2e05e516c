from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import texts as tx
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmill.llm import packing, queries, token_counts


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=9), st.integers(0, 40))
def test_closest_sum_against_all_subsets(lengths, room):
    counts = dict(Counter(lengths))
    used = packing.closest(counts, sorted(counts, reverse=True), room)
    assert all(0 < k <= counts[n] for n, k in used.items())
    best = max(s for r in range(len(lengths) + 1) for c in combinations(lengths, r) if (s := sum(c)) <= room)
    assert sum(n * k for n, k in used.items()) == best


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_every_length_is_used_once(lengths):
    used = Counter()
    for window, times in packing.pack(np.array(lengths, np.int64), 20):
        assert sum(n * k for n, k in window.items()) <= 20
        for n, k in window.items():
            used[n] += k * times
    assert used == Counter(lengths)


PATH = queries.VOCABULARY
plain = token_counts.encoder(PATH)[2]


def tokens(text: str | None) -> int:
    """By the tokenizer itself, the whole text at once."""
    return len(plain(text or ""))


def check(rows, got, capacity):
    """Each row's tokens are in windows once, and no window is over-full."""
    want = Counter((str(i), tokens(t)) for i, t in rows if tokens(t))
    pieces = Counter()
    for r in got:
        pieces[str(r[1])] += r[3]
    total = Counter()
    for (i, n), k in want.items():
        total[i] += n * k
    assert pieces == total
    load = Counter()
    for r in got:
        load[r[0]] += r[3]
    assert not load or max(load.values()) <= capacity
    return load


def test_odd_rows(spark):
    rows = tx.odd_rows()
    got = packing.packed(spark, tx.frame(spark, rows, True), capacity=256, tokenizer=PATH).collect()
    check([r[:2] for r in rows], got, 256)
    long = sorted((r.start_token, r.n_tokens) for r in got if r.doc_id == 6)
    assert [s for s, _ in long] == [256 * i for i in range(len(long))] and long[0][1] == 256


def test_several_groups(spark):
    rows = [(i, tx.prose(i, 5 + i % 90)) for i in range(300)]
    got = packing.packed(spark, tx.frame(spark, tx.rows(dict(rows))), capacity=128, group=64, tokenizer=PATH).collect()
    load = check(rows, got, 128)
    assert len({w >> 32 for w in load}) > 2


def test_empty_table(spark):
    assert packing.packed(spark, tx.frame(spark, []), tokenizer=PATH).count() == 0


def test_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    load = check([(r.doc_id, r.text) for r in docs], queries.op8_packing(spark, small).collect(), packing.CAPACITY)
    assert sum(load.values()) >= 0.98 * packing.CAPACITY * len(load)


@pytest.mark.parametrize("capacity", [1, 7])
def test_small_windows(spark, capacity):
    rows = [(1, "abcd" * 10), (2, "abcd" * 3), (3, "a")]
    check(rows, packing.packed(spark, tx.frame(spark, tx.rows(dict(rows))), capacity=capacity, tokenizer=PATH).collect(), capacity)


def test_windows_hold_real_tokens(spark, small):
    """Every token of every text is in one window, in order, and no window has too many."""
    want = {r.doc_id: tokens(r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    pieces, load = {}, Counter()
    for r in queries.op8_packing(spark, small).collect():
        pieces.setdefault(r.doc_id, []).append((r.start_token, r.n_tokens))
        load[r.window_id] += r.n_tokens
    for i, own in pieces.items():
        own.sort()
        assert [s for s, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
    assert {i: sum(n for _, n in own) for i, own in pieces.items()} == {i: n for i, n in want.items() if n}
    assert max(load.values()) <= packing.CAPACITY
    assert sum(load.values()) >= 0.98 * packing.CAPACITY * len(load)


def test_column_of_counts(spark):
    df = spark.createDataFrame([(1, "a", 5, 0), (2, None, 3, 0), (3, "b", None, 0), (4, "c", 0, 0), (5, "d", 9, 0)], "doc_id long, text string, size int, n int")
    got = packing.packed(spark, df, capacity=4, tokens="size").collect()
    total = Counter()
    for r in got:
        total[r.doc_id] += r.n_tokens
    assert total == {1: 5, 2: 3, 5: 9}
    with pytest.raises(ValueError):
        packing.packed(spark, df)
