from __future__ import annotations

import random
from collections import defaultdict

import pytest
import texts as tx
from pyspark.sql import functions as F

from glyphmill.llm import columns as cs
from glyphmill.llm import queries, substrings


def brute(rows: list[tuple], m: int) -> set[tuple]:
    """(id, start, end) of the unions of all windows of m words that occur at two places of distinct (id, text) rows."""
    rows = sorted({(i, t) for i, t, *_ in rows if t}, key=str)
    places = defaultdict(set)
    for k, (_, t) in enumerate(rows):
        w = t.split()
        for p in range(len(w) - m + 1):
            places[tuple(w[p : p + m])].add((k, p))
    hits = sorted(x for at in places.values() if len(at) > 1 for x in at)
    out, open_ = set(), None
    for k, p in hits:
        if open_ and open_[0] == k and p <= open_[2]:
            open_[2] = p + m
        else:
            if open_:
                out.add((rows[open_[0]][0], open_[1], open_[2]))
            open_ = [k, p, p + m]
    if open_:
        out.add((rows[open_[0]][0], open_[1], open_[2]))
    return out


def shared(seed: int = 0) -> dict:
    r = random.Random(seed)
    passages = [tx.prose(500 + i, n) for i, n in enumerate((50, 51, 74, 99, 120, 260, 49))]
    out = {}
    for i in range(40):
        parts = []
        for _ in range(r.randrange(1, 4)):
            parts += [tx.prose(r.randrange(10**6), r.randrange(0, 60)), r.choice(passages)]
        out[i] = " ".join(p for p in parts if p)
    out[100] = passages[4] + "  \n" + passages[4]  # twice in one text
    out[101] = "la " * 130
    return out


@pytest.mark.parametrize("m", [50, 8, 3])
def test_against_brute_force(spark, m):
    rows = tx.rows(shared())
    got = {(r.doc_id, r.start_word, r.end_word) for r in substrings.repeated_passages(spark, tx.frame(spark, rows, True), min_words=m).collect()}
    assert got == brute(rows, m) and got


def test_levels_double_as_long_as_windows_repeat(spark):
    p = tx.prose(1, 230)
    got = {(r.doc_id, r.level) for r in substrings.repeated_passages(spark, tx.frame(spark, tx.rows({1: p + " x", 2: "y " + p, 3: tx.prose(2, 300)}))).collect()}
    assert got == {(1, 200), (2, 200)}


def test_odd_rows(spark):
    rows = tx.odd_rows()
    got = {(r.doc_id, r.start_word, r.end_word) for r in substrings.repeated_passages(spark, tx.frame(spark, rows, True)).collect()}
    assert got == brute(rows, 50)
    assert {x[0] for x in got} == {4, 5, None, 9}  # 9 repeats itself
    df = tx.frame(spark, rows, True)
    cut = substrings.remove_repeats(spark, df)
    assert cut.columns == df.columns
    out = cut.collect()
    # both rows of 4 are one document and stay as they were
    assert sorted(str(r.doc_id) for r in out) == sorted(["1", "None", "2", "3", "4", "4", "6", "7", "8", "9", "None"])
    assert all(r["__key"] == "own __key" for r in out)


def test_removal_leaves_one_place_of_each_window(spark):
    texts = shared(3)
    del texts[101]
    rows = tx.rows(texts)
    out = substrings.remove_repeats(spark, tx.frame(spark, rows)).collect()
    left = [(r.doc_id, r.text) for r in out]
    before = {tuple(w[p : p + 50]) for t in texts.values() for w in [t.split()] for p in range(len(w) - 49)}
    whole = " ".join(" ".join(texts[i].split()) for i in texts)
    assert all(r.n_chars == len(r.text) for r in out)
    # a passage of fifty words that is still there twice was made by the cut itself
    again = [b for b in brute(left, 50) if " ".join(dict(left)[b[0]].split()[b[1] : b[1] + 50]) in whole]
    assert not again
    # nothing is lost but repeats: each word window of the first text is somewhere
    now = {tuple(w[p : p + 10]) for _, t in left for w in [t.split()] for p in range(len(w) - 9)}
    assert all(any(win[i : i + 10] in now for i in range(41)) for win in before)


def test_texts_without_repeats_stay_as_they_are(spark):
    rows = tx.rows({i: tx.prose(i, 100 + i) for i in range(20)})
    assert sorted(map(tuple, substrings.remove_repeats(spark, tx.frame(spark, rows)).collect())) == sorted(rows)


def test_texts_are_cut_once(spark):
    """Each evaluation in a plan takes a Python worker of its own in every task, which stays in the executor's memory."""
    cut = substrings.remove_repeats(spark, tx.frame(spark, tx.rows(shared())))
    assert cut._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_empty_table(spark):
    assert substrings.repeated_passages(spark, tx.frame(spark, [])).count() == 0
    assert substrings.remove_repeats(spark, tx.frame(spark, [])).count() == 0


def test_windows_that_occur_very_often(spark, monkeypatch):
    """A passage that a third of all texts hold: as by the other way."""
    often = tx.prose(77, 130)
    rows = tx.rows(shared() | {200 + i: f"{tx.prose(900 + i, i % 9)} {often} {tx.prose(800 + i, i % 7)}" for i in range(25)})
    df = tx.frame(spark, rows, True)
    cut = sorted(map(str, substrings.remove_repeats(spark, df).select("doc_id", "text").collect()))
    monkeypatch.setattr(substrings, "HOT", 12)
    monkeypatch.setattr(substrings, "SHARE", 1)
    got = {(r.doc_id, r.start_word, r.end_word) for r in substrings.repeated_passages(spark, df).collect()}
    assert got == brute(rows, 50)
    assert sorted(map(str, substrings.remove_repeats(spark, df).select("doc_id", "text").collect())) == cut


def test_texts_whose_first_hashes_collide(spark, monkeypatch):
    monkeypatch.setattr(cs, "keys", lambda c: [F.pmod(F.length(c), F.lit(3)).cast("long").alias("key"), F.xxhash64(F.lit(1), c).alias("key2")])
    rows = tx.rows(shared(5))
    got = {(r.doc_id, r.start_word, r.end_word) for r in substrings.repeated_passages(spark, tx.frame(spark, rows)).collect()}
    assert got == brute(rows, 50)


def test_query(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {(r.doc_id, r.start_word, r.end_word) for r in queries.op4_repeated_passages(spark, small).collect()}
    assert got == brute(rows, substrings.MIN_WORDS)
