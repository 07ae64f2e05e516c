from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import texts as tx

from glyphmill.llm import quality, queries, textvec


def labels(spark, given):
    return spark.createDataFrame(given, "doc_id long, quality int, toxic int")


def corpus(n: int = 400):
    r = random.Random(5)
    good = [w for w in tx.VOCABULARY[:120]]
    junk = ["!!!", "$$$", "click", "buy", "now", "free", "win", "###", "www", "%%"]
    rows = {i: " ".join(r.choice(junk if i % 4 == 0 else good) for _ in range(80)) for i in range(n)}
    marks = [(i, 0 if i % 4 == 0 else 1, 0) for i in range(0, n, 3)]
    return rows, marks


def test_features_are_all_words_and_pairs():
    texts = ["one two, three", "", "a", None, "x y"]
    data, offsets = textvec.buffers(pa.array(texts, pa.string()))
    f, n = quality.features(data, offsets)
    assert n.tolist() == [7, 0, 1, 0, 3] and len(f) == 11  # one two , three: 4 words and 3 pairs
    again, m = quality.features(*textvec.buffers(pa.array(["one two, three"])))
    assert f[:7].tolist() == again.tolist() and m.tolist() == [7]


def brute_weights(texts: dict, good: set) -> dict:
    """Weights by counting every feature of every document in dictionaries."""
    per = {}
    for i, t in texts.items():
        f, _ = quality.features(*textvec.buffers(pa.array([t or ""])))
        per[i] = Counter(f.tolist())
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for i, c in per.items():
        for b, k in c.items():
            raw[b] += k
            target[b] += k * (i in good)
    p = (raw + 0.5) / (raw.sum() + 0.5 * quality.BUCKETS)
    prior = quality.PRIOR * quality.BUCKETS * p
    q = (target + prior) / (target.sum() + prior.sum())
    return {i: sum(k * np.log(q[b] / p[b]) for b, k in c.items()) for i, c in per.items() if c}


def test_texts_are_weighed_once(spark, monkeypatch):
    """Each evaluation in a plan takes a Python worker of its own in every task, which stays in the executor's memory."""
    texts, marks = corpus(40)
    put, plans = quality.Scratch.put, []

    def watched(self, df, *more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return put(self, df, *more)

    monkeypatch.setattr(quality.Scratch, "put", watched)
    quality.scored(spark, tx.frame(spark, tx.rows(texts)), labels(spark, marks))
    assert [p.count("ArrowEvalPython") for p in plans] == [1]


def test_weights_and_top_k_against_brute_force(spark):
    texts, marks = corpus()
    df = tx.frame(spark, tx.rows(texts))
    ranked, least, log, rank = quality.scored(spark, df, labels(spark, marks))
    rows = ranked.collect()
    want = brute_weights(texts, {i for i, q, _ in marks if q == 1})
    for r in rows:
        assert r[log] / quality.SCALE == pytest.approx(want[r.doc_id], abs=0.02)
    share = sum(q for _, q, _ in marks) / len(marks)
    k = round(sum(min(1.0, share * np.exp(min(50, r[log] / quality.SCALE))) for r in rows))
    kept = sorted((r[rank] for r in rows), reverse=True)[:k]
    assert min(kept) == least
    got = {r.doc_id for r in quality.resample(spark, df, labels(spark, marks)).collect()}
    assert got == {r.doc_id for r in rows if r[rank] >= least}
    assert sum(i % 4 != 0 for i in got) >= 0.95 * len(got) and sum(i % 4 != 0 for i in got) >= 0.95 * 300


def test_kth_greatest(spark):
    r = random.Random(1)
    values = [r.randint(-(1 << 62), 1 << 62) for _ in range(200)] + [7, 7, -1, 0]
    df = spark.createDataFrame([(v,) for v in values], "x long").cache()
    for k in (1, 2, 50, 204):
        assert quality.kth_greatest(df, "x", k) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_greatest(df, "x", 205) is None


def test_odd_rows(spark):
    texts, marks = corpus(120)
    rows = [*tx.rows(texts), *[(None if i is None else i + 1000, *r) for i, *r in tx.odd_rows()], (5000, texts[1], "en", "web", 3), (5000, texts[1], "en", "web", 3)]
    df = tx.frame(spark, rows, True)
    odd = [*marks, (None, 1, 0), (7, None, 0), (1, 0, 1), (1, 1, 1)]
    got = quality.resample(spark, df, labels(spark, odd))
    assert got.columns == df.columns
    out = got.collect()
    assert all(r.text and r.text.strip() for r in out)
    assert all(r["__weight"] == "own __weight" and r["a.b"] == "own a.b" for r in out)
    assert sum(r.doc_id == 5000 for r in out) in (0, 2)


def test_without_good_labels_all_with_a_word_stay(spark):
    texts, _ = corpus(20)
    rows = [*tx.rows(texts), (90, "", None, None, 0), (91, None, None, None, None)]
    assert quality.resample(spark, tx.frame(spark, rows), labels(spark, [(0, 0, 0)])).count() == 20
    assert quality.resample(spark, tx.frame(spark, rows), labels(spark, [])).count() == 20


def test_empty_table(spark):
    assert quality.resample(spark, tx.frame(spark, []), labels(spark, [(1, 1, 0)])).count() == 0


def test_query(spark, small):
    """All of the documents labelled good are there but a few, and weights tell good from bad."""
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    got = {r.doc_id: r.log_weight for r in queries.op6_quality_resample(spark, small).collect()}
    good = [i for i, q in known.items() if q == 1]
    bad = [i for i, q in known.items() if q == 0]
    kept = lambda ids: sum(i in got for i in ids) / max(1, len(ids))
    assert kept(good) > 0.8 and kept(good) > kept(bad) + 0.3
