from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
import texts as tx
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmill.llm import queries, toxic_crf

BAD = ("vilescum", "dirtfiend", "rotbrain", "filthlord")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.floats(0.01, 50), min_size=1, max_size=9), max_size=4), st.lists(st.floats(0.05, 9), min_size=4, max_size=4), st.integers(1, 5))
def test_marginals_against_all_labellings(chains, potentials, block):
    """Forward and backward over blocks, against the sum over every labelling."""
    move = np.array(potentials).reshape(2, 2)
    count = np.array([len(c) for c in chains], np.int64)
    got = toxic_crf.marginals(np.array([x for c in chains for x in c], float), np.cumsum(count) - count, count, move, block)
    want = []
    for c in chains:
        total, ones = 0.0, np.zeros(len(c))
        for y in itertools.product((0, 1), repeat=len(c)):
            w = np.prod([x if s else 1 for x, s in zip(c, y, strict=True)]) * np.prod([move[a, b] for a, b in itertools.pairwise(y)])
            total += w
            ones += w * np.array(y)
        want += (ones / total).tolist()
    np.testing.assert_allclose(got, want, rtol=1e-6, atol=1e-9)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.floats(-2, 2), min_size=1, max_size=8), min_size=1, max_size=3), st.lists(st.floats(-1.5, 1.5), min_size=4, max_size=4), st.integers(1, 5))
def test_gradient_against_finite_differences(chains, moves, block):
    """Marginals of places and of moves are the derivatives of the log of all labellings' potentials."""
    count = np.array([len(c) for c in chains], np.int64)
    scores, moves = np.array([x for c in chains for x in c]), np.array(moves)

    def log_sum(scores, moves):
        move, total, at = np.exp(moves).reshape(2, 2), 0.0, 0
        for n in count:
            s, at = scores[at : at + n], at + n
            total += np.log(sum(np.exp(np.dot(s, y)) * np.prod([move[a, b] for a, b in itertools.pairwise(y)]) for y in itertools.product((0, 1), repeat=int(n))))
        return total

    p, pairs = toxic_crf.expected(np.exp(scores), np.cumsum(count) - count, count, np.exp(moves).reshape(2, 2), block)
    for of, got in ((0, p), (1, pairs.ravel())):
        for i in range(len(got)):
            step = np.zeros(len((scores, moves)[of]))
            step[i] = 1e-5
            up, down = [(scores + d, moves) if of == 0 else (scores, moves + d) for d in (step, -step)]
            assert abs((log_sum(*up) - log_sum(*down)) / 2e-5 - got[i]) < 1e-4


def test_no_feature_loses_its_weight():
    r = np.random.default_rng(3)
    features = np.unique(r.integers(1, 1 << 63, 60_000, dtype=np.uint64) << np.uint64(1))
    features = np.concatenate([features, np.arange(1, 400, dtype=np.uint64)])  # many in one slot
    weights = r.normal(size=len(features))
    table = toxic_crf.Table(features, weights)
    order = r.permutation(len(features))
    assert (table.of(features[order]) == weights[order]).all()
    assert not table.of(np.concatenate([[0], features[:1000] + np.uint64(1 << 40)]).astype(np.uint64))[:1].any()
    assert (toxic_crf.Table(features[:0], weights[:0]).of(features[:9]) == 0).all()


def corpus(n: int = 400, seed: int = 1):
    r = random.Random(seed)
    texts, toxic = {}, {}
    for i in range(n):
        w = tx.prose(seed * 10_000 + i, r.randrange(20, 120)).split()
        toxic[i] = int(i % 5 == 0)
        if toxic[i]:
            for _ in range(3):
                w.insert(r.randrange(len(w)), f"{r.choice(BAD)}{r.choice(['', '!', ','])}")
        texts[i] = " ".join(w)
    return texts, toxic


def labels(spark, toxic):
    return spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_offsets(spark):
    texts, toxic = corpus()
    unseen, truth = corpus(200, 2)
    both = {**texts, **{i + 1000: "é你 " + t for i, t in unseen.items()}}
    got = {r.doc_id: r for r in toxic_crf.toxic_spans(spark, tx.frame(spark, tx.rows(both), True), labels(spark, toxic)).collect()}
    assert {i - 1000 for i in got if i >= 1000} == {i for i, t in truth.items() if t}
    for i, r in got.items():
        assert r.n_spans == len(r.spans) and 0.5 <= r.score <= 1
        for s in r.spans:
            assert any(w.strip(".,!").lower() in BAD for w in both[i][s.start_char : s.end_char].split())


def test_odd_rows(spark):
    texts, toxic = corpus()
    odd = [(None if i is None else i + 5000, *r) for i, *r in tx.odd_rows()]
    rows = [*tx.rows(texts), *odd, (7000, f"you {BAD[0]}", None, None, 0), (7000, f"you {BAD[0]}", None, None, 0), (None, f"You {BAD[1].upper()}!", None, None, 0), (7001, "z " * 40_000 + BAD[2], None, None, 0)]
    marks = labels(spark, toxic).unionByName(spark.createDataFrame([(None, 1, 1), (1, 1, None), (7, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int"))
    got = toxic_crf.toxic_spans(spark, tx.frame(spark, rows, True), marks).collect()
    late = sorted(str(r.doc_id) for r in got if r.doc_id is None or r.doc_id >= 5000)
    assert late == ["7000", "7000", "7001", "None"]
    assert next(r for r in got if r.doc_id == 7001).spans[0].start_char == 80_000


def test_one_of_an_ids_texts_is_fitted_on(spark):
    """The same one in any order of the rows."""
    rows = tx.rows({i: f"text {i}" for i in range(20)})
    twice = [*rows, *[(i, f"other text {i}", *rest) for i, _, *rest in rows]]
    marks = labels(spark, {i: i % 2 for i in range(20)})
    got = [sorted(toxic_crf.training_rows(tx.frame(spark, x).repartition(n), marks, "doc_id", "text", 50).collect()) for x, n in ((twice, 1), (twice[::-1], 3))]
    assert got[0] == got[1] and len(got[0]) == 20


@pytest.mark.parametrize("marks", [{}, {0: 1, 5: 1}, {1: 0, 2: 0}])
def test_nothing_to_fit(spark, marks):
    texts, _ = corpus(20)
    assert toxic_crf.toxic_spans(spark, tx.frame(spark, tx.rows(texts)), labels(spark, marks)).count() == 0


def test_empty_table(spark):
    assert toxic_crf.toxic_spans(spark, tx.frame(spark, []), labels(spark, {1: 1, 2: 0})).count() == 0


def test_held_out_documents():
    """Fitted on half of the labelled documents of the largest small data set, held against the other half."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from glyphmill.llm import textvec as tv

    where = "/root/testdata/sf0.1"
    try:
        docs, marks = (pq.read_table(f"{where}/{t}.parquet").to_pydict() for t in ("documents", "labels"))
    except FileNotFoundError:
        pytest.skip("no test data here")
    text = dict(zip(docs["doc_id"], docs["text"], strict=True))
    rows = [(text[i], bool(t)) for i, t in zip(marks["doc_id"], marks["toxic"], strict=True) if text.get(i)]
    field = toxic_crf.fit(*map(list, zip(*rows[::2], strict=True)))
    found, truth = [], np.array([t for _, t in rows[1::2]])
    for _, data, offsets in tv.chunks(iter([pa.record_batch([pa.array([t for t, _ in rows[1::2]])], ["text"])]), "text"):
        w = tv.words(data, offsets)
        p = field.tag(w)
        at = np.flatnonzero(p >= 0.5)
        evidence = np.bincount(w.text[at], toxic_crf.log_odds(p[at]), len(w.count))
        found += ((evidence > 0) & (field.documents(evidence) >= 0.5)).tolist()
    found = np.array(found)
    assert found[truth].mean() >= 0.95 and found[~truth].mean() <= 0.01


def test_query(spark, small):
    """So few labels teach little, but nothing wrong."""
    known = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    got = {r.doc_id for r in queries.op3_toxic_spans(spark, small).collect()}
    bad, good = [i for i, t in known.items() if t], [i for i, t in known.items() if t == 0]
    assert sum(i in got for i in bad) >= 0.5 * len(bad) and not any(i in got for i in good)
