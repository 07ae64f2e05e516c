"""The pipeline on a fixture: every stage against a brute-force version of what it says, on its own input."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline as cp
import pytest
import texts as tx
from test_near_dups import changed, jaccard
from test_packing import check
from test_substrings import brute

from glyphmill.llm import packing, secrets

KEY = "aK3" + "9xQ2mZ7pL4vB8nR1tY6w"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    r = random.Random(9)
    junk = ["!!!", "$$$", "click", "buy", "now", "free", "win", "###"]
    texts, i = {}, 0
    for b in range(120):
        base = tx.prose(b, r.randrange(30, 200))
        texts[i] = base + (f" key {KEY}{b % 10}" if b % 7 == 0 else "")
        i += 1
        if b % 10 == 0:
            texts[i] = texts[i - 1]
            texts[i + 1] = changed(base, 0.01, b)
            i += 2
    shared = tx.prose(999, 80)
    for b in range(12):
        texts[i] = f"{tx.prose(2000 + b, 60)} {shared} {tx.prose(3000 + b, 40)}"
        i += 1
    for b in range(50):
        texts[i] = " ".join(r.choice(junk) for _ in range(90))
        i += 1
    texts |= {i: None, i + 1: "", i + 2: " \n "}
    where = tmp_path_factory.mktemp("corpus")
    tx.frame(spark, tx.rows(texts)).write.parquet(f"{where}/documents.parquet")
    marks = [(k, int(k < i - 50), 0) for k in range(i)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    docs = spark.read.parquet(f"{where}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, out[-1], str(where)).write.parquet(f"{where}/{k}")
        out.append(spark.read.parquet(f"{where}/{k}"))
    return str(where), out, i - 50


def test_columns(steps):
    _, out, _ = steps
    assert all(df.columns == out[0].columns for df in out[:-1])
    assert [n for n, _ in cp.STAGES] == ["quality", "near_dedup", "substring_dedup", "secrets", "packing"]


def test_quality_drops_junk_and_keeps_clean(steps):
    _, out, junk = steps
    kept = {r.doc_id for r in out[1].collect()}
    clean = range(junk)
    assert sum(i in kept for i in clean) >= 0.9 * junk and sum(i in kept for i in range(junk, junk + 50)) <= 5
    assert not any(i in kept for i in range(junk + 50, junk + 53))


def test_one_of_each_group_stays(steps):
    _, out, _ = steps
    before = {r.doc_id: r.text for r in out[1].collect()}
    after = {r.doc_id for r in out[2].collect()}
    near = {a: [b for b in before if b != a and jaccard(before[a], before[b]) >= 0.85] for a in before}
    for a in before:
        if not near[a]:
            assert a in after
        else:
            assert len({a, *near[a]} & after) == 1 and min([a, *near[a]]) in after


def test_repeats_go_and_all_else_stays(steps):
    _, out, _ = steps
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in out[2:4])
    again = brute(list(after.items()), 50)
    assert brute(list(before.items()), 50) and not again
    spans = {}
    for i, s, e in brute(list(before.items()), 50):
        spans.setdefault(i, []).append((s, e))
    for i, t in before.items():
        outside = [w for k, w in enumerate(t.split()) if not any(s <= k < e for s, e in spans.get(i, []))]
        left = Counter(after.get(i, "").split())
        assert not Counter(outside) - left


def test_secrets_are_redacted(steps):
    _, out, _ = steps
    before, after = ({r.doc_id: r for r in df.collect()} for df in out[3:5])
    assert before.keys() == after.keys()
    assert any(KEY in r.text for r in before.values()) and not any(KEY in r.text for r in after.values())
    for i, r in after.items():
        assert r.n_chars == len(r.text) and (secrets.MARK in r.text or r.text == before[i].text)


def test_packing_and_run(spark, steps):
    where, out, _ = steps
    rows = [(r.doc_id, r.text) for r in out[4].collect()]
    check(rows, out[5].collect(), packing.CAPACITY)
    ran = cp.run(spark, where).collect()
    assert sorted(map(tuple, ran)) == sorted(map(tuple, out[5].collect()))


def test_empty_corpus(spark, tmp_path):
    tx.frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
