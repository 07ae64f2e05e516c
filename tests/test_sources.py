from __future__ import annotations

import json

import pytest

from glyphmill.plans import lint
from glyphmill.sources import files
from glyphmill.streaming import lint as stream


@pytest.fixture
def pairs(tmp_path):
    good = [{"instruction": f"do {i}", "input": "é", "output": "x", "metadata": {"type": "correction", "rule": "r", "language": "fr-FR"}} for i in range(3)]
    lines = [json.dumps(good[0], ensure_ascii=False), "", "{broken", json.dumps(good[1]), "   ", json.dumps(good[2])]
    path = tmp_path / "pairs.jsonl"
    path.write_text("\n".join(lines), encoding="utf-8")
    return str(path)


def test_tolerant(spark, pairs):
    assert sorted(r.instruction for r in files.jsonl(spark, pairs).collect()) == ["do 0", "do 1", "do 2"]


def test_audited(spark, pairs):
    got = {r.lineno: (r.error is not None, r.instruction) for r in files.audited_jsonl(spark, pairs).collect()}
    assert got == {1: (False, "do 0"), 3: (True, None), 4: (False, "do 1"), 6: (False, "do 2")}


def test_strict(spark, pairs, tmp_path):
    with pytest.raises(Exception, match="line 3"):
        files.strict_jsonl(spark, pairs).collect()
    files.write_jsonl(files.jsonl(spark, pairs).coalesce(1), str(tmp_path / "out"))
    assert sorted(r.id for r in files.strict_jsonl(spark, str(tmp_path / "out")).collect()) == [0, 1, 2]


def test_whole_texts_and_saved_runs(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n", encoding="utf-8")
    assert files.whole_texts(spark, str(tmp_path / "a.txt")).first().text == "one\ntwo\n"
    (tmp_path / "run.json").write_text(json.dumps({"label": "v1", "cases": [{"rule": "a"}, {"rule": "b"}]}, indent=1), encoding="utf-8")
    assert [(r.label, r.case_id, r.rule) for r in files.saved_run(spark, str(tmp_path / "run.json")).collect()] == [("v1", 0, "a"), ("v1", 1, "b")]


def test_result_as_json(spark):
    df = lint.lint_log(spark.createDataFrame([("Wait... (c) \"a\"", "en-US")], "text string, lang string"))
    from pyspark.sql import functions as F

    got = json.loads(df.select(files.lint_json(F.col("lint.text"), F.col("lint.corrections"), F.col("lang")).alias("j")).first().j)
    assert got["text"] == "Wait… © “a”" and got["stats"] == {"total": 4, "by_rule": {"ellipsis": 1, "copyright_sign": 1, "quotation_marks": 2}}


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    df = spark.createDataFrame([(i, f'He said "{i}"...', "en-US" if i % 2 else None) for i in range(6)], "id long, text string, lang string")
    df.write.parquet(str(tmp_path / "in"))
    q = stream.run(stream.corrected(stream.arriving(spark, str(tmp_path / "in"), df.schema), langs=["en-US"]), str(tmp_path / "out"), str(tmp_path / "state"))
    assert q.awaitTermination(60)
    got = {r.id: r.corrected for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {i: f"He said “{i}”…" if i % 2 else f'He said "{i}"...' for i in range(6)}


def test_run_as_one_file_and_back(spark, tmp_path):
    from glyphmill.operators import evaluation

    rows = [(i, "en", "r", "a b", "a c", "a c" if i % 2 else "a b") for i in range(12)]
    scored = evaluation.score(spark.createDataFrame(rows, "case_id int, language string, rule string, input string, expected string, predicted string"))
    files.write_run(scored, f"{tmp_path}/run", "mine", "2026-01-01T00:00:00Z")
    whole = json.loads("".join(p.read_text() for p in (tmp_path / "run").glob("part-*")))
    assert (whole["label"], whole["total"], whole["exact_matches"], whole["regressions"], len(whole["cases"])) == ("mine", 12, 6, 0, 12)
    back = files.saved_run(spark, f"{tmp_path}/run").orderBy("case_id").collect()
    assert [(r.label, r.exact_match) for r in back] == [("mine", bool(i % 2)) for i in range(12)]
    files.write_run(scored.limit(0), f"{tmp_path}/none", "none", "t")
    assert json.loads("".join(p.read_text() for p in (tmp_path / "none").glob("part-*")))["cases"] == []
