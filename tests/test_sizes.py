"""Work and memory that grow with the texts and no faster, with the results of the plain way."""

from __future__ import annotations

import difflib
import time
import tracemalloc

import compare
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.functions import arrow, diff, extensions
from glyphmill.operators import dataset, evaluation
from glyphmill.operators.font_gate import Gate
from glyphmill.plans import queries


def test_report_reads_each_text_once(spark):
    """A pass for each kind of character takes minutes here."""
    text = "".join(map(chr, range(0x20, 0x7F))) * 2_000 + "“½”\U0001f600"
    df = spark.createDataFrame([(i, text) for i in range(20)] + [(20, None), (21, ""), (22, "½a")], "id long, text string").repartition(4)
    began = time.time()
    got = {r.ch: (r.occurrences, r.first_position) for r in Gate().report(df, [], "text").collect()}
    assert time.time() - began < 20
    assert got["a"] == (40_001, 1) and got["½"] == (21, 0) and got["“"] == (20, 190_000) and got["~"] == (40_000, 94)
    assert "\U0001f600" not in got


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory) -> str:
    """Documents without a text, and with an empty one, among others."""
    at = tmp_path_factory.mktemp("tables")
    texts = [None, "", "a, b. c", "x ! y ; z", 'Il dit: "oui", no. 3 - (c)...', "one two three four\nfive six seven eight"]
    spark.createDataFrame([(i, t, ("en", "fr", "de", "es")[i % 4], "web") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, "http://a.example/b", "<p>"), (1, None, None)], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return str(at)


RULES = {
    "rule_french_high_punctuation": (3, "x\u202f! y\u202f; z", " a\u202f; b"),
    "ext_widows": (5, "two three four\nfive", "15 sentence."),
    "rule_french_ligatures": (1, " cœur Sœur Œuvre", "11oeuf"),
    "rule_german_eszett": (1, " STRAẞE ", "11HEISS"),
    "rule_single_letter_nbsp_es": (1, " y vino o agua "),
    "ext_italian_accents": (1, " perché ", "citta'x"),
    "ext_inverted_marks": (1, "¿Dónde?", "¡Qué increíble!"),
}


@pytest.mark.parametrize("name", RULES)
def test_rules_are_one_python_pass(spark, folder, name):
    """Each step as an expression of its own takes several times as long as the rule's Python form."""
    df = queries.QUERIES[name](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp" not in plan
    got = {r.doc_id: r for r in df.collect()}
    doc, *parts = RULES[name]
    assert len(got) == 6 and got[0].corrected is None and got[0][2] is None
    assert all(p in got[doc].corrected for p in parts) and got[doc][2]


@pytest.mark.parametrize("text", ["", "a b c d", "a b c d\n", "a b c d\n\ne f g h", "a  b c d", "a b c d ", "a b c d e", "a\tb c d e", "a b c d e", " b c d", "x a b c d\r\ne f g h", "a b c d e f\n g h"])
def test_widows_by_line_ends(text):
    rule, log, plain = extensions.BY_NAME["widows"], [], []
    assert rule.run(text, "en-US", log) == rule.subs("en-US")[0].run(text, "widows", plain) and log == plain


def test_widows_of_one_long_word():
    """The pattern reads the word again from each of its characters."""
    began = time.time()
    assert extensions.BY_NAME["widows"].run("a" * 300_000 + " b c d", "en-US", None).endswith(" b c d")
    assert extensions.BY_NAME["widows"].run("a" * 300_000, "en-US", None) == "a" * 300_000
    assert time.time() - began < 5


def test_few_rows_are_python_objects_at_once():
    texts = pa.array(["x" * 20_000] * 2_000)
    run = arrow.in_slices(lambda x: [x[:1]] * 50, pa.list_(pa.string()))
    tracemalloc.start()
    got = run(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 2_000 and got[1_999].as_py() == ["x"] * 50
    assert peak < 10e6  # all at once: 40 MB of texts alone
    assert run(texts.slice(0, 0)).to_pylist() == []


BATCHES = [
    "lint_strict",
    "lint_log",
    "lint_stats_by_lang_rule",
    "character_diffs",
]


@pytest.mark.parametrize("name", BATCHES)
def test_batches_are_cut_by_bytes(spark, folder, name):
    """10,000 long texts at once fill the workers' memory."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert queries.QUERIES[name](spark, folder).count() > 0
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(arrow.BATCH_BYTES)


PARTS = ["a", "e", "e", "t", " ", " ", ", ", " - ", "—", "qu", "2020", "(c)", "©", "…", "x", "zz", "Å", "\U0001f600", "the end", "ab" * 20]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS), min_size=60, max_size=300), st.lists(st.tuples(st.integers(0, 299), st.sampled_from(["", *PARTS])), max_size=30))
def test_diff_as_the_library(parts, changed):
    new = list(parts)
    for at, x in changed:
        new[at % len(new)] = x
    a, b = "".join(parts), "".join(new)
    for x, y in ((a, b), (b, a)):
        mine, theirs = diff.matcher(x, y), difflib.SequenceMatcher(None, x, y)
        assert mine.get_opcodes() == theirs.get_opcodes() and mine.ratio() == theirs.ratio()


def test_diff_of_a_long_text():
    """The library takes minutes: the square of the length, times the number of changes."""
    words = "the quick brown fox jumps, over 10 lazy dogs. Zebras vex Jack, who may quit".split(" ")
    old = " ".join(words[(i * i + i // 7) % len(words)] + chr(0x4E00 + i * i % 211) for i in range(20_000))
    began = time.time()
    steps = diff.matcher(old, old.replace("y", " – ").replace("quit", "QUIT")).get_opcodes()
    assert time.time() - began < 10 and len(steps) > 1_000


def test_stripping_is_no_search(spark):
    """A search for white space at the end begins anew at each blank: here some 10^10 steps."""
    ends = "".join(c for c in map(chr, range(0x110000)) if c.isspace())
    rows = [(f"{ends}a b{ends}", "a b"), (" " * 200_000 + "x", "x"), ("x" + " " * 200_000 + "y", "x" + " " * 200_000 + "y"), (ends, ""), ("", ""), (None, None)]
    began = time.time()
    got = spark.createDataFrame(rows, "t string, want string").select(evaluation.stripped(F.col("t")).alias("t"), "want").collect()
    assert time.time() - began < 15 and [r.t for r in got] == [r.want for r in got]


def test_font_log_stays_in_the_row(spark):
    """No array of all characters, no sort by text; of two rows with one id each has its own places."""
    text = "…a½⁦x‽y"
    df = spark.createDataFrame([(1, text), (1, text), (2, None), (3, ""), (4, "plain")], "id long, text string")
    log = Gate(range(0x20, 0x7F)).log(df, "id", "text")
    plan = log._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "transform" not in plan
    got = sorted((r.position, r.output_position, r.original, r.replacement) for r in log.collect())
    want = [(0, 0, "…", "..."), (2, 4, "½", "1/2"), (3, 7, "⁦", ""), (5, 8, "‽", "?!")]
    assert got == sorted(want * 2)
    assert Gate({*range(0x110000)} - {0xD800}).log(df, "id", "text").count() == 0


def test_explained_pairs_move_few_texts(spark, tmp_path):
    """The first two of a group keep their own indexes where their texts are the same; ties and missing indexes as in one sort."""
    texts = [(i, "same" if i % 55 in (1, 11) else f"t{i}", "en", "web") for i in range(600)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.QUERIES["pairs_explanation"](spark, str(tmp_path))
    con = compare.connection(str(tmp_path))
    found = con.execute(queries.ORACLE["pairs_explanation"])
    assert compare.rows(df.columns, df.collect()) == compare.rows([d[0] for d in found.description], found.fetchall())

    templates = spark.createDataFrame([("r", "en-US", i, f"a{i}", "b") for i in (5, 3, None, 9)] + [("q", "en-US", 4, x, "b") for x in "xyz"] + [("p", "en-US", 1, "a", "b"), ("r", None, 1, "a", "b")], "rule string, lang string, idx long, raw string, correct string")
    why = spark.createDataFrame([("r", "en-US", "w"), ("q", "en-US", "w")], "rule string, lang string, explanation string")
    got = sorted((r.metadata.rule, -1 if r.idx is None else r.idx) for r in dataset.explanation_pairs(templates, why, keep=("idx",)).collect())
    assert got == [("q", 4), ("q", 4), ("r", -1), ("r", 3)]
