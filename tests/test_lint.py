"""Known corrections, invariants of linting, and that the Column and the Python form of the rules agree."""

from __future__ import annotations

import time
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.functions import dims, masking, rules
from glyphmill.operators import attribution, evaluation
from glyphmill.plans import lint

N, T = " ", " "
CASES = [
    ("en-US", 'She whispered "be careful" to him.', "She whispered “be careful” to him."),
    ("fr-FR", 'Il a dit: "Oui!"', f"Il a dit{T}: «{T}Oui{T}!{T}»"),
    ("en-US", "J.R.R. Tolkien wrote The Hobbit.", f"J.{N}R.{N}R. Tolkien wrote The Hobbit."),
    ("en-US", f"J.{N}R.{N}R.{N}Tolkien", f"J.{N}R. R.{N}Tolkien"),
    ("en-US", "Copy​paste​artifact", "Copy paste artifact"),
    ("pt-PT", "O 5o andar do edifício.", f"O{N}5.º andar do edifício."),
    ("en-US", "10 - 3 = 7", "10 − 3 = 7"),
    ("en-US", 'Use `"hello"` in your code, but "hello" in prose.', 'Use `"hello"` in your code, but “hello” in prose.'),
    ("de-DE", "Das ist z.B. so.", f"Das ist z.{T}B. so."),
    ("ro-RO", "şi ţară", "și țară"),
    ("en-US", "See http://a.example/b...c and wait...", "See http://a.example/b...c and wait…"),
]


@pytest.mark.parametrize("lang, text, want", CASES)
def test_known_corrections(lang, text, want):
    assert lint.lint_row(text, lang)[0] == want


def test_columns_and_python_agree(spark):
    extra = ["a... b", "5'10\" tall", "(a (b) c)", "Mr Smith paid 10kg (c) 2020", "pp. 10-20, 3x4 and 1/2", "il va à Paris ; non", "don't 'quote' it's", "", "   ", "v1.2.3 @me #tag a_b_c /usr/bin/x camelCaseWord", "École\r\nEtat ETAT"]
    texts = [t for _, t, _ in CASES] + extra
    df = spark.createDataFrame([(t, lang) for t in texts for lang in dims.LANGUAGES] + [(None, "en-US"), ("x", "xx"), ("x", None)], "text string, lang string")
    for strict in (False, True):
        for form in (lint.lint_text, lint.lint_columns):
            for r in form(df, strict=strict).collect():
                want = None if r.text is None or r.lang not in dims.LANGUAGES else lint.lint_row(r.text, r.lang, strict)[0]
                assert r.corrected == want, (form.__name__, r.text, r.lang)


PIECES = ["a", "Z", "7", "ab", "Cd", " ", "  ", "\n", "\u00a0", ".", ",", "-", "_", "/", "\\", "@", "#", "`", "```", "<", ">", "</", "code", "b", ":", "://", "http", "https", "ftp", "v1", ".2", "C:\\", "é", "(", ")", "'", '"', "i"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=24))
def test_regions_as_by_search_at_every_character(pieces):
    text = "".join(pieces)
    for kind, pattern in masking.PATTERNS.items():
        assert [m.span() for m in masking._found(kind, text)] == [m.span() for m in pattern.finditer(text)], (kind, text)
    covered, taken = masking.mask(text)
    assert masking.unmask(covered, taken) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*PIECES, "1/2", "...", " - ", "3-4", "5'", "10kg", "Mr", "oe", "c)", "x", "p. 3", "J.R."]), max_size=24), st.sampled_from(dims.LANGUAGES))
def test_log_or_not_and_tests_first(pieces, lang):
    """The same text with and without a log, and with every rule's patterns run whether their signs are there or not."""
    text = "".join(pieces)
    new, log = rules.run_all(text, lang)
    assert rules.run_quietly(text, lang) == new and bool(log) >= (new != text)
    for rule in rules.of_language(lang):
        if rule.subs and not rule.python:
            plain = text
            for s in rule.subs(lang):
                plain = replace(s, guard=None).run(plain, rule.name, None)
            assert plain == rule.run(text, lang, None), rule.name
            text = plain


def test_long_texts_take_time_in_proportion():
    """A fold that copies the text at each mark would take minutes."""
    text = "'a (b) \"c\" `d` " * 60_000
    began = time.time()
    for lang in ("en-GB", "en-US"):
        lint.lint_row(text, lang)
    assert time.time() - began < 60


@pytest.mark.parametrize("lang", dims.LANGUAGES)
def test_linting_again_changes_nothing(lang):
    for _, text, _ in CASES:
        once = lint.lint_row(text, lang)[0]
        assert lint.lint_row(once, lang)[0] == once or "J." in text


def test_masked_fragments_survive():
    for frag in ("`x = 'a'...`", "http://a.example/it's...", "a.b@c.example", "/usr/local/bin", "v1.2.3", "my_own_name", "<b class=\"x\">"):
        for lang in ("en-US", "fr-FR", "de-DE", "pt-PT"):
            assert frag in lint.lint_row(f"Before {frag} after...", lang)[0]


def test_rules_are_34():
    assert len(rules.RULES) == 34 and len({r.name for r in rules.RULES}) == 34


def test_scores(spark):
    df = spark.createDataFrame([("abc", "abc"), ("", ""), ("", "x"), ("abcd", "abce")], "e string, p string")
    got = [r[0] for r in df.select(evaluation.similarity(F.col("e"), F.col("p"))).collect()]
    assert got == [1.0, 1.0, 0.0, 0.75]


def test_attribution_of_special_spaces(spark):
    df = spark.createDataFrame([(" ", N, "en-US"), (" ", T, "fr-FR"), (" ", " ", "en-US"), ("  ", " ", "de-DE"), ("ab", "cd", "en-US")], "original string, corrected string, lang string")
    assert [r.rule for r in attribution.annotate(df).collect()] == ["number_unit_spacing", "number_unit_spacing", None, "sentence_spacing", None]


def test_rollup_of_a_full_score(spark):
    """Mean similarity and regressions by language and rule, and of two runs."""
    rows = [(1, "en", "r", "a b c", "a b d", "a b d"), (2, "en", "r", "a b c", "a b d", "zzzzz"), (3, "de", "q", "xy", "xz", "xy")]
    schema = "case_id long, language string, rule string, input string, expected string, predicted string"
    scored = evaluation.score(spark.createDataFrame(rows, schema))
    each = {r.case_id: r for r in scored.collect()}
    got = {(r.grouping_name, r.grp): r for r in evaluation.rollup(scored).collect()}
    for key, ids in ((("language", "en"), (1, 2)), (("rule", "q"), (3,)), (("all", ""), (1, 2, 3))):
        assert got[key].mean_similarity == pytest.approx(sum(each[i].similarity_score for i in ids) / len(ids))
        assert got[key].regressions == sum(each[i].regression for i in ids)
    assert got["language", "en"].regressions == 1
    both = {r.language: r for r in evaluation.compare(scored, scored.filter("case_id < 3")).collect()}
    assert (both["en"].regressions_a, both["en"].regressions_b, both["de"].regressions_b, both["de"].mean_similarity_b) == (1, 1, 0, None)
