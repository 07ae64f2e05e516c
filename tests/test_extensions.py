"""Corrections beyond the default chain: what each changes, and what it leaves."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import dims, extensions, rules
from glyphmill.plans import eval_cases, lint

N, T = " ", " "
CHANGES = [
    ("arrows", "en-US", "click -> next, step <- back, this <-> that", "click → next, step ← back, this ↔ that"),
    ("arrows", "en-US", "obj->call() and x => y and `a -> b`", None),
    ("currency", "en-US", "$ 10.50 or $10.50", "$10.50 or $10.50"),
    ("currency", "pt-PT", "custa 10€.", f"custa 10{N}€."),
    ("currency", "fr-FR", "10 € pour tout", f"10{N}€ pour tout"),
    ("currency", "nl-NL", "€10,00", f"€{N}10,00"),
    ("currency", "pt-PT", "`$10`", None),
    ("percent", "fr-FR", "25%", f"25{T}%"),
    ("percent", "de-DE", "25 %", f"25{N}%"),
    ("percent", "en-US", "25 % and 30%", "25% and 30%"),
    ("thousands", "fr-FR", "1 000 000 et 12 34", f"1{T}000{T}000 et 12 34"),
    ("serial_comma", "en-US", "red, white and blue", "red, white, and blue"),
    ("serial_comma", "en-US", "salt and pepper", None),
    ("serial_comma", "fr-FR", "rouge, blanc, et bleu", "rouge, blanc et bleu"),
    ("serial_comma", "de-DE", "rot, weiß, und blau", "rot, weiß und blau"),
    ("colon_capitalisation", "en-US", "It was clear: he was guilty.", "It was clear: He was guilty."),
    ("colon_capitalisation", "en-US", "One goal: To win.", "One goal: to win."),
    ("colon_capitalisation", "en-US", "The winner: Maria took it. Craig: Pedro-Francisco is here.", None),
    ("quote_punctuation", "en-US", 'He called it "fine".', "He called it “fine.”"),
    ("quote_punctuation", "en-GB", "He called it ‘fine.’", "He called it ‘fine’."),
    ("quote_punctuation", "de-DE", "Er nannte es „gut.“", "Er nannte es „gut“."),
    ("footnote_marks", "en-US", "It matters¹.", "It matters.¹"),
    ("footnote_marks", "en-US", "Done.¹", None),
    ("footnote_marks", "fr-FR", "Elle est là.¹", "Elle est là¹."),
    ("inverted_marks", "es-ES", "Hola. Donde vives? Bien.", "Hola. ¿Dónde vives? Bien."),
    ("inverted_marks", "es-ES", "Que increible!", "¡Qué increíble!"),
    ("inverted_marks", "es-ES", "¿Dónde vives?", None),
    ("inverted_marks", "es-ES", "Donde? Como? Ya!", "¿Dónde? ¿Cómo? ¡Ya!"),
    ("italian_accents", "it-IT", "Perche' no? e' un caffe'.", "Perché no? è un caffè."),
    ("italian_accents", "it-IT", "l’opera lirica", None),
    ("capital_accents", "es-ES", "MEXICO DF", "MÉXICO DF"),
    ("capital_accents", "it-IT", "CITTA del vaticano", "CITTÀ del vaticano"),
    ("capital_accents", "pt-PT", "AGUA fresca, AGUARDAR", "ÁGUA fresca, AGUARDAR"),
    ("french_capital_a", "fr-FR", "A PARIS", "À PARIS"),
    ("locale_dashes", "de-DE", "foo - bar", "foo – bar"),
    ("locale_dashes", "fr-FR", "foo - bar", f"foo{T}—{T}bar"),
    ("locale_dashes", "es-ES", "uno - dos - tres", "uno —dos— tres"),
    ("initials_exemption", "en-US", "the U.S. and J.R.R. Tolkien", f"the U.S. and J.{N}R.{N}R. Tolkien"),
    ("whitespace", "en-US", "a\tb  c \nd  ", "a b c\nd"),
    ("widows", "en-US", "This is a short sentence.", f"This is a short{N}sentence."),
    ("widows", "en-US", "Hi there friend.", None),
    ("nested_quotes", "en-US", 'She said "he replied "yes" politely" and left.', "She said “he replied ‘yes’ politely” and left."),
    ("nested_quotes", "en-US", 'He said "yes" and she said "no".', "He said “yes” and she said “no”."),
    ("nested_quotes", "pt-PT", '"Ele disse "olá" x"', "« Ele disse “olá” x »"),
]


@pytest.mark.parametrize("name, lang, text, want", CHANGES)
def test_change(name, lang, text, want):
    plain = lint.lint_row(text, lang)[0]
    assert lint.lint_row(text, lang, extensions=(name,))[0] == (plain if want is None else want)
    if name not in ("quote_punctuation", "nested_quotes", "initials_exemption"):
        assert plain != want  # nothing of it by default


def test_columns_and_python_agree(spark):
    texts = [t for _, _, t, _ in CHANGES] + ["", "  ", "a, b, c and d", "10€ 5 % $3", "\n\t x"]
    for rule in extensions.RULES:
        for lang in [x for x in dims.LANGUAGES if rule.holds(x)]:
            df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", rule.apply(F.col("t"), lang).alias("c")) if lang in (rule.langs or ("en-US", "fr-FR"))[:2] else None
            for r in df.collect() if df else []:
                assert r.c == rule.run(r.t, lang, None), (rule.name, lang, r.t)


def test_all_cases_with_extensions():
    """66 of the 83 by the default chain, whose misses all need a correction beyond it."""
    usual = tuple(n for n in extensions.USUAL if n != "initials_exemption")
    plain = [lint.lint_row(a, lang)[0].strip() == b.strip() for _, lang, _, a, b in eval_cases.rows()]
    both = [lint.lint_row(a, lang, extensions=usual)[0].strip() == b.strip() for _, lang, _, a, b in eval_cases.rows()]
    assert len(plain) == 83 and sum(plain) == 66
    assert sum(both) == 83, [r for r, ok in zip(eval_cases.rows(), both, strict=True) if not ok]


def test_lint_text_with_extensions(spark):
    df = spark.createDataFrame([("Donde vives? -> x", "es-ES"), (None, "es-ES")], "text string, lang string")
    assert [r.corrected for r in lint.lint_text(df, extensions=("arrows", "inverted_marks")).collect()] == ["¿Dónde vives? → x", None]
    with pytest.raises(ValueError):
        lint.lint_text(df, extensions=("nonsense",))
    assert not {r.name for r in rules.RULES} & extensions.BY_NAME.keys()
