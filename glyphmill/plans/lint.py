"""Linting of a text column: mask, all rules of the row's language in order, unmask."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from glyphmill.functions import arrow, dims, masking, rules
from glyphmill.functions import extensions as ext

CORRECTION = StructType([StructField("position", IntegerType()), *(StructField(n, StringType()) for n in ("original", "replacement", "rule", "description"))])
RESULT = StructType([StructField("text", StringType()), StructField("corrections", ArrayType(CORRECTION))])
#: Rules whose correction other than the rule's name says little.
DESCRIPTIONS = {
    "nfc_normalization": "Composed to Unicode NFC",
    "zero_width_chars": "Zero-width character removed, or a space where it parted letters",
    "quotation_marks": "Straight quote set as the language's mark",
    "primes": "Straight quote after a number set as a prime",
    "minus_sign": "Hyphen set as a minus sign",
    "range_dash": "Hyphen of a range set as an en dash",
    "nested_parentheticals": "Parenthesis inside another set as a bracket",
}


def languages(column: Column) -> Column:
    """The supported language of a code: itself, or that of the corpus's two letters."""
    known = F.create_map(*[F.lit(x) for lang in dims.LANGUAGES for x in (lang, lang)], *[F.lit(x) for pair in dims.LOCALES.items() for x in pair])
    return F.element_at(known, column)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: where its files give fewer parts than there are cores, its rows are dealt round; a larger table stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _check(langs: list[str]) -> None:
    unknown = set(langs) - set(dims.LANGUAGES)
    if unknown:
        raise ValueError(f"unsupported languages: {sorted(unknown)}")


def lint_text(df: DataFrame, text: str = "text", lang: str = "lang", strict: bool = False, langs: list[str] | None = None, out: str = "corrected", extensions: tuple[str, ...] = ()) -> DataFrame:
    """df with the corrected text; null where the text is null or the language isn't supported, or not among ``langs``.

    ``extensions``: names of corrections beyond the default chain.

    One Arrow function: masks and the rules' compiled patterns, each behind a cheap test of whether the
    text holds what it changes. ``lint_columns`` does the same without Python; it takes several times
    as long, as each of some 200 expressions reads the whole text.
    """
    held = frozenset(langs or dims.LANGUAGES)
    _check(sorted(held))
    extra = _extra(extensions)

    def one(x: str | None, y: str | None) -> str | None:
        return _quietly(x, y, strict, extra) if x is not None and y in held else None

    return df.withColumn(out, arrow.mapped(one, pa.string(), StringType(), F.col(text), languages(F.col(lang))))


def _extra(names: tuple[str, ...]) -> tuple[tuple[rules.Rule, ...], tuple[rules.Rule, ...]]:
    nested, after = ext.chosen(tuple(names))
    return ((ext.NESTED,) if nested else ()), after


def _quietly(text: str, lang: str, strict: bool, extra: tuple = ((), ())) -> str:
    covered, taken = masking.mask(text)
    return masking.unmask(rules.run_quietly(covered, lang, strict, *extra), taken)


def lint_columns(df: DataFrame, text: str = "text", lang: str = "lang", strict: bool = False, langs: list[str] | None = None, out: str = "corrected") -> DataFrame:
    """As lint_text, as a fold of Column expressions: each rule is one projection, evaluated for the languages it is for.

    ``langs``: the languages to plan for, all supported ones by default.
    """
    langs = langs or list(dims.LANGUAGES)
    _check(langs)
    own = languages(F.col(lang))
    df = df.withColumn("__lang", own).withColumn("__m", masking.masked(F.col(text))).withColumn("__t", F.col("__m.text"))
    for rule in rules.RULES:
        held = [x for x in langs if rule.holds(x, strict)]
        if not held:
            continue
        # languages for which the rule does the same share a branch
        groups: dict[str, list[str]] = {}
        for x in held:
            same = repr(rule.subs(x)) if rule.subs and not rule.column else repr(dims.QUOTES[x]) + str(x == "en-GB") if rule.name == "quotation_marks" else ""
            groups.setdefault(same, []).append(x)
        if len(groups) == 1 and len(held) == len(langs):
            new = rule.apply(F.col("__t"), held[0])
        else:
            new = F.col("__t")
            for members in groups.values():
                new = F.when(F.col("__lang").isin(members), rule.apply(F.col("__t"), members[0])).otherwise(new)
        df = df.withColumn("__t", new)
    done = F.when(F.col("__lang").isin(langs), masking.restored(F.col("__t"), F.col("__m.taken")))
    return df.withColumn(out, done).drop("__lang", "__m", "__t")


def lint_row(text: str, lang: str, strict: bool = False, extensions: tuple[str, ...] = ()) -> tuple[str, list[rules.Edit]]:
    _check([lang])
    covered, taken = masking.mask(text)
    new, log = rules.run_all(covered, lang, strict, *_extra(extensions))
    return masking.unmask(new, taken), log


def lint_log(df: DataFrame, text: str = "text", lang: str = "lang", strict: bool = False, out: str = "lint") -> DataFrame:
    """df with struct(text, corrections): as lint_text, with the log of all corrections. Positions are those in the masked text when the rule ran."""

    def one(x: str | None, own: str | None) -> dict | None:
        if x is None or own is None:
            return None
        new, log = lint_row(x, own, strict)
        return {"text": new, "corrections": [{"position": p, "original": a, "replacement": b, "rule": r, "description": DESCRIPTIONS.get(r, r.replace("_", " "))} for p, a, b, r in log]}

    kind = pa.struct([("text", pa.string()), ("corrections", pa.list_(pa.struct([("position", pa.int32()), *((n, pa.string()) for n in ("original", "replacement", "rule", "description"))])))])
    # once: else a filter on the number of corrections, which explode implies, would run it a second time
    return df.withColumn(out, arrow.mapped(one, kind, RESULT, F.col(text), languages(F.col(lang)), once=True))


def stats(logged: DataFrame, by: list[str], out: str = "lint") -> DataFrame:
    """Corrections by the given columns and rule."""
    each = logged.select(*by, F.explode(f"{out}.corrections").alias("c"))
    return each.groupBy(*by, F.col("c.rule").alias("rule")).agg(F.count("*").alias("n"))
