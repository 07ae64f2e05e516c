"""Scoring of predictions, their roll-up, and the comparison of runs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from glyphmill.functions import arrow, diff, dims, regex

_SPACE = regex.SPACE
#: The characters of _SPACE.
_ENDS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_NOTHING = "no change|no correction|no changes|no corrections needed|keine Änderungen|keine Korrekturen|keine Korrektur|sin correcciones|aucune correction|nessuna correzione|sem correções?|no cambios|The (?:input|text) is already correct"
_NOTE = "|".join("Hinweis Nota Notă Note Observação Observación Opmerking Remarque".split())


MISSING = "[ERROR: no prediction]"


def stripped(c: Column) -> Column:
    """Without white space at both ends, as Unicode has it."""
    return F.btrim(c, F.lit(_ENDS))


def clean_prediction(c: Column) -> Column:
    """Cut at the first blank line, trailing notes and wrappers off; a last double quote goes too."""
    c = F.split_part(c, F.lit("\n\n"), F.lit(1))
    end = rf"\.?{_SPACE}*(?=\n?\z)"
    c = F.regexp_replace(c, rf"(?iu){_SPACE}*[(\[](?:{_NOTHING})[^)\]]*[)\]]{end}", "")
    c = F.regexp_replace(c, rf"(?iu){_SPACE}*[(\[](?:{_NOTE}){_SPACE}*:[^)\]]*[)\]]{end}", "")
    c = F.regexp_replace(c, rf"(?isu){_SPACE}*The final answer is:.*\z", "")
    c = F.regexp_replace(c, rf'(?iu)\AThe corrected (?:text|output) is:{_SPACE}*["“]?', "")
    c = F.regexp_replace(c, rf'["”]?{_SPACE}*\z', "")
    return stripped(c)


def similarity(expected: Column, predicted: Column) -> Column:
    """Ratcliff-Obershelp ratio by the standard library; an empty expectation is met by an empty text only."""

    def one(a: str | None, b: str | None) -> float | None:
        if a is None or b is None:
            return None
        return 1.0 if a == b else diff.matcher(a, b).ratio() if a else 0.0

    return arrow.mapped(one, pa.float64(), DoubleType(), expected, predicted)


def instruction(lang: Column, register: Column | None = None, output_only: bool = True) -> Column:
    names = F.create_map(*[F.lit(x) for pair in dims.NAMES.items() for x in pair])
    use = F.when(register.isNull(), F.lit("")).otherwise(F.concat(F.lit(" for "), register, F.lit(" use"))) if register is not None else F.lit("")
    tail = ". Output only the corrected text, no explanation." if output_only else "."
    return F.concat(F.lit("Correct the typography in the following "), F.coalesce(names[lang], lang), F.lit(" text"), use, F.lit(tail))


def alpaca(task: Column, text: Column) -> Column:
    """The prompt; without an input section where there is no input."""
    head = "Below is an instruction that describes a task"
    full = F.concat(F.lit(f"{head}, paired with an input that provides further context. Write a response that appropriately completes the request.\n\n### Instruction:\n"), task, F.lit("\n\n### Input:\n"), text, F.lit("\n\n### Response:\n"))
    bare = F.concat(F.lit(f"{head}. Write a response that appropriately completes the request.\n\n### Instruction:\n"), task, F.lit("\n\n### Response:\n"))
    return F.when(F.coalesce(text, F.lit("")) == "", bare).otherwise(full)


def score(cases: DataFrame, cleaned: bool = True, batches: dict[str, int] | None = None, with_similarity: bool = True) -> DataFrame:
    """cases (case_id, language, rule, input, expected, predicted) with exact_match, similarity_score, regression and batch (-1: none); a missing prediction is an error's text."""
    p = F.coalesce("predicted", F.lit(MISSING))
    df = cases.withColumn("predicted", clean_prediction(p) if cleaned else p)
    df = df.withColumns({"__p": stripped(F.col("predicted")), "__e": stripped(F.col("expected"))}).withColumn("exact_match", F.col("__p") == F.col("__e"))
    number = F.create_map(*[F.lit(x) for pair in (batches or {"": -1}).items() for x in pair])
    df = df.withColumn("batch", F.coalesce(number[F.col("rule")], F.lit(-1)))
    if with_similarity:
        df = df.withColumns({"__s": similarity(F.col("__e"), F.col("__p")), "__i": similarity(F.col("__e"), F.col("input"))})
        df = df.withColumns({"similarity_score": F.bround("__s", 4), "regression": ~F.col("exact_match") & (F.col("__s") < F.col("__i"))}).drop("__s", "__i")
    return df.drop("__p", "__e")


def _figures(scored: DataFrame) -> list[Column]:
    """Cases, exact matches, and of a full score mean similarity and regressions."""
    more = [F.avg("similarity_score").alias("mean_similarity"), F.sum(F.col("regression").cast("long")).alias("regressions")] if "similarity_score" in scored.columns else []
    return [F.count("*").alias("n"), F.sum(F.col("exact_match").cast("long")).alias("exact"), *more]


def rollup(scored: DataFrame) -> DataFrame:
    """Counts and exact matches in all, by language, by rule and by batch, in one pass; of a full score the mean similarity and the regressions too."""
    sets = scored.groupingSets([["language"], ["rule"], ["batch"], []], "language", "rule", "batch")
    names = F.create_map(*[F.lit(x) for pair in ((3, "language"), (5, "rule"), (6, "batch"), (7, "all")) for x in pair])
    done = sets.agg(F.grouping_id().cast("int").alias("__g"), *_figures(scored))
    group = F.coalesce("language", "rule", F.col("batch").cast("string"), F.lit("")).alias("grp")
    return done.select(names[F.col("__g")].alias("grouping_name"), group, *[c for c in done.columns if c not in ("language", "rule", "batch", "__g")])


def failures(scored: DataFrame) -> DataFrame:
    """The cases that aren't met, with all that is known of them."""
    return scored.filter(~F.col("exact_match"))


def overall(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, a, b, delta) of two runs: exact matches and their percentage; of full scores mean similarity and regressions."""
    each = [x.agg(*_figures(x)) for x in (a, b)]
    rows = []
    for x in each:
        kinds = [("exact", F.col("exact").cast("double")), ("exact_pct", F.round(100 * F.col("exact") / F.col("n"), 1))]
        kinds += [("mean_similarity", F.round("mean_similarity", 4)), ("regressions", F.col("regressions").cast("double"))] if "regressions" in x.columns else []
        rows.append(x.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("v")) for k, v in kinds])).alias("r")).select("r.*"))
    both = rows[0].withColumnRenamed("v", "a").join(rows[1].withColumnRenamed("v", "b"), "metric")
    return both.select("metric", "a", "b", F.round(F.col("b") - F.col("a"), 4).alias("delta"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """By language, of both runs: cases of the larger run and exact matches, of full scores mean similarity (null where a run lacks the language) and regressions; a language may be in one run only."""
    full = "similarity_score" in a.columns and "similarity_score" in b.columns
    more = [[F.avg("similarity_score").alias(f"mean_similarity_{s}"), F.sum(F.col("regression").cast("long")).alias(f"regressions_{s}")] if full else [] for s in "ab"]
    per = [x.groupBy("language").agg(F.count("*").alias(f"n_{s}"), F.sum(F.col("exact_match").cast("long")).alias(f"exact_{s}"), *m) for x, s, m in zip((a, b), "ab", more, strict=True)]
    zero = F.lit(0).cast("long")
    return per[0].join(per[1], "language", "full").select("language", F.greatest(F.coalesce("n_a", zero), F.coalesce("n_b", zero)).alias("n"), F.coalesce("exact_a", zero).alias("exact_a"), F.coalesce("exact_b", zero).alias("exact_b"), (F.coalesce("exact_b", zero) - F.coalesce("exact_a", zero)).alias("delta"), *([c for s in "ab" for c in (F.col(f"mean_similarity_{s}"), F.coalesce(f"regressions_{s}", zero).alias(f"regressions_{s}"))] if full else []))


def gained_lost(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cases, by their position, that one run gets right and the other doesn't."""
    both = a.select("case_id", "language", "rule", F.col("exact_match").alias("before")).join(b.select("case_id", F.col("exact_match").alias("after")), "case_id")
    return both.filter("before <> after").select("case_id", "language", "rule", F.when(F.col("after"), "gained").otherwise("lost").alias("change"))
