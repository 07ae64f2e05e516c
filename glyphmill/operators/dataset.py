"""Training pairs: made from templates, validated, measured, sampled and split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphmill.functions import dims
from glyphmill.operators import evaluation

REGISTERS = (None, "editorial", "marketing")
ONLY = "Output only the corrected text, no explanation."
DEFAULT_ERROR = "Typographic error detected."
ORDER = ("pt-PT", "pt-BR", "en-US", "en-GB", "fr-FR", "de-DE", "it-IT", "es-ES", "es-MX", "nl-NL", "nl-BE", "ro-RO", "sc", "_universal")
TIER_1 = ORDER[:9]
TYPES = ("correction", "detection", "cross_language", "explanation")


def language_name(lang: Column, default: str) -> Column:
    names = F.create_map(*[F.lit(x) for pair in (dims.NAMES | {"nl-BE": "Flemish Dutch"}).items() for x in pair])
    return F.coalesce(names[lang], F.lit(default))


def _pair(kind: str, task: Column, text: Column, output: Column, rule: Column, language: Column, register: Column | None = None, source: Column | None = None, target: Column | None = None) -> list[Column]:
    none = F.lit(None).cast("string")
    fields = [F.lit(kind).alias("type"), rule.alias("rule"), language.alias("language"), (none if register is None else register).alias("register"), (none if source is None else source).alias("source_language"), (none if target is None else target).alias("target_language")]
    return [task.alias("instruction"), text.alias("input"), output.alias("output"), F.struct(*fields).alias("metadata")]


def correction_pairs(templates: DataFrame) -> DataFrame:
    """templates (rule, lang, idx, raw, correct) x registers; rows without an error give none."""
    registers = templates.sparkSession.createDataFrame([(r,) for r in REGISTERS], "register string")
    rows = templates.filter("raw <> correct").crossJoin(F.broadcast(registers))
    use = F.coalesce(F.concat(F.lit(" for "), F.col("register"), F.lit(" use")), F.lit(""))
    label = F.when(F.col("lang") == "_universal", F.lit("")).otherwise(F.concat(language_name(F.col("lang"), "any language"), F.lit(" ")))
    task = F.concat(F.lit("Correct the typography in the following "), label, F.lit("text"), use, F.lit(f". {ONLY}"))
    return rows.select(*_pair("correction", task, F.col("raw"), F.col("correct"), F.col("rule"), F.col("lang"), F.col("register")))


def detection_pairs(templates: DataFrame, errors: DataFrame) -> DataFrame:
    """One a row with an error; errors (rule, description) may name the language as {lang}."""
    rows = templates.filter("raw <> correct").join(errors, "rule", "left")
    label = language_name(F.col("lang"), "the given")
    text = F.replace(F.coalesce("description", F.lit(DEFAULT_ERROR)), F.lit("{lang}"), label)
    return rows.select(*_pair("detection", F.concat(F.lit("Identify typographic errors in this "), label, F.lit(" text.")), F.col("raw"), F.concat(F.lit("Error: "), text, F.lit("\nCorrected: "), F.col("correct")), F.col("rule"), F.col("lang")))


def cross_language_pairs(parallel: DataFrame) -> DataFrame:
    """parallel (set_id, lang, raw, correct): each ordered pair of a set's languages."""
    a = parallel.select("set_id", F.col("lang").alias("source"), F.col("raw"))
    b = parallel.select("set_id", F.col("lang").alias("target"), F.col("correct"))
    rows = a.join(b, "set_id").filter("source <> target")
    task = F.concat(F.lit("Apply "), language_name(F.col("target"), ""), F.lit(" typography conventions to this text, which was originally typeset for "), language_name(F.col("source"), ""), F.lit(f". {ONLY}"))
    none = F.lit(None).cast("string")
    return rows.select(*_pair("cross_language", task, F.col("raw"), F.col("correct"), none, none, None, F.col("source"), F.col("target")))


def explanation_pairs(templates: DataFrame, explanations: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The first two rows of each (rule, lang) that is explained, with further columns of theirs."""
    first = Window.partitionBy("rule", "lang").orderBy("idx")
    rank = F.row_number().over(first)
    # the last index of each two is found without the texts, so that only texts up to it are moved and sorted
    two = templates.select("rule", "lang", "idx").join(explanations.select("rule", "lang"), ["rule", "lang"]).withColumn("rn", rank).filter("rn <= 2")
    last = two.groupBy("rule", "lang").agg(F.max("idx").alias("__last"))
    few = templates.join(F.broadcast(last), ["rule", "lang"]).filter("idx is null or idx <= __last").drop("__last")
    rows = few.join(explanations, ["rule", "lang"]).withColumn("rn", rank).filter("rn <= 2")
    label = F.coalesce(language_name(F.col("lang"), ""), F.col("lang"))
    label = F.when(label == "", F.col("lang")).otherwise(label)
    return rows.select(*_pair("explanation", F.concat(F.lit("Explain why this typographic correction is needed in "), label, F.lit(".")), F.concat(F.lit("Original: "), F.col("raw"), F.lit("\nCorrected: "), F.col("correct")), F.col("explanation"), F.col("rule"), F.col("lang")), *keep)


def counts(pairs: DataFrame) -> DataFrame:
    """(dimension, value, n): by type, by language (the target's, or multi) and by rule."""
    m = F.col("metadata")
    keys = F.array(
        F.struct(F.lit("type").alias("dimension"), m["type"].alias("value")),
        F.struct(F.lit("language").alias("dimension"), F.coalesce(m["language"], m["target_language"], F.lit("multi")).alias("value")),
        F.struct(F.lit("rule").alias("dimension"), F.coalesce(m["rule"], F.lit("cross_language")).alias("value")),
    )
    return pairs.select(F.explode(keys).alias("k")).groupBy("k.dimension", "k.value").agg(F.count("*").alias("n"))


def shuffled(pairs: DataFrame, seed: int = 42) -> DataFrame:
    return pairs.orderBy(F.xxhash64(F.lit(seed), "instruction", "input", "output"))


# validation


def _blank(c: Column) -> Column:
    return evaluation.stripped(c) == ""


def issues(records: DataFrame) -> DataFrame:
    """(lineno, issue) of records (lineno, instruction, input, output, metadata); a record without a required field has only that issue."""
    m = F.col("metadata")
    required = ("instruction", "input", "output")
    lacking = [F.when(F.col(f).isNull(), F.lit(f"missing_{f}")) for f in required]
    escape = r"\\u[0-9a-fA-F]{4}"
    cross = m["type"] == "cross_language"
    later = [
        *(F.when(_blank(F.col(f)), F.lit(f"empty_{f}")) for f in ("instruction", "output")),
        *(F.when(F.col(f).rlike(escape), F.lit(f"escaped_{f}")) for f in required),
        F.when(m.isNull(), F.lit("no_metadata")),
        F.when(m.isNotNull() & m["type"].isNull(), F.lit("no_type")),
        F.when(cross & (m["source_language"].isNull() | m["target_language"].isNull()), F.lit("no_language_pair")),
        F.when(m["type"].isNotNull() & ~cross & (m["language"].isNull() | m["rule"].isNull()), F.lit("no_language_or_rule")),
        F.when((m["type"] == "correction") & (F.col("input") == F.col("output")) & (F.col("input") != ""), F.lit("no_signal")),
    ]
    found = F.filter(F.array(*lacking), lambda x: x.isNotNull())
    rest = F.filter(F.array(*later), lambda x: x.isNotNull())
    return records.select("lineno", F.explode(F.when(F.size(found) > 0, found).otherwise(rest)).alias("issue"))


def duplicates(records: DataFrame) -> DataFrame:
    """(lineno, first_lineno) of each record that repeats an earlier one; records are compared by 128 bits of hash, so that texts aren't shuffled."""
    fields = [F.struct(F.col(c).isNull(), F.col(c)) for c in ("instruction", "input", "output")]
    hashed = records.select("lineno", F.xxhash64(*fields).alias("h"), F.xxhash64(F.lit(1), *fields).alias("h2"))
    first = hashed.groupBy("h", "h2").agg(F.min("lineno").alias("first_lineno"), F.count("*").alias("n")).filter("n > 1")
    return hashed.join(first, ["h", "h2"]).filter("lineno > first_lineno").select("lineno", "first_lineno")


def top(records: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values; ties keep the order of their first lines."""
    return records.groupBy(column).agg(F.count("*").alias("n"), F.min("lineno").alias("first_lineno")).orderBy(F.desc("n"), "first_lineno").limit(k)


def languages(records: DataFrame) -> DataFrame:
    """Both languages of a cross-language pair count."""
    m = F.col("metadata")
    both = F.when(m["type"] == "cross_language", F.array(m["source_language"], m["target_language"])).otherwise(F.array(m["language"]))
    return records.select(F.explode(both).alias("language")).filter("language is not null").groupBy("language").agg(F.count("*").alias("n"))


def verdict(records: DataFrame) -> DataFrame:
    """(records, issues, repeats, instructions, clean): a set is clean without an issue or a repeated record, and with more than one instruction."""
    n = records.agg(F.count("*").alias("records"), F.count_distinct("instruction").alias("instructions"))
    found = issues(records).agg(F.count("*").alias("issues")).crossJoin(duplicates(records).agg(F.count("*").alias("repeats")))
    # each side is one row
    return n.crossJoin(found).select("records", "issues", "repeats", "instructions", ((F.col("issues") == 0) & (F.col("repeats") == 0) & (F.col("instructions") > 1)).alias("clean"))


def shown_language(metadata: Column) -> Column:
    """The target's language of a cross-language pair, else the pair's."""
    return F.coalesce(F.when(metadata["type"] == "cross_language", metadata["target_language"]).otherwise(metadata["language"]), F.lit("_universal"))


def shown_rule(metadata: Column) -> Column:
    return F.when(metadata["type"] == "cross_language", F.lit("cross_language")).otherwise(F.coalesce(metadata["rule"], F.lit("unknown")))


def shown_order(records: DataFrame) -> DataFrame:
    """records with lang, rule and type, in the order of a page of pairs: by language in a fixed order, unknown ones last, rule and type."""
    m = F.col("metadata")
    own = records.withColumns({"lang": shown_language(m), "rule": shown_rule(m), "type": m["type"]})
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("lang"))
    return own.orderBy(F.when(place == 0, 99).otherwise(place), "rule", "type")


# lengths


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def length_stats(lengths: DataFrame, column: str) -> DataFrame:
    """count, min, mean, median, p95, p99, max; percentiles are the value at rank floor(n q) from 0.

    Lengths are counted by value first, so that ranks come from a running sum over distinct lengths.
    """
    by = lengths.groupBy(column).agg(F.count("*").alias("c"))
    upto = Window.orderBy(column)
    ranked = by.withColumn("hi", F.sum("c").over(upto)).crossJoin(F.broadcast(by.agg(F.sum("c").alias("n"))))
    at = lambda r: F.min(F.when(F.col("hi") > r, F.col(column)))
    n = F.col("n")
    return ranked.agg(
        F.max("n").alias("n"),
        F.min(column).alias("min_len"),
        F.round(F.sum(F.col(column) * F.col("c")) / F.max("n"), 4).alias("mean_len"),
        ((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2).alias("median_len"),
        at(F.floor(n * 0.95)).alias("p95"),
        at(F.floor(n * 0.99)).alias("p99"),
        F.max(column).alias("max_len"),
    )


def recommended(p99: Column) -> Column:
    """The least power of two at or above 1.1 x p99."""
    want = F.floor(p99 * F.lit(1.1))
    return F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: F.pow(F.lit(2), i).cast("long")), lambda x: x >= want), 1)


def buckets(lengths: DataFrame, column: str) -> DataFrame:
    """(bucket, n, pct): cumulative counts of lengths up to 32 .. 2048."""
    sizes = [32, 64, 128, 256, 512, 1024, 2048]
    one = lengths.agg(F.count("*").alias("total"), *(F.sum((F.col(column) <= b).cast("long")).alias(f"b{b}") for b in sizes))
    rows = F.array(*(F.struct(F.lit(b).alias("bucket"), F.col(f"b{b}").alias("n")) for b in sizes))
    return one.select("total", F.explode(rows).alias("r")).select("r.bucket", "r.n", F.round(F.col("r.n") * 100 / F.col("total"), 1).alias("pct"))


def chat_messages(task: Column, text: Column, output: Column) -> Column:
    user = F.when(F.coalesce(text, F.lit("")) == "", task).otherwise(F.concat(task, F.lit("\n\n"), text))
    return F.array(F.struct(F.lit("user").alias("role"), user.alias("content")), F.struct(F.lit("assistant").alias("role"), output.alias("content")))


def trainable(records: DataFrame) -> DataFrame:
    """Corrections and cross-language pairs, without metadata."""
    return records.filter(F.coalesce(F.col("metadata.type"), F.lit("correction")).isin("correction", "cross_language")).drop("metadata")


# sampling


def sample_key(seed: int = 42) -> Column:
    return F.xxhash64(F.lit(seed), "id")


def split(records: DataFrame, key: Column, tie: Column, ratio: float = 0.1) -> DataFrame:
    """records (language, rule, ..) with split: of a group of under 3 the first is for validation, else max(1, round(ratio n)); the order is that of key, a number under 2^32, then of tie.

    Groups are few and large: each is cut to ranges of its keys, whose counts tell how many of a range are for validation, so that no task orders a whole group.
    """
    names = {"__l": F.coalesce("language", F.lit("_unknown")), "__u": F.coalesce("rule", F.lit("_unknown")), "__b": F.shiftright(key.cast("long"), 20), "__k": key, "__t": tie}
    cut = records.withColumns(names)
    group = Window.partitionBy("__l", "__u")
    sizes = cut.groupBy("__l", "__u", "__b").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(group.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumns({"__before": before, "__all": F.sum("__n").over(group)})
    valid = F.when(F.col("__all") < 3, F.lit(1)).otherwise(F.greatest(F.lit(1), F.bround(F.col("__all") * F.lit(ratio)).cast("int")))
    sizes = sizes.select("__l", "__u", "__b", (valid - F.col("__before")).alias("__q"))
    rank = F.row_number().over(Window.partitionBy("__l", "__u", "__b").orderBy("__k", "__t"))
    done = cut.join(sizes, ["__l", "__u", "__b"]).withColumn("__r", rank)
    return done.withColumn("split", F.when(F.col("__r") <= F.col("__q"), "valid").otherwise("train")).drop(*names, "__q", "__r")


def stratified(records: DataFrame, key: Column) -> DataFrame:
    """records (lang, rule, type, ..) sampled by (lang, rule): 5 of a first-tier language, 3 of others, shared among the types in their order; what a type can't use isn't passed on."""
    place = F.array_position(F.array(*map(F.lit, TYPES)), F.col("type"))
    budget_of = F.when(F.col("lang").isin(*TIER_1), 5).otherwise(3)
    sizes = records.filter(F.col("type").isin(*TYPES) & F.col("lang").isin(*ORDER)).groupBy("lang", "rule", "type").agg(F.count("*").alias("have"))
    group = Window.partitionBy("lang", "rule")
    sizes = sizes.withColumns({"budget": F.least(budget_of, F.sum("have").over(group)), "types": F.count("*").over(group), "place": place})
    want = F.least(F.greatest(F.lit(1), F.floor(F.col("budget") / F.col("types"))), F.col("have"))
    before = group.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("want", want).withColumn("taken", F.coalesce(F.sum("want").over(before), F.lit(0)))
    quota = sizes.select("lang", "rule", "type", F.greatest(F.lit(0), F.least("want", F.col("budget") - F.col("taken"))).alias("quota"))
    rank = F.row_number().over(Window.partitionBy("lang", "rule", "type").orderBy(key))
    return records.withColumn("__r", rank).join(quota, ["lang", "rule", "type"]).filter("__r <= quota").drop("__r", "quota")


def capped(sample: DataFrame, key: Column, most: int = 200) -> DataFrame:
    """sample cut to ``most`` by language in proportion, at least two a language, while the budget lasts in the languages' order."""
    position = F.array_position(F.array(*map(F.lit, ORDER)), F.col("lang"))
    per = sample.groupBy("lang").agg(F.count("*").alias("have")).withColumn("place", position)
    every = Window.partitionBy()
    per = per.withColumns({"total": F.sum("have").over(every), "langs": F.count("*").over(every)})
    share = F.greatest(F.least(F.lit(2), F.floor(F.lit(most) / F.col("langs"))), F.bround(F.col("have") / F.col("total") * most).cast("long"))
    per = per.withColumn("share", F.least(share, F.col("have")))
    upto = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("taken", F.coalesce(F.sum("share").over(upto), F.lit(0)))
    share = F.when(F.col("total") <= most, F.col("have")).otherwise(F.greatest(F.lit(0), F.least("share", F.lit(most) - F.col("taken"))))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(key))
    return sample.withColumn("__r", rank).join(F.broadcast(per.select("lang", share.alias("__share"))), "lang").filter("__r <= __share").drop("__r", "__share")


def resolve(values: DataFrame, parents: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (rule, lang, register) with the value of the register, else the language, its parent, or all.

    values (layer, name, rule, value): layer is register, language or universal.
    """
    layer = lambda kind, name, out: values.filter(F.col("layer") == kind).select("rule", F.col("name").alias(name), F.col("value").alias(out))
    out = wanted.join(parents, "lang", "left").join(layer("register", "register", "r"), ["rule", "register"], "left").join(layer("language", "lang", "l"), ["rule", "lang"], "left").join(layer("language", "parent", "p"), ["rule", "parent"], "left")
    out = out.join(values.filter("layer = 'universal'").select("rule", F.col("value").alias("u")), "rule", "left")
    return out.select("rule", "lang", "register", F.coalesce("r", "l", "p", "u").alias("value"), F.when(F.col("r").isNotNull(), "register").when(F.col("l").isNotNull(), "language").when(F.col("p").isNotNull(), "parent").when(F.col("u").isNotNull(), "universal").alias("layer"))


def orphans(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Names on the left that the right doesn't know."""
    return left.select(on).distinct().join(right.select(on), on, "left_anti")
