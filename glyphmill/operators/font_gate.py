"""Font safety: what a font can't show, and what to show instead.

A mode is a set of supported code points; without one, tiers 1 and 2 count as supported. Fallbacks
depend on the mode alone, so they are resolved once, on the driver, over the few tracked characters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from glyphmill.functions import arrow, fonts

WEIGHTS = {1: 4, 2: 3, 3: 2, 4: 1}


class Gate:
    def __init__(self, supported: Iterable[int] | None = None):
        self.mode = "conservative" if supported is None else "explicit"
        self.supported = fonts.TIERS[1] | fonts.TIERS[2] if supported is None else frozenset(supported)
        self.given = supported is not None
        tracked = frozenset().union(*fonts.TIERS.values()) | fonts.CHAINS.keys()
        self.missing = sorted(tracked - self.supported)
        #: Replacement and reason of those that have one.
        self.fallbacks = {cp: f for cp in self.missing if (f := self.fallback(cp))}
        self.dropped = [cp for cp in self.missing if fonts.CHAINS.get(cp) == []]

    def fallback(self, cp: int) -> tuple[str, str] | None:
        """The first option of the chain that holds; an unsupported option is followed one step."""
        name = fonts.char_name
        for option in fonts.CHAINS.get(cp, ()):
            if isinstance(option, str):
                return option, f"multi-char fallback for {name(cp)}"
            if option in self.supported:
                return chr(option), f"{name(cp)} -> {name(option)}"
            for further in fonts.CHAINS.get(option, ()):
                if isinstance(further, str):
                    return further, f"{name(cp)} -> {name(option)} -> multi-char"
                if further in self.supported:
                    return chr(further), f"{name(cp)} -> {name(option)} -> {name(further)}"
        return None

    def process(self, text: Column) -> Column:
        """The text with fallbacks: one pass for single characters and drops, then those of several."""
        single = {chr(cp): r for cp, (r, _) in self.fallbacks.items() if len(r) == 1}
        out = F.translate(text, "".join(single) + "".join(map(chr, self.dropped)), "".join(single.values()))
        for cp, (r, _) in self.fallbacks.items():
            if len(r) > 1:
                out = F.replace(out, F.lit(chr(cp)), F.lit(r))
        return out

    def dimension(self, spark: SparkSession) -> DataFrame:
        """(ch, cp, name, tier, supported, replacement, reason, dropped) of each tracked character; a few hundred rows."""
        tracked = sorted(set().union(*fonts.TIERS.values()) | fonts.CHAINS.keys())
        rows = [(chr(cp), cp, fonts.NAMES.get(cp, ""), fonts.tier(cp), cp in self.supported, *(self.fallbacks.get(cp) or (None, None)), cp in self.dropped) for cp in tracked]
        return spark.createDataFrame(rows, "ch string, cp int, name string, tier int, supported boolean, replacement string, reason string, dropped boolean")

    def log(self, df: DataFrame, id_col: str, text: str) -> DataFrame:
        """(id, position, output_position, original, replacement, reason, warning) of each unsupported tracked character."""
        dim = F.broadcast(self.dimension(df.sparkSession).filter("not supported"))
        # only the characters that are missing leave the row, each with its place in the text as it will be
        missing = re.compile("[" + "".join(re.escape(chr(cp)) for cp in self.missing) + "]") if self.missing else re.compile("(?!)")
        grows = {chr(cp): -1 if cp in self.dropped else len(self.fallbacks[cp][0]) - 1 if cp in self.fallbacks else 0 for cp in self.missing}

        def hits(x: str | None) -> list[dict] | None:
            if x is None:
                return None
            out, shift = [], 0
            for m in missing.finditer(x):
                out.append({"position": m.start(), "output_position": m.start() + shift, "ch": m[0]})
                shift += grows[m[0]]
            return out

        kind = pa.list_(pa.struct([("position", pa.int32()), ("output_position", pa.int32()), ("ch", pa.string())]))
        returns = ArrayType(StructType([StructField("position", IntegerType()), StructField("output_position", IntegerType()), StructField("ch", StringType())]))
        chars = df.select(id_col, F.explode(arrow.mapped(hits, kind, returns, F.col(text), once=True)).alias("hit")).select(id_col, "hit.*")
        found = chars.join(dim, "ch")
        new = F.when(F.col("dropped"), F.lit("")).otherwise(F.coalesce("replacement", "ch"))
        warning = F.when(F.col("dropped"), F.format_string("Dropped unsupported invisible character %s at position %d", F.concat(F.lit("U+"), F.lpad(F.hex("cp"), 4, "0"), F.lit(" "), F.col("name")), F.col("position"))).when(
            F.col("replacement").isNull(), F.format_string("No fallback for unsupported character %s at position %d; left unchanged", F.concat(F.lit("U+"), F.lpad(F.hex("cp"), 4, "0"), F.lit(" "), F.col("name")), F.col("position"))
        )
        return found.select(id_col, "position", "output_position", F.col("ch").alias("original"), new.alias("replacement"), "reason", warning.alias("warning"))

    def report(self, df: DataFrame, by: list[str], text: str) -> DataFrame:
        """Tracked characters by group: tier, whether supported, occurrences and first place."""
        # only tracked characters leave the row, one for each kind in a text, counted in one pass
        tracked = frozenset(map(chr, set().union(*fonts.TIERS.values()) | fonts.CHAINS.keys()))

        def kinds(x: str | None) -> list[dict] | None:
            return None if x is None else [{"ch": c, "n": n, "at": x.index(c)} for c, n in Counter(x).items() if c in tracked]

        kind = pa.list_(pa.struct([("ch", pa.string()), ("n", pa.int64()), ("at", pa.int32())]))
        found = arrow.mapped(kinds, kind, ArrayType(StructType([StructField("ch", StringType()), StructField("n", LongType()), StructField("at", IntegerType())])), F.col(text), once=True)
        chars = df.select(*by, F.explode(found).alias("k")).select(*by, "k.*")
        counts = chars.groupBy(*by, "ch").agg(F.sum("n").alias("occurrences"), F.min("at").alias("first_position"))
        return counts.join(F.broadcast(self.dimension(df.sparkSession)), "ch").select(*by, "ch", "cp", "name", "tier", "supported", "replacement", "occurrences", "first_position")

    def coverage(self, spark: SparkSession) -> DataFrame:
        """(tier, total, supported, missing, coverage_pct) of a given set of code points."""
        if not self.given:
            raise ValueError("coverage needs the font's code points")
        dim = self.dimension(spark).filter("tier > 0")
        missing = F.sort_array(F.collect_list(F.when(~F.col("supported"), F.col("cp"))))
        return dim.groupBy("tier").agg(F.count("*").alias("total"), F.sum(F.col("supported").cast("long")).alias("supported"), missing.alias("missing")).withColumn("coverage_pct", F.round(F.col("supported") / F.col("total") * 100, 1))

    def readiness(self, spark: SparkSession) -> DataFrame:
        """(total, supported, overall_pct, readiness_pct): tiers weighted 4, 3, 2, 1."""
        weight = F.lit(5) - F.col("tier")
        return self.coverage(spark).agg(F.sum("total").alias("total"), F.sum("supported").alias("supported"), F.round(F.sum("supported") / F.sum("total") * 100, 1).alias("overall_pct"), F.round(F.sum(weight * F.col("supported") / F.col("total")) / F.sum(weight) * 100, 1).alias("readiness_pct"))


def tier_counts(text: Column) -> dict[str, Column]:
    """How many characters of each tier a text holds, without leaving the row."""
    return {f"tier_{t}": F.regexp_count(text, F.lit("[" + "".join(f"\\x{{{cp:x}}}" for cp in sorted(members)) + "]")).cast("long") for t, members in fonts.TIERS.items()}
