"""Files as DataFrames. Lines are numbered within their file, from 1, as an editor does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

PAIR = "instruction string, input string, output string, metadata struct<type:string,rule:string,language:string,register:string,source_language:string,target_language:string>"


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): a file is one value."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def jsonl(spark: SparkSession, path: str, schema: str | StructType = PAIR) -> DataFrame:
    """Tolerant: blank and broken lines are left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, lineno, line). A line's place among its block's is carried through the scan; blocks are numbered by where they begin, so that no file needs to be in one task's memory."""
    read = spark.read.text(path).select("*", F.input_file_name().alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    within = Window.partitionBy("path", "block").orderBy("at")
    numbered = read.withColumn("nth", F.row_number().over(within))
    sizes = read.groupBy("path", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return numbered.join(offsets, ["path", "block"]).select("path", (F.col("before") + F.col("nth")).alias("lineno"), F.col("value").alias("line"))


def audited_jsonl(spark: SparkSession, path: str, schema: str = PAIR) -> DataFrame:
    """(path, lineno, error, fields..): blank lines are left out; a broken one has an error and null fields."""
    lines = _lines(spark, path).filter(F.trim("line") != "")
    parsed = lines.withColumn("r", F.from_json("line", f"{schema}, __broken string", {"columnNameOfCorruptRecord": "__broken"}))
    broken = F.col("r.__broken").isNotNull() | F.col("r").isNull()
    names = [f.name for f in StructType.fromDDL(schema)] if isinstance(schema, str) else schema.names
    return parsed.select("path", "lineno", F.when(broken, F.concat(F.lit("not a JSON object: "), F.left("line", F.lit(60)))).alias("error"), *[F.when(~broken, F.col("r")[n]).alias(n) for n in names])


def strict_jsonl(spark: SparkSession, path: str, schema: str = PAIR) -> DataFrame:
    """(id, fields..): id counts lines from 0; a broken line ends the query."""
    rows = audited_jsonl(spark, path, schema)
    checked = F.when(F.col("error").isNull(), F.col("lineno") - 1).otherwise(F.raise_error(F.concat(F.lit("line "), F.col("lineno"), F.lit(": "), F.col("error"))).cast("long"))
    return rows.select(checked.alias("id"), *[c for c in rows.columns if c not in ("path", "lineno", "error")])


def saved_run(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a saved evaluation, with its label; the path where it has none."""
    df = spark.read.json(path, multiLine=True)
    label = F.col("label") if "label" in df.columns else F.lit(None).cast("string")
    return df.select(F.coalesce(label, F.input_file_name()).alias("label"), F.posexplode("cases").alias("case_id", "c")).select("label", "case_id", "c.*")


def write_run(scored: DataFrame, path: str, label: str, timestamp: str) -> None:
    """A full score as one JSON file, as saved_run reads it: label, time, total, exact matches, regressions, mean similarity, and the cases, which pass through one task line by line."""
    totals = scored.agg(F.count("*").alias("total"), F.sum(F.col("exact_match").cast("long")).alias("exact_matches"), F.sum(F.col("regression").cast("long")).alias("regressions"), F.round(F.avg("similarity_score"), 4).alias("avg_similarity"))
    head = F.to_json(F.struct(F.lit(label).alias("label"), F.lit(timestamp).alias("timestamp"), *[F.coalesce(c, F.lit(0)).alias(c) for c in totals.columns]))
    first = totals.select(F.lit(0).alias("part"), F.lit(None).cast("string").alias("at"), F.concat(F.regexp_replace(head, r"\}\z", ""), F.lit(', "cases": [')).alias("value"))
    order = F.lpad(F.col("case_id").cast("string"), 20, "0") if "case_id" in scored.columns else F.lit("")
    each = scored.select(F.lit(1).alias("part"), order.alias("at"), F.concat(F.to_json(F.struct(*scored.columns)), F.lit(",")).alias("value"))
    # an empty object after the last comma would be a case: the list ends with the case of the greatest number
    last = each.agg(F.max("at")).first()[0]
    each = each.withColumn("value", F.when(F.col("at") == F.lit(last), F.regexp_replace("value", r",\z", "")).otherwise(F.col("value")))
    end = scored.sparkSession.createDataFrame([(2, None, "]}")], "part int, at string, value string")
    first.unionByName(each).unionByName(end).repartitionByRange(1, "part").sortWithinPartitions("part", "at").select("value").write.text(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line; characters other than ASCII as they are."""
    df.write.json(path)


def lint_json(text: Column, corrections: Column, lang: Column) -> Column:
    """The integration contract: a linting result with its statistics as one JSON text."""
    by_rule = F.aggregate(
        F.array_distinct(F.transform(corrections, lambda c: c["rule"])),
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")),
        lambda m, r: F.map_concat(m, F.create_map(r, F.size(F.filter(corrections, lambda c: c["rule"] == r)))),
    )
    stats = F.struct(F.size(corrections).alias("total"), by_rule.alias("by_rule"))
    return F.to_json(F.struct(text.alias("text"), lang.alias("language"), corrections.alias("corrections"), stats.alias("stats")))
