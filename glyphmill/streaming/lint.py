"""The same linting plan over a stream: it is a map of rows, so that it needs no state; the counts are a windowed aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glyphmill.plans import lint


def arriving(spark: SparkSession, folder: str, schema: str | StructType, files: int = 100) -> DataFrame:
    """Rows of new Parquet files in a folder, at most ``files`` of them at a time."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return reader.parquet(folder)


def corrected(stream: DataFrame, text: str = "text", lang: str = "lang", langs: list[str] | None = None) -> DataFrame:
    """The stream with the corrected text; where there is none, the text as it came."""
    return lint.lint_text(stream, text, lang, langs=langs).withColumn("corrected", F.coalesce("corrected", F.col(text)))


def rule_counts(stream: DataFrame, time: str, late: str = "10 minutes", every: str = "1 minute", text: str = "text", lang: str = "lang") -> DataFrame:
    """Corrections by window of event time, language and rule; rows that are later than ``late`` are left out."""
    logged = lint.lint_log(stream.withWatermark(time, late), text, lang)
    each = logged.select(F.window(time, every).alias("window"), F.col(lang).alias("lang"), F.explode("lint.corrections").alias("c"))
    return each.groupBy("window", "lang", F.col("c.rule").alias("rule")).agg(F.count("*").alias("n"))


def run(stream: DataFrame, out: str, checkpoint: str, mode: str = "append"):
    """Starts writing to a Parquet folder with all that is there now; the checkpoint makes a restart go on exactly where it ended."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
