"""Tables written to the shared checkpoint folder, to cut lineage between the steps of an operator."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset a temporary one if all runs on one machine, else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        where = _own.setdefault("folder", tempfile.mkdtemp(prefix="glyphmill-") if "folder" not in _own else "")
    return where.rstrip("/")


_own: dict[str, str] = {}


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few megabytes, so that long texts don't fill the Python workers' memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


class Scratch:
    """Parquet tables of one run of an operator.

    ``put`` writes a DataFrame and returns it as read again, so that neither a lost executor nor a
    second use computes it anew. ``drop`` removes a table that no later step reads. What the returned
    DataFrame reads has to outlive the operator and is removed when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark, self.at, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        atexit.register(self._delete, self.at)

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone already: its folder goes with it
            pass

    def put(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.at}/{self.n}"
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.parquet(path)
        read = self.spark.read.schema(df.schema).parquet(path)
        read._scratch = (self, path)
        return read

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._scratch[1])

    def collect_garbage(self) -> None:
        """Lets the driver forget finished shuffles, whose files otherwise stay for the whole run."""
        self.spark._jvm.System.gc()


def empty(spark: SparkSession, schema: str | StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
