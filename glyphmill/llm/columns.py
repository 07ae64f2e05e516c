"""Names of columns: quoting any, and names for working columns that no table of the caller's has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def every(df: DataFrame) -> list[Column]:
    return [col(c) for c in df.columns]


#: A text's identity in 128 bits.
KEY = ["key", "key2"]


def keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("key"), F.xxhash64(F.lit(1), text).alias("key2")]


def one_key(docs: DataFrame, text: Column) -> Column:
    """A 64-bit key of each text that no other text of docs has: its first hash, or where several texts share that, some n^2 / 2^65 of n, a hash of both."""
    key, key2 = keys(text)
    shared = docs.select(key, key2).groupBy("key").agg(F.min("key2").alias("a"), F.max("key2").alias("b")).filter("a <> b").select("key").collect()
    if not shared:
        return key
    return F.when(key.isin([r[0] for r in shared]), F.xxhash64(key, key2)).otherwise(key)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out
