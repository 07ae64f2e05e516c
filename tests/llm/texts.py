"""Documents for the tests: prose of random words, and rows that are odd in every way."""

from __future__ import annotations

import random

VOCABULARY = [f"{a}{b}{c}" for a in "bdfgklmnprstvz" for b in "aeiou" for c in ("n", "r", "st", "ll", "mp", "k")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names operators might use themselves.
EXTRA = ("key", "band", "n", "h", "pos", "id", "v", "grp", "__key", "__weight", "__rank", "__new", "__text", "__cuts", "__keeper", "__first", "root", "level", "log_weight", "good", "a.b")


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def rows(texts: dict) -> list[tuple]:
    return [(i, t, "en", "web", None if t is None else len(t)) for i, t in texts.items()]


def odd_rows() -> list[tuple]:
    """Null ids and texts, blanks, repeated rows, ties, one very long text and one without a space."""
    long, same = prose(1, 60_000), prose(2, 120)
    texts = [(1, None), (None, None), (2, ""), (3, " \n\t "), (4, same), (4, same), (5, same), (None, same), (6, long), (7, "x" * 50_000), (8, "one"), (9, "é ß 你好 " * 40), (None, "lone text without an id " * 3)]
    return [(i, t, None if i == 5 else "en", None, None if t is None else len(t)) for i, t in texts]


def frame(spark, given: list[tuple], extra: bool = False):
    df = spark.createDataFrame(given, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit(f"own {c}").alias(c) for c in EXTRA])
    return df
