"""Regions of a text that no rule may touch: found, taken out behind placeholders, and put back.

Of overlapping regions the one that begins first stays, of those that begin together the longest;
this isn't what one alternation would find, hence the Arrow functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from glyphmill.functions import arrow

_NAME = r"[a-zA-Z0-9_.\-]+"
_TAGS = "|".join("tt var samp kbd pre code".split())
PATTERNS: dict[str, re.Pattern] = {
    "fenced_code": re.compile(r"`{3}(?s:.*?)`{3}"),
    "html_code": re.compile(rf"<(?:{_TAGS})(?:\s[^>]*)?>(?s:.*?)</(?:{_TAGS})>", re.I),
    "html_tag": re.compile(r"<(?:/[a-zA-Z]|[a-zA-Z])[^<>]*>"),
    "inline_code": re.compile(r"`[^\n`]+`"),
    "email": re.compile(r"[-a-zA-Z0-9._%+]+@[-a-zA-Z0-9.]+\.[a-zA-Z]{2,}"),
    "url": re.compile(r"(?:ftp|https|http)://[^<>)\]\s]+", re.A),
    "filepath_unix": re.compile(rf"(?<!\w)(?:/{_NAME}){{2,}}"),
    "filepath_win": re.compile(rf"[A-Z]:\\(?:{_NAME}\\?)+", re.A),
    "version": re.compile(r"\bv\d+(?:\.\d+)+(?:-[.a-zA-Z0-9]+)?\b", re.I),
    "mention": re.compile(r"@[_a-zA-Z0-9]+"),
    "hashtag": re.compile(r"#[a-zA-Z][_a-zA-Z0-9]*"),
    "camelcase": re.compile(r"\b(?:[a-z]+(?:[A-Z][a-z]+){2,}|(?:[A-Z][a-z]+){2,})\b"),
    "snakecase": re.compile(r"\b[a-zA-Z][a-zA-Z0-9]*(?:_[a-zA-Z0-9]+)+\b"),
    "regex": re.compile(r"(?<!\w)/(?:\\.|[^\n/\\])+/[gimsuy]*(?!\w)"),
}
#: Some character of it is in every region, or a word with a capital inside.
SIGNS = r"[`<@/\\#_]|[vV]\p{Nd}|[a-z][A-Z]"
SPAN = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("original", StringType())])
MASKED = StructType([StructField("text", StringType()), StructField("taken", ArrayType(StringType()))])


#: What a region of a kind begins with. The other kinds hold no space: they are looked for between the spaces round a sign.
_OPENS = {"fenced_code": "```", "html_code": "<", "html_tag": "<", "inline_code": "`", "filepath_unix": "/", "mention": "@", "hashtag": "#", "regex": "/"}
_HOLDS = {"email": re.compile("@"), "url": re.compile("://"), "filepath_win": re.compile(r":\\"), "version": re.compile(r"[vV](?=\d)"), "camelcase": re.compile("[A-Z](?<=[a-z].)"), "snakecase": re.compile("_")}


def _found(kind: str, text: str) -> Iterator[re.Match]:
    """As the pattern's finditer, which looks at every character, by search for what its matches hold."""
    pattern = PATTERNS[kind]
    if kind in _OPENS:
        at = text.find(_OPENS[kind])
        while at >= 0:
            m = pattern.match(text, at)
            if m:
                yield m
            at = text.find(_OPENS[kind], m.end() if m else at + 1)
        return
    upto = 0
    for sign in _HOLDS[kind].finditer(text):
        if sign.start() < upto:
            continue
        end = text.find(" ", sign.end())
        upto = end if end >= 0 else len(text)
        yield from pattern.finditer(text, text.rfind(" ", 0, sign.start()) + 1, upto)


def spans(text: str) -> list[tuple[str, int, int]]:
    found = sorted((m.start(), -m.end(), k, name) for k, name in enumerate(PATTERNS) for m in _found(name, text))
    out, upto = [], 0
    for start, end, _, name in found:
        if start >= upto:
            out.append((name, start, -end))
            upto = -end
    return out


def placeholder(i: int) -> str:
    return f"\0EXCL{i:04d}\0"


def mask(text: str) -> tuple[str, list[str]]:
    parts, taken, at = [], [], 0
    for _, start, end in spans(text):
        parts += [text[at:start], placeholder(len(taken))]
        taken.append(text[start:end])
        at = end
    return "".join(parts) + text[at:], taken


def unmask(text: str, taken: list[str]) -> str:
    if len(taken) > 8 and text.count("\0EXCL") == len(taken) and not any("\0" in x for x in taken):  # one pass
        return re.sub("\0EXCL(\\d{4,})\0", lambda m: taken[int(m[1])] if int(m[1]) < len(taken) else m[0], text)
    for i, original in enumerate(taken):
        text = text.replace(placeholder(i), original)
    return text


def _masked(x: str | None) -> dict | None:
    return None if x is None else dict(zip(("text", "taken"), mask(x), strict=True))


def _regions(x: str | None) -> list[dict] | None:
    return None if x is None else [{"kind": n, "start": s, "end": e, "original": x[s:e]} for n, s, e in spans(x)]


def masked(c: Column) -> Column:
    """struct(text, taken); Python only sees texts that may hold a region."""
    possible = F.when(c.rlike(SIGNS), c)
    plain = F.struct(c.alias("text"), F.array().cast("array<string>").alias("taken"))
    return F.coalesce(arrow.mapped(_masked, pa.struct([("text", pa.string()), ("taken", pa.list_(pa.string()))]), MASKED, possible), F.when(c.isNotNull(), plain))


def regions(c: Column) -> Column:
    """array of struct(kind, start, end, original)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("original", pa.string())]))
    return arrow.mapped(_regions, kind, ArrayType(SPAN), c, once=True)


def restored(text: Column, taken: Column) -> Column:
    """Placeholders are put back from the first on, without leaving the JVM."""
    mark = lambda i: F.concat(F.lit("\0EXCL"), F.lpad((i).cast("string"), F.greatest(F.lit(4), F.length(i.cast("string"))), F.lit("0")), F.lit("\0"))
    numbered = F.transform(taken, lambda x, i: F.struct(mark(i).alias("mark"), x.alias("original")))
    return F.aggregate(numbered, text, lambda s, x: F.replace(s, x["mark"], x["original"]))
