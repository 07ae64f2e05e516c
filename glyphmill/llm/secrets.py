"""Secret scan: Shannon entropy of sliding windows over candidate strings.

A candidate is a maximal run of at least ``WINDOW`` of the characters A-Z a-z 0-9 + / = _ -. Its class
is hex, alnum (letters and digits), base64 (with symbols too) or alpha, each with a threshold of its
own; runs of digits alone, or without a letter, are numbers and rules, and no candidates. The window
moves by one character at a time and changes two counts; sums of n log2 n are kept as integers,
so that no rounding gathers. A candidate with a window at its class's threshold is a secret, unless
the allow-list holds it. Of a candidate that is neither a secret nor allowed, the parts between its
symbols, and of those that aren't secrets the longest runs of hex digits, are candidates by
themselves, with the threshold of their own class, so that a secret that hangs on a name or a
separator is found.

Defined results: null, blank and short texts have none; repeated rows each give theirs; offsets count
characters. The secret itself is not returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from glyphmill.llm import columns as cs
from glyphmill.llm import textvec as tv
from glyphmill.llm.scratch import small_batches

WINDOW, UNIT = 20, 1 << 20
#: Bits a character.
THRESHOLDS = {"hex": 3.0, "alnum": 3.55, "base64": 3.85, "alpha": 4.15}
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"[A-Za-z]+([_/=-]+[A-Za-z]+)+",
    r".*(EXAMPLE|example|PLACEHOLDER|placeholder|XXXXX|xxxxx).*",
)
RUN = np.zeros(256, bool)
RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-")] = True
WEIGHTS = [0] + [round(c * np.log2(c) * UNIT) for c in range(1, WINDOW + 1)]
STEPS = [b - a for a, b in zip(WEIGHTS, WEIGHTS[1:], strict=False)]
PARTS = (re.compile(rb"[A-Za-z0-9]{%d,}" % WINDOW), re.compile(rb"[0-9a-fA-F]{%d,}" % WINDOW))
_hex, _alnum, _alpha, _letter, _digit = (re.compile(p) for p in (rb"[0-9a-fA-F]+", rb"[A-Za-z0-9]+", rb"[A-Za-z]+", rb"[A-Za-z]", rb"[0-9]"))
MARK = "[SECRET]"


def kind_of(run: bytes) -> str | None:
    if not _letter.search(run):
        return None
    if not _digit.search(run):
        return "alpha"
    return "hex" if _hex.fullmatch(run) else "alnum" if _alnum.fullmatch(run) else "base64"


def most(kind: str) -> int:
    """The greatest sum of n log2 n, x UNIT, of a window at the threshold."""
    return int((np.log2(WINDOW) - THRESHOLDS[kind]) * WINDOW * UNIT)


def least_sum(run: bytes) -> tuple[int, int]:
    """The least sum of n log2 n over a run's windows, and where the first such window begins."""
    counts = [0] * 256
    total = 0
    for c in run[:WINDOW]:
        total += STEPS[counts[c]]
        counts[c] += 1
    best, at = total, 0
    for i in range(WINDOW, len(run)):
        out, c = run[i - WINDOW], run[i]
        counts[out] -= 1
        total += STEPS[counts[c]] - STEPS[counts[out]] if c != out else 0
        if c == out:
            counts[c] += 1
            continue
        counts[c] += 1
        if total < best:
            best, at = total, i - WINDOW + 1
    return best, at


def millibits(total: int) -> int:
    """Entropy in thousandths of a bit, rounded down."""
    return int(np.floor((np.log2(WINDOW) - total / UNIT / WINDOW) * 1000))


def find(data: np.ndarray, allowed: re.Pattern) -> Iterator[tuple[int, int, str, int, int]]:
    """(start, end, class, least sum, window) of each secret, in bytes; no run crosses two texts if a byte that isn't in runs lies between."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = RUN[data]
    change = np.diff(inside)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    long = ends - starts >= WINDOW
    for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        yield from _in_run(data[s:e].tobytes(), s, allowed, PARTS)


def _in_run(run: bytes, s: int, allowed: re.Pattern, parts: tuple[re.Pattern, ...]) -> Iterator[tuple[int, int, str, int, int]]:
    """The run, which begins at ``s``, if it is a secret; else the secrets among its parts."""
    kind = kind_of(run)
    if not kind or allowed.fullmatch(run.decode()):
        return
    total, at = least_sum(run)
    if total <= most(kind):
        yield s, s + len(run), kind, total, at
        return
    for i, part in enumerate(parts):
        pieces = [m.span() for m in part.finditer(run)]
        if pieces and pieces != [(0, len(run))]:
            for a, b in pieces:
                yield from _in_run(run[a:b], s + a, allowed, parts[i + 1 :])
            return


def _pattern(allow: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(f"(?:{p})" for p in allow) or r"(?!)")


def _per_text(data: np.ndarray, offsets: np.ndarray, allowed: re.Pattern) -> Iterator[tuple[int, int, int, str, int, int]]:
    """As find, with the text each is in, within the text's bytes."""
    inside = RUN[data]
    # only texts with a long run are looked at one by one
    sums = np.concatenate([[0], np.cumsum(inside)])
    full = np.flatnonzero(sums[WINDOW:] - sums[:-WINDOW] == WINDOW) if len(data) >= WINDOW else np.zeros(0, np.int64)
    for i in np.unique(np.searchsorted(offsets, full, "right") - 1).tolist():
        for found in find(data[offsets[i] : offsets[i + 1]], allowed):
            yield (i, *found)


def _scan(id_col: str, allow: tuple[str, ...]):
    allowed = _pattern(allow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tv.chunks(batches, "text"):
            found = list(_per_text(data, offsets, allowed))
            if not found:
                continue
            which = pa.array([x[0] for x in found], pa.int64())
            # characters before each byte of the chunk, counted once however many secrets a text holds
            before = tv.code_points(data)
            text = np.array([x[0] for x in found])
            begin = before[offsets[text] + [x[1] for x in found]] - before[offsets[text]]
            spans = [(b, b + e - s, b + at) for b, (_, s, e, _, _, at) in zip(begin.tolist(), found, strict=True)]
            ids = rows.column(id_col).take(which)
            columns = [ids, *(pa.array([x[j] for x in spans], pa.int32()) for j in range(2)), pa.array([x[3] for x in found]), pa.array([x[2] for x in spans], pa.int32()), pa.array([millibits(x[4]) for x in found], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "start_char", "end_char", "kind", "window_char", "entropy_mbits"])

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", allow: tuple[str, ...] = ALLOWED) -> DataFrame:
    """(doc_id, start_char, end_char, kind, window_char, entropy_mbits) of each secret; the window is the first of the greatest entropy."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.filter(F.length(text) >= WINDOW).select(F.col(id_col), F.col(text).alias("text"))
    return source.mapInArrow(_scan(id_col, allow), f"`{id_col}` {kind}, start_char int, end_char int, kind string, window_char int, entropy_mbits int")


def redact(docs: DataFrame, text: str = "text", count: str | None = "n_chars", allow: tuple[str, ...] = ALLOWED) -> DataFrame:
    """docs with MARK in place of each secret; other texts, null ones too, stay as they are. ``count``, where there is such a column, is set anew for changed texts."""
    small_batches(docs.sparkSession)
    allowed = _pattern(allow)

    def pieces(column: pa.Array) -> pa.Array:
        """The changed text in a list of one; an empty list for an unchanged text."""
        data, offsets = tv.buffers(column)
        found: dict[int, list[tuple[int, int]]] = {}
        at = 0
        while at < len(column):  # a few megabytes at a time
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + tv.CHUNK, "right")) - 1)
            for i, s, e, *_ in _per_text(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], allowed):
                found.setdefault(at + i, []).append((s, e))
            at = to
        out: list[list[str]] = [[] for _ in range(len(column))]
        for i, spans in found.items():
            raw, at, parts = data[offsets[i] : offsets[i + 1]].tobytes(), 0, []
            for s, e in spans:
                parts += [raw[at:s], MARK.encode()]
                at = e
            out[i] = [(b"".join(parts) + raw[at:]).decode()]
        return pa.array(out, pa.list_(pa.string()))

    (new,) = cs.free(docs, "__new")
    marked = docs.withColumn(new, F.arrow_udf(pieces, ArrayType(StringType()))(F.col(text)))
    changed, after = F.size(new) > 0, F.element_at(new, 1)
    columns = {text: F.when(changed, after).otherwise(F.col(text))}
    if count and count in docs.columns:
        columns[count] = F.when(changed, F.length(after).cast(docs.schema[count].dataType)).otherwise(F.col(count))
    return marked.withColumns(columns).select(*cs.every(docs))
