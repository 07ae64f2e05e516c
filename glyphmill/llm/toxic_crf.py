"""Toxic spans by a linear-chain conditional random field over words, with two states.

Documents are labelled, words are not: a word of a toxic document is labelled toxic where documents
with that word, or with one that begins like it, are toxic far more often than others (``_lexicon``).
The field is fitted by gradient steps on the likelihood of those labels over the whole texts of at most
``fit_rows`` labelled documents of each kind, those with the least hashes of their ids; its features are the word, its first 4 to 7 bytes, as insults are inflected and
compounded, and both neighbours, in lower case and without punctuation at the ends. All texts are
then tagged whole: forward and backward recursions run over blocks of ``BLOCK`` words at once, whose
transfer matrices are chained, and give the exact marginal of each word.

A document's evidence is the sum of the log odds of its words with a marginal of at least 1/2; its
score is the logistic function of the evidence, fitted on the same documents at the labels' natural
shares, so that one word that also occurs in clean texts is not enough, and several are. Spans are runs
of words with a marginal of at least 1/2.

Defined results: a document with a score under 1/2 isn't returned; null and blank texts have none;
repeated rows each give theirs; offsets count characters. Without labels of both kinds there is
nothing to fit and no result. A document with contradictory labels isn't fitted on; of one id's texts
the one with the least hash is.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import textvec as tv
from glyphmill.llm.scratch import small_batches

FIT_ROWS, BLOCK, RARE, ROUNDS = 3000, 64, 10, 60
PREFIXES = (4, 5, 6, 7)
PUNCT = np.zeros(256, bool)
PUNCT[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


def word_codes(w: tv.Words) -> list[np.ndarray]:
    """Hashes of the words and of their beginnings of PREFIXES bytes; 0 for words that aren't longer."""
    s, e = w.stripped(PUNCT)
    hasher = tv.Hasher(tv.LOWER[w.data])
    return [hasher.of(s, e), *(np.where(e - s > k, hasher.of(s, np.minimum(e, s + k)), np.uint64(0)) for k in PREFIXES)]


class Table:
    """Weights by 64-bit feature; features whose hashes begin alike lie one after the other."""

    def __init__(self, features: np.ndarray, weights: np.ndarray):
        self.bits = np.uint64(64 - max(8, int(4 * len(features)).bit_length()))
        order = np.argsort(features)
        self.features, self.weights = np.append(features[order], np.uint64(0)), np.append(weights[order], 0.0)
        slot = (self.features[:-1] >> self.bits).astype(np.int64)
        count = np.bincount(slot, minlength=1 << (64 - int(self.bits)))
        self.first, self.count = (np.cumsum(count) - count).astype(np.int32), count.astype(np.int32)

    def of(self, features: np.ndarray) -> np.ndarray:
        slot = (features >> self.bits).astype(np.int64)
        at, left = self.first[slot], self.count[slot]
        out, rest = np.zeros(len(features)), np.flatnonzero(left)
        while len(rest):
            hit = self.features[at[rest]] == features[rest]
            out[rest[hit]] = self.weights[at[rest[hit]]]
            rest = rest[~hit & (left[rest] > 1)]
            at[rest] += 1
            left[rest] -= 1
        return out


def shifted(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words before and after each word of its text, 0 where there is none."""
    before, after = np.roll(h, 1), np.roll(h, -1)
    some = last > first
    before[first[some]] = 0
    after[last[some] - 1] = 0
    return before, after


def marginals(odds: np.ndarray, first: np.ndarray, count: np.ndarray, move: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Probability of state 1 at each place of several chains laid end to end."""
    return expected(odds, first, count, move, block)[0]


def expected(odds: np.ndarray, first: np.ndarray, count: np.ndarray, move: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Those probabilities, and the expected number of moves from each state to each: the gradient of the log of all labellings' potentials.

    odds: state 1's emission over state 0's. move[a, b]: potential of going from a to b. Chains begin
    with even potentials. Blocks' 2 x 2 products carry the recursions over long chains.
    """
    if not len(odds):
        return np.zeros(0), np.zeros((2, 2))
    (a, b), (c, d) = move
    blocks = -(-count // block)
    n = int(blocks.sum())
    chain = np.repeat(np.arange(len(count)), blocks)
    nth = tv.spread(np.zeros(len(count), np.int64), blocks)
    begin = first[chain] + nth * block
    size = np.minimum(block, first[chain] + count[chain] - begin)
    place = begin + np.arange(block)[:, None]
    real = np.arange(block)[:, None] < size
    e = np.where(real, odds[np.minimum(place, len(odds) - 1)], 1.0)
    opens = nth == 0
    p00, p01, p10, p11 = np.ones(n), np.zeros(n), np.zeros(n), np.ones(n)
    for t in range(block):
        x = e[t]
        if t == 0:  # a chain's first word is not moved to
            q = [np.where(opens, v, w) for v, w in ((1.0, a), (0.0, b * x), (0.0, c), (1.0 * x, d * x))]
        else:
            q = [np.where(real[t], v, w) for v, w in ((a, 1.0), (b * x, 0.0), (c, 0.0), (d * x, 1.0))]
        p00, p01, p10, p11 = p00 * q[0] + p01 * q[2], p00 * q[1] + p01 * q[3], p10 * q[0] + p11 * q[2], p10 * q[1] + p11 * q[3]
        if t % 8 == 7:
            top = np.maximum(np.maximum(p00, p01), np.maximum(p10, p11))
            p00, p01, p10, p11 = p00 / top, p01 / top, p10 / top, p11 / top
    enter, leave = np.ones(n), np.ones(n)  # state 1 over state 0 before the block, and of what follows it
    starts = np.cumsum(blocks) - blocks
    order = np.argsort(-blocks, kind="stable")
    sizes = blocks[order]
    for k in range(1, int(blocks.max(initial=0))):
        i = starts[order[: np.searchsorted(-sizes, -k)]] + k
        r = enter[i - 1]
        enter[i] = (p01[i - 1] + r * p11[i - 1]) / (p00[i - 1] + r * p10[i - 1])
    for k in range(int(blocks.max(initial=0)) - 2, -1, -1):
        i = starts[order[: np.searchsorted(-sizes, -(k + 1))]] + k
        r = leave[i + 1]
        leave[i] = (p10[i + 1] + p11[i + 1] * r) / (p00[i + 1] + p01[i + 1] * r)
    forth = np.empty((block, n))
    r = enter
    for t in range(block):
        r = np.where(real[t], np.where(opens & (t == 0), e[t], e[t] * (b + d * r) / (a + c * r)), r)
        forth[t] = r
    out, moves = np.zeros(len(odds)), np.zeros((2, 2))
    r = leave
    for t in range(block - 1, -1, -1):
        both = forth[t] * r
        keep = real[t]
        out[place[t][keep]] = (both / (1 + both))[keep]
        inner = keep & ~opens if t == 0 else keep  # a chain's first word is not moved to
        before, after = (enter if t == 0 else forth[t - 1])[inner], (e[t] * r)[inner]
        ways = np.stack([np.full(len(before), a), b * after, c * before, d * before * after])
        moves += (ways / ways.sum(0)).sum(1).reshape(2, 2)
        r = np.where(keep, (c + d * e[t] * r) / (a + b * e[t] * r), r)
    return out, moves


class Field:
    """The fitted field: tables of weights of the word, its beginnings and neighbours, a bias and log potentials of moves; the line from evidence to a document's log odds."""

    def __init__(self, tables: list[Table], bias: float, move: np.ndarray):
        self.tables, self.bias, self.move = tables, bias, np.exp(move)
        self.slope, self.base = 1.0, 0.0

    def words(self, forms: list[np.ndarray], first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Marginals of words by the hashes of their forms."""
        score = np.full(len(forms[0]), self.bias)
        for table, features in zip(self.tables, [*forms, *shifted(forms[0], first, first + count)], strict=True):
            score += table.of(features)
        return marginals(np.exp(np.clip(score, -30, 30)), first, count, self.move)

    def tag(self, w: tv.Words) -> np.ndarray:
        return self.words(word_codes(w), w.first, w.count)

    def documents(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.base + self.slope * evidence, -30, 30)))

    def calibrate(self, evidence: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> None:
        """Logistic regression by Newton's method, with a weak pull to evidence as it is."""
        x = np.stack([np.minimum(evidence, 30), np.ones_like(evidence)], 1)
        v, pull = np.array([1.0, 0.0]), np.diag([1.0, 0.1])
        for _ in range(30):
            q = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
            g = x.T @ (weight * (toxic - q)) - pull @ (v - [1.0, 0.0])
            v = v + np.clip(np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + pull, g), -2, 2)
        self.slope, self.base = max(float(v[0]), 0.05), float(v[1])


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.minimum(p, 1 - 1e-6)
    return np.log(p / (1 - p))


def _lexicon(words: np.ndarray, toxic: np.ndarray, docs_toxic: int, docs_clean: int) -> np.ndarray:
    """Words, each given once a document, that are in at least 2 % of toxic documents (and 5) and whose share there is ten times that in clean ones."""
    every, inverse = np.unique(words, return_inverse=True)
    bad = np.bincount(inverse, toxic, len(every))
    good = np.bincount(inverse, ~toxic, len(every))
    much = (bad >= max(5, 0.02 * docs_toxic)) & ((bad / docs_toxic) >= 10 * (good + 0.5) / max(docs_clean, 1))
    return every[much]


def _often(features: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features and each place's; those in fewer places than ``least`` are all feature 0, which has no weight."""
    every, inverse, n = np.unique(features, return_inverse=True, return_counts=True)
    keep = (n >= least) & (every != 0)
    number = np.where(keep, np.cumsum(keep), 0)
    return np.concatenate([np.zeros(1, np.uint64), every[keep]]), number.astype(np.int32)[inverse]


def fit(texts: list[str], toxic: list[bool], share: float | None = None) -> Field | None:
    return fit_batches(iter([pa.record_batch([pa.array(texts, pa.large_string()), pa.array(toxic, pa.bool_())], ["text", "toxic"])]), share)


def fit_batches(batches: Iterator[pa.RecordBatch], share: float | None = None, rounds: int = ROUNDS) -> Field | None:
    """By gradient steps on the likelihood of the words' labels."""
    hashes: list[list[np.ndarray]] = [[] for _ in range(1 + len(PREFIXES))]
    distinct: list[list[np.ndarray]] = [[] for _ in hashes]
    bad: list[list[np.ndarray]] = [[] for _ in hashes]
    counts, kinds = [], []
    for rows, data, offsets in tv.chunks(batches, "text"):  # a few megabytes at a time
        part = tv.words(data, offsets)
        own = rows.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
        counts.append(part.count)
        kinds.append(own)
        text = part.text
        for i, h in enumerate(word_codes(part)):
            hashes[i].append(h)
            # each feature once a text
            order = np.lexsort((h, text))
            t, u = text[order], h[order]
            fresh = u != 0
            fresh[1:] &= (u[1:] != u[:-1]) | (t[1:] != t[:-1])
            distinct[i].append(u[fresh])
            bad[i].append(own[t[fresh]])
    kind = np.concatenate(kinds) if kinds else np.zeros(0, bool)
    if not kind.any() or kind.all():
        return None
    forms, count = [np.concatenate(h) for h in hashes], np.concatenate(counts)
    last = np.cumsum(count)
    start, text = last - count, np.repeat(np.arange(len(count)), count)
    label = np.zeros(len(text), bool)
    for h, words, of in zip(forms, distinct, bad, strict=True):
        label |= np.isin(h, _lexicon(np.concatenate(words), np.concatenate(of), int(kind.sum()), int((~kind).sum())))
    # the same words in clean texts are what the weights have to be held against
    hits = np.flatnonzero(label)
    label &= kind[text]
    if not len(hits):
        return None
    y = label.astype(float)
    used = [*(_often(x, 2) for x in forms), *(_often(x, RARE) for x in shifted(forms[0], start, last))]
    weights = [np.zeros(len(u)) for u, _ in used]
    squares = [np.full(len(u), 1e-8) for u, _ in used]
    bias, bias_square, move, move_square = -2.0, 1e-8, np.zeros((2, 2)), np.full((2, 2), 1e-8)
    inner = np.ones(len(y), bool)
    inner[start[count > 0]] = False
    here = np.flatnonzero(inner)
    pairs = np.bincount(2 * label[here - 1] + label[here], minlength=4).reshape(2, 2)
    for _ in range(rounds):
        score = np.full(len(y), bias)
        for v, (_, i) in zip(weights, used, strict=True):
            score += v[i]
        p, moves = expected(np.exp(np.clip(score, -30, 30)), start, count, np.exp(move))
        error = (y - p) / len(hits)
        for v, s, (u, i) in zip(weights, squares, used, strict=True):
            g = np.bincount(i, error, len(u)) - 1e-5 * v
            s += g * g
            v += 0.5 * g / np.sqrt(s)
            v[0] = 0
        g = error.sum()
        bias_square += g * g
        bias += 0.2 * g / np.sqrt(bias_square)
        g = (pairs - moves) / len(hits)
        move_square += g * g
        move += 0.1 * g / np.sqrt(move_square)
    tables = []
    for v, (u, _) in zip(weights, used, strict=True):
        keep = (np.abs(v) > 0.05) & (u != 0)
        tables.append(Table(u[keep], v[keep]))
    field = Field(tables, bias, move)
    p = field.words(forms, start, count)
    likely = np.flatnonzero(p >= 0.5)
    evidence = np.bincount(text[likely], log_odds(p[likely]), len(count))
    share = kind.mean() if share is None else share
    some = evidence > 0  # documents without such a word aren't returned anyhow
    field.calibrate(evidence[some], kind[some], np.where(kind, share / kind.mean(), (1 - share) / (1 - kind.mean()))[some])
    return field


def _tag(field: Field, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tv.chunks(batches, "text"):
            w = tv.words(data, offsets)
            p = field.tag(w)
            at = np.flatnonzero(p >= 0.5)
            text = np.searchsorted(offsets, w.starts[at], "right") - 1
            score = field.documents(np.bincount(text, log_odds(p[at]), len(offsets) - 1))
            at, text = at[score[text] >= 0.5], text[score[text] >= 0.5]
            if not len(at):
                continue
            begins = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1])])
            lo = np.flatnonzero(begins)
            hi = np.append(lo[1:], len(at)) - 1
            before = tv.code_points(data)
            base = before[offsets[text[lo]]]
            spans = pa.StructArray.from_arrays([pa.array((before[w.starts[at[lo]]] - base).astype(np.int32)), pa.array((before[w.ends[at[hi]]] - base).astype(np.int32)), pa.array(np.round(np.maximum.reduceat(p[at], lo), 6))], ["start_char", "end_char", "p"])
            of = text[lo]
            starts, size = tv.runs(of)
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(of)).astype(np.int32)), spans)
            docs = of[starts]
            yield pa.RecordBatch.from_arrays([rows.column(id_col).take(pa.array(docs)), pa.array(np.round(score[docs], 6)), pa.array(size.astype(np.int32)), lists], [id_col, "score", "n_spans", "spans"])

    return run


def _fit(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = fit_batches(batches, share)
        if field is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(field)], pa.binary())], ["field"])

    return run


def agreed(labels: DataFrame, id_col: str) -> DataFrame:
    each = labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("__id"))
    return each.agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most and toxic in (0, 1)")


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text: str, fit_rows: int) -> DataFrame:
    """(text, toxic) of at most fit_rows labelled documents of each kind."""
    kinds = [agreed(labels, id_col).filter(F.col("toxic") == t).orderBy(F.xxhash64("__id"), "__id").limit(fit_rows) for t in (0, 1)]
    chosen = F.broadcast(kinds[0].unionByName(kinds[1]).select("__id", "toxic"))  # bounded by fit_rows
    return docs.select(F.col(id_col).alias("__id"), F.col(text).alias("text")).filter("text is not null").join(chosen, "__id").groupBy("__id", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("least")).select("least.text", (F.col("toxic") == 1).alias("toxic"))


def toxic_spans(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, score, n_spans, spans) of the documents with a toxic span."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, score double, n_spans int, spans array<struct<start_char:int,end_char:int,p:double>>"
    # fitted in one task, to which the bounded sample goes, so that it takes no memory of the driver
    one = training_rows(docs, labels, id_col, text, fit_rows).repartition(1).sortWithinPartitions("text", "toxic")
    share = agreed(labels, id_col).agg(F.avg("toxic")).first()[0]
    fitted = [pickle.loads(r[0]) for r in one.mapInArrow(_fit(share), "field binary").collect()] if share else []
    if not fitted:
        return spark.createDataFrame([], schema)
    return docs.select(F.col(id_col), F.col(text).alias("text")).filter("text is not null").mapInArrow(_tag(fitted[0], id_col), schema)
