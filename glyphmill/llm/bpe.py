"""Byte-level BPE encoding and decoding with an index of pair occurrences.

The distinct words of a block of texts are laid end to end as linked symbols. The index maps each
pair that has a rank to all its positions; ranks are applied in ascending order, each to all its
positions at once, and the lists of the pairs to the left and right are updated. Words are cut by the
byte-level pattern (contractions, letters, numbers, other, white space), for a whole block at a time.

Defined results: a null text has null tokens, an empty one none; repeated rows each give theirs.
Strings of special tokens are ordinary text. Decoding gives the bytes back exactly.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import textvec as tv
from glyphmill.llm.scratch import small_batches

BLOCK = 16 << 20
OTHER_SPACE, BLANK, LETTER, NUMBER, OTHER = range(5)
_models: dict[str, Model] = {}
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point."""
    if not _classes:
        kinds = np.full(0x110000, OTHER, np.uint8)
        for i in range(0x110000):
            c = unicodedata.category(chr(i))[0]
            if c == "L":
                kinds[i] = LETTER
            elif c == "N":
                kinds[i] = NUMBER
        kinds[[*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = OTHER_SPACE
        kinds[0x20] = BLANK
        _classes.append(kinds)
    return _classes[0]


def decode_utf8(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each character begins, and its code point."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.uint32)
    code = lead.copy()
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0xF8, 0x07, 3)):
        i = np.flatnonzero((lead >= low) & (lead < high))
        if len(i):
            c = lead[i] & mask
            for k in range(1, more + 1):
                c = c << 6 | (padded[at[i] + k] & 0x3F)
            code[i] = c
    return at, code


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes, and how many each text has."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    at, code = decode_utf8(data)
    kind = classes()[code]
    n = len(at)
    opens = np.zeros(n, bool)
    opens[np.searchsorted(at, offsets[:-1][np.diff(offsets) > 0])] = True
    before = np.concatenate([[255], kind[:-1]]).astype(np.uint8)
    before[opens] = 255
    after = np.concatenate([kind[1:], [255]]).astype(np.uint8)
    closes = np.concatenate([opens[1:], [True]])
    after[closes] = 255
    space, spaced = kind <= BLANK, before <= BLANK
    solid_next = (after != 255) & (after > BLANK)
    begins = np.where(space, ~spaced | solid_next, (before != kind) & (before != BLANK))
    begins |= opens
    # contractions, where the apostrophe begins a match
    quote = np.flatnonzero((code == 39) & begins & (kind == OTHER))
    if len(quote):
        text = np.cumsum(opens)
        c = np.concatenate([code, [0, 0, 0]])
        t = np.concatenate([text, [-1, -1, -1]])
        one, two = c[quote + 1], c[quote + 2]
        ok1, ok2 = t[quote + 1] == text[quote], t[quote + 2] == text[quote]
        short = ok1 & np.isin(one, [115, 116, 109, 100])
        long = ok1 & ok2 & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
        for found, size in ((quote[short], 2), (quote[long], 3)):
            begins[found + 1] = False
            nxt = found + size
            nxt = nxt[nxt < n]
            begins[nxt[(kind[nxt] == LETTER)]] = True
    starts = at[begins]
    cut = np.searchsorted(starts, offsets)
    return starts, np.append(starts[1:], len(data)), np.diff(cut)


class Model:
    """A vocabulary with ranked merges, as in a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {b: chr(b) for b in shown}
        for k, b in enumerate(x for x in range(256) if x not in chars):
            chars[b] = chr(256 + k)
        self.first = np.array([vocab[chars[b]] for b in range(256)], np.int32)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int32)
        self.right = np.array([vocab[b] for _, b in merges], np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        keys = self.left.astype(np.uint64) << np.uint64(32) | self.right.astype(np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        # most pairs are told by one look at a slot; those that share one are searched for
        slot = self.slot(keys)
        self.at = np.full(1 << 20, -1, np.int32)
        self.at[slot[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]
        self.shared = np.bincount(slot, minlength=1 << 20) > 1
        self.unordered = keys
        back = {c: b for b, c in chars.items()}
        pieces = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            if all(c in back for c in token):
                pieces[i] = bytes(back[c] for c in token)
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of each pair; -1 where it doesn't merge."""
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        slot = self.slot(keys)
        r = self.at[slot]
        r = np.where((r >= 0) & (self.unordered[r] == keys), r, -1).astype(np.int32)
        again = np.flatnonzero((r < 0) & self.shared[slot])
        if len(again):
            i = np.minimum(np.searchsorted(self.keys, keys[again]), len(self.keys) - 1)
            r[again] = np.where(self.keys[i] == keys[again], self.ranks[i], -1)
        return r

    def encode_words(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words laid end to end, and how many each has."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
        sym = self.first[data]
        ends = np.cumsum(sizes)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1] = -1
        before[ends - sizes] = -1
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def add(place: np.ndarray, rank: np.ndarray) -> None:
            some = rank >= 0
            place, rank = place[some], rank[some]
            if not len(place):
                return
            if len(place) == 1:
                r = int(rank[0])
                if r in index:
                    index[r].append(place)
                else:
                    index[r] = [place]
                    heapq.heappush(queue, r)
                return
            order = np.argsort(rank, kind="stable")
            place, rank = place[order], rank[order]
            at = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
            for r, lo, hi in zip(rank[at].tolist(), at.tolist(), [*at[1:].tolist(), len(rank)], strict=True):
                if r in index:
                    index[r].append(place[lo:hi])
                else:
                    index[r] = [place[lo:hi]]
                    heapq.heappush(queue, r)

        inner = np.flatnonzero(after >= 0)
        add(inner, self.rank(sym[inner], sym[inner + 1]))
        while queue:
            r = heapq.heappop(queue)
            parts = index.pop(r)
            p = parts[0] if len(parts) == 1 else np.concatenate(parts)
            a, b = int(self.left[r]), int(self.right[r])
            p = p[sym[p] == a]
            q = after[p]
            ok = q >= 0
            p, q = p[ok], q[ok]
            p = p[sym[q] == b]
            if not len(p):
                continue
            if len(p) > 1:
                p = np.sort(p)
                p = p[np.concatenate([[True], p[1:] != p[:-1]])]
                if a == b:  # of overlapping pairs every other one merges
                    fresh = np.concatenate([[True], after[p[:-1]] != p[1:]])
                    begin = np.flatnonzero(fresh)
                    p = p[(np.arange(len(p)) - begin[np.cumsum(fresh) - 1]) % 2 == 0]
            q = after[p]
            beyond = after[q]
            sym[p] = self.merged[r]
            sym[q] = -1
            after[p] = beyond
            right = beyond >= 0
            before[beyond[right]] = p[right]
            prior = before[p]
            left = prior >= 0
            place = np.concatenate([prior[left], p[right]])
            if len(place):
                add(place, self.rank(sym[place], sym[after[place]]))
        alive = sym >= 0
        upto = np.concatenate([[0], np.cumsum(alive)])
        return sym[alive], upto[ends] - upto[ends - sizes]

    def decode(self, tokens: np.ndarray) -> np.ndarray:
        """The bytes of the tokens."""
        return self.bytes[tv.spread(self.begin[tokens], self.sizes[tokens])]


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


class Block:
    """Texts whose words are encoded together: their distinct words, and which of them each text is made of."""

    def __init__(self):
        self.hashes, self.sizes, self.words, self.data = [], [], [], []
        self.seen = np.zeros(0, np.uint64)
        self.rows: list[tuple] = []
        self.bytes = 0

    def add(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> None:
        starts, ends, count = pretokens(data, offsets)
        h = tv.Hasher(tv.CODES[data]).of(starts, ends) if len(starts) else np.zeros(0, np.uint64)
        unique, first = np.unique(h, return_index=True)
        new = np.ones(len(unique), bool)
        if len(self.seen):
            i = np.minimum(np.searchsorted(self.seen, unique), len(self.seen) - 1)
            new = self.seen[i] != unique
        at = first[new]
        size = ends[at] - starts[at]
        self.words.append(data[tv.spread(starts[at], size)])
        self.sizes.append(size)
        self.hashes.append(unique[new])
        self.seen = np.sort(np.concatenate([self.seen, unique[new]]))
        self.rows.append((rows, h, count, data, offsets))
        self.bytes += len(data)

    def encode(self, m: Model, id_col: str) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        tokens, n = m.encode_words(np.concatenate(self.words), np.concatenate(self.sizes))
        begin = np.cumsum(n) - n
        hashes = np.concatenate(self.hashes)
        order = np.argsort(hashes)
        hashes, begin, n = hashes[order], begin[order], n[order]
        for rows, h, count, data, offsets in self.rows:
            i = np.searchsorted(hashes, h)
            flat = tokens[tv.spread(begin[i], n[i])] if len(i) else np.zeros(0, np.int32)
            upto = np.concatenate([[0], np.cumsum(n[i])])
            last = np.cumsum(count)
            lists = np.append(0, upto[last]).astype(np.int32) if len(count) else np.zeros(1, np.int32)
            back = m.decode(flat)
            same = np.concatenate([[0], np.cumsum(back != data)]) if len(back) == len(data) else None
            exact = same[offsets[1:]] == same[offsets[:-1]] if same is not None else np.zeros(len(count), bool)
            text = rows.column("text")
            null = np.asarray(text.is_null())
            column = pa.ListArray.from_arrays(pa.array(lists), pa.array(flat), mask=pa.array(null)) if null.any() else pa.ListArray.from_arrays(pa.array(lists), pa.array(flat))
            yield pa.RecordBatch.from_arrays([rows.column(id_col), column, pa.array(np.diff(lists), mask=null), pa.array(exact, mask=null)], [id_col, "tokens", "n_tokens", "round_trip"])


def _encode(path: str, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, block = model(path), Block()
        for rows, data, offsets in tv.chunks(batches, "text"):
            block.add(rows, data, offsets)
            if block.bytes >= BLOCK:
                yield from block.encode(m, id_col)
                block = Block()
        yield from block.encode(m, id_col)

    return run


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tokens, n_tokens, round_trip): round_trip says that decoding the tokens gave the text's bytes."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text).alias("text")).mapInArrow(_encode(path, id_col), f"`{id_col}` {kind}, tokens array<int>, n_tokens int, round_trip boolean")
