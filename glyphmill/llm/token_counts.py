"""Token counts of whole documents by overlap resynchronisation.

A text of more than ``CHUNK`` characters is encoded in chunks that overlap by ``OVERLAP``. Token
lengths give each chunk's byte offsets; two neighbours are spliced at a position that both have as a
token boundary and that is stable: a space after a character that isn't white space. No match of the
tokenizer's pattern holds a space after another kind of character, and none looks beyond the space
that follows it, so that tokens before such a place depend only on the text before it and tokens
from it on only on the text after it. Where the overlap has no such place, it is doubled; where it
has grown over the whole chunk, the chunk is encoded anew at twice its length, so that the work stays
in proportion to the text.

Defined results: a null or empty text has 0 tokens in 0 chunks; repeated rows each give theirs; no
other column than the id and the text is read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.scratch import small_batches

CHUNK, OVERLAP = 16_384, 512
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded: dict[tuple[str, str], tuple] = {}


def encoder(path: str, pattern: str = PATTERN) -> tuple[Callable[[str], np.ndarray], np.ndarray]:
    """The function from text to ids, and the bytes of each id; loaded once a process."""
    if (path, pattern) not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            sizes[i] = len(token)
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _loaded[path, pattern] = own.encode_to_numpy, sizes, own.encode_ordinary
    return _loaded[path, pattern]


def stable_places(text: str, start: int, end: int) -> np.ndarray:
    """Bytes from ``start`` to the stable places of text[start:end]."""
    part = text[start:end]
    places, at, size = [], part.find(" ", 1), 0
    before = 0
    while at > 0:
        if not part[at - 1].isspace():
            size += len(part[before:at].encode())
            before = at
            places.append(size)
        at = part.find(" ", at + 1)
    return np.array(places, np.int64)


def encode(text: str, ids_of: Callable[[str], np.ndarray], sizes: np.ndarray, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[np.ndarray, int, int]:
    """(ids, chunks, widenings) of a text."""
    if not text:
        return np.zeros(0, np.int64), 0, 0
    if len(text) <= chunk:
        return ids_of(text), 1, 0
    done: list[np.ndarray] = []
    chunks = widened = 0
    begin, end = 0, chunk
    left = ids_of(text[:end])
    chunks += 1
    while end < len(text):
        room, to = overlap, min(len(text), end + chunk - overlap)
        ends = np.cumsum(sizes[left])
        while True:
            start = max(begin, end - room)
            if start == begin:  # grown over the whole chunk
                end = min(len(text), begin + 2 * (end - begin))
                left = ids_of(text[begin:end])
                break
            right = ids_of(text[start:to])
            base = len(text[begin:start].encode())
            places = stable_places(text, start, end)
            opens = np.cumsum(sizes[right]) - sizes[right]
            both = places[np.isin(places + base, ends) & np.isin(places, opens)]
            if len(both):
                cut = both[len(both) // 2]
                done.append(left[: np.searchsorted(ends, base + cut) + 1])
                left = right[np.searchsorted(opens, cut) :]
                begin, end = start + len(text[start:end].encode()[:cut].decode()), to
                break
            room *= 2
            widened += 1
        chunks += 1
    done.append(left)
    return np.concatenate(done), chunks, widened


def _count(path: str, id_col: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, sizes, plain = encoder(path)
        for rows in batches:
            n, c, w = [], [], []
            for x in rows.column("text"):
                text = x.as_py() or ""
                if len(text) <= chunk:
                    n.append(len(plain(text)))
                    c.append(1 if text else 0)
                    w.append(0)
                else:
                    ids, chunks, widened = encode(text, ids_of, sizes, chunk, overlap)
                    n.append(len(ids))
                    c.append(chunks)
                    w.append(widened)
            yield pa.RecordBatch.from_arrays([rows.column(id_col), pa.array(n, pa.int64()), pa.array(c, pa.int32()), pa.array(w, pa.int32())], [id_col, "n_tokens", "n_chunks", "n_widened"])

    return run


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens, n_chunks, n_widened) of each row; path: a file of ranks that every executor can read."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text).alias("text")).mapInArrow(_count(path, id_col, chunk, overlap), f"`{id_col}` {kind}, n_tokens long, n_chunks int, n_widened int")
