from __future__ import annotations

import random

import pytest
import texts as tx
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmill.llm import bpe, queries

PATH = f"{queries.TOKENIZERS}/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def brute():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def own(texts: list[str | None]):
    import pyarrow as pa

    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    return [r for out in bpe._encode(PATH, "doc_id")(iter([batch])) for r in out.to_pylist()]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=6))
def test_like_the_library_on_any_text(brute, texts):
    for row, text in zip(own(texts), texts, strict=True):
        assert row["tokens"] == brute(text) and row["round_trip"]


def test_like_the_library_on_prose(brute):
    r = random.Random(3)
    texts = [tx.prose(i, 200) + r.choice(["'s it's we'll", "  \n\n x", "aaaaaaaaaaaaaaa", "1234567 ½", "<|endoftext|>", "　 \xa0 a"]) for i in range(40)]
    for row, text in zip(own(texts), texts, strict=True):
        assert row["tokens"] == brute(text) and row["round_trip"]


def test_rows(spark, brute):
    rows = tx.odd_rows()
    got = bpe.encoded(tx.frame(spark, rows, True), PATH).collect()
    assert len(got) == len(rows)
    key = lambda i, t: (str(i), str(t))
    assert sorted(key(r.doc_id, r.tokens) for r in got) == sorted(key(r[0], None if r[1] is None else brute(r[1])) for r in rows)
    assert all(r.round_trip for r in got if r.tokens is not None)


def test_empty_table(spark):
    assert bpe.encoded(tx.frame(spark, []), PATH).count() == 0


def test_query(spark, small, brute):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op9_bpe(spark, small).collect():
        assert r.tokens == (None if texts[r.doc_id] is None else brute(texts[r.doc_id]))
        assert r.tokens is None or r.round_trip and r.n_tokens == len(r.tokens)
