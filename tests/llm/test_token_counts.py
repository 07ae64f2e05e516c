from __future__ import annotations

import random

import numpy as np
import pytest
import texts as tx

from glyphmill.llm import queries, token_counts

PATH = f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def tokenizer():
    return token_counts.encoder(PATH)


def mixed(seed: int, n: int) -> str:
    r = random.Random(seed)
    pieces = ["word ", "it's ", "  ", "\n\n", "é", "你好", "12345", "!!! ", " a", "\t", "🎉", "don't", " ", "xyz\n "]
    return "".join(r.choice(pieces) for _ in range(n))


@pytest.mark.parametrize("seed", range(12))
def test_splices_are_the_whole_encoding(tokenizer, seed):
    ids_of, sizes, plain = tokenizer
    text = mixed(seed, 600)
    ids, chunks, _ = token_counts.encode(text, ids_of, sizes, 64, 8)
    assert ids.tolist() == plain(text) and chunks > 1


def test_overlap_widens_until_there_is_a_stable_place(tokenizer):
    ids_of, sizes, plain = tokenizer
    text = "a word " + "x" * 100 + " " + "y" * 30 + " end" * 40
    ids, _, widened = token_counts.encode(text, ids_of, sizes, 64, 4)
    assert ids.tolist() == plain(text) and widened > 0


def test_no_stable_place_at_all(tokenizer):
    ids_of, sizes, plain = tokenizer
    text = "ab" * 2000
    ids, chunks, _ = token_counts.encode(text, ids_of, sizes, 64, 8)
    assert ids.tolist() == plain(text)
    assert chunks < 12  # chunks double, so that the work is in proportion to the text


def test_rows(spark, tokenizer):
    given = tx.odd_rows()
    got = token_counts.token_counts(tx.frame(spark, given, True), PATH).collect()
    want = sorted((str(r[0]), len(tokenizer[2](r[1] or ""))) for r in given)
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want
    assert {r.n_chunks for r in got if r.n_tokens == 0} == {0}
    assert max(r.n_chunks for r in got) > 10


def test_empty_table(spark):
    assert token_counts.token_counts(tx.frame(spark, []), PATH).count() == 0


def test_query(spark, small, tokenizer):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in queries.op1_token_counts(spark, small).collect()}
    assert got == {i: len(tokenizer[2](t or "")) for i, t in texts.items()}
    assert np.all(np.array(list(got.values())) >= 0)
