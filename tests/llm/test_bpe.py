"""Tree BPE against the tiktoken library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from tests.llm.fixtures import SMALL, odd_documents
from tracemill.llm import bpe
from tracemill.llm.queries import op8_tree_bpe

RANKS = bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))
CODEC = bpe.TreeBpe(RANKS, public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def check(text):
    data = CODEC.encode(text)
    assert ids(data) == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(data) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "\n\n", "\t", "\r\n", "'s", "1", "23", "é", "漢", "😀", "...", "=", "\x1c", "\x85", " ", "ing"]), max_size=40))
def test_white_space_and_marks(parts):
    check("".join(parts))


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "=" * 4001, "é" * 999, " " * 700, "\n" * 700 + "a", "aAbB" * 900 + "x", "<|endoftext|>", ""])
def test_long_runs(text):
    check(text)


@settings(max_examples=200, deadline=None)
@given(st.text("abcdeht", max_size=80), st.data())
def test_any_tree_gives_the_same_tokens(word, data):
    """Joining is associative: the encodings of two parts, cut anywhere, join to that of the whole."""
    cut = data.draw(st.integers(0, len(word)))
    left, right = (CODEC.encode_bytes(p.encode()) for p in (word[:cut], word[cut:]))
    assert CODEC.join(left, right) == CODEC.encode_bytes(word.encode()) == CODEC._merge(word.encode())


def test_what_is_kept_does_not_matter():
    small = bpe.TreeBpe(RANKS, public_tokenizers.PATTERN)
    for kept in (small.pairs, small.windows, small.halves, small.words, small.spaced_words):
        kept.limit = 3
    text = "Some words are encoded again and again, as nothing is kept.\nReally " * 5
    assert small.encode(text) == CODEC.encode(text)


def test_every_token_is_the_encoding_of_its_bytes():
    assert all(CODEC._merge(token) == [rank] for token, rank in list(RANKS.items())[::50])


def test_whole_table(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = op8_tree_bpe(spark, SMALL).collect()
    assert len(found) == len(texts)
    for row in found:
        expected = LIBRARY.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(expected)
        assert row.ids_sha256 == hashlib.sha256(np.array(expected, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_columns_of_ids_and_bytes(spark):
    docs = odd_documents(spark)
    both = docs.select("text", bpe.encoded(spark, docs.text).alias("ids"))
    both = both.withColumn("back", bpe.decoded(spark, both.ids))
    for row in both.collect():
        assert ids(row.ids) == LIBRARY.encode_ordinary(row.text or "") and bytes(row.back).decode() == (row.text or "")


def test_odd_rows(spark):
    docs = odd_documents(spark)
    empty = hashlib.sha256(b"").hexdigest()
    found = {(r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.round_trip(docs).collect()}
    assert {(2, 0, empty), (3, 0, empty), (None, 0, empty)} <= found
    assert bpe.round_trip(docs).count() == docs.count() and bpe.round_trip(docs.limit(0)).count() == 0
