from array import array

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.llm import bpe

PATH, PATTERN = bpe.vocabulary()
CODEC = bpe.codec(PATH, PATTERN)
REFERENCE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200) | st.text(alphabet="abe the!12\n", max_size=400))
def test_encode_equals_the_library_and_decodes(text):
    text = text.encode("utf-8", "replace").decode()
    ids = CODEC.encode(text)
    assert list(array("I", ids)) == REFERENCE.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


@pytest.mark.parametrize("piece", ["a" * 20_000, "ab" * 9000, "!?" * 7000, "abcdefghij" * 3000])
def test_very_long_pretokens(piece):
    assert list(array("I", CODEC.encode(piece))) == REFERENCE.encode_ordinary(piece)


def test_positions_merge_lowest_rank_first_then_leftmost():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 70_000, b"aa": 300, b"aaaa": 301, b"aab": 299}
    assert bpe.merge(b"aaaaa", ranks) == [301, 97]
    assert bpe.merge(b"aaab", ranks) == [300, 97, 98]
    assert bpe.merge(b"aabc", ranks) == [299, 99]


def test_cache_forgets_without_harm(monkeypatch):
    monkeypatch.setattr(bpe, "_CACHE", 5)
    codec = bpe.Codec(PATH, PATTERN)
    text = " ".join(f"w{i % 17}x{i}" for i in range(200)) * 2
    assert list(array("I", codec.encode(text))) == REFERENCE.encode_ordinary(text)


def test_odd_rows(spark, odd_docs, no_docs):
    out = odd_docs.select("doc_id", bpe.round_trip(F.col("text"), PATH, PATTERN).alias("r")).select("doc_id", "r.*").collect()
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert len(out) == 10 and all((r.n_tokens == 0) == (r.ids_sha256 == empty) for r in out)
    assert [r.n_tokens for r in out if r.doc_id in (2, 3)] == [0, 0]
    assert bpe.encode_documents(no_docs, PATH, PATTERN).count() == 0
    enc = bpe.encode_documents(odd_docs, PATH, PATTERN)
    back = {(r.doc_id, bytes(r.b).decode()) for r in enc.select("doc_id", bpe.decode(F.col("ids"), PATH, PATTERN).alias("b")).collect()}
    assert back == {(r.doc_id, r.text or "") for r in odd_docs.collect()}
