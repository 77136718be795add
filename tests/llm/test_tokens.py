"""Token counts and the byte codec against the libraries of the vocabularies."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from aqspark.llm.byte_codec import ByteCodec, decode_ids, encode_texts, round_trip
from aqspark.llm.token_counts import PairTable, WordCounter, count_tokens, merge_all

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

TEXTS = ["", " ", "Hello world's  end", "a" * 3000, "ab" * 2000, "naïve Σς İ \x85\x1c é é", "日本語 🙂 ½ Ⅷ １２",
         "<|startoftext|>x<|endoftext|><|endoftext|>", "<|endoftext", "<unk> <s> ▁▁ ▁a", "\n\n \t x  "]
SCHEMA = "doc_id bigint, text string, n_tokens string, ids int"


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def ranks():
    with open(BYTES, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


ANY = st.text(st.characters(codec="utf-8", categories=("L", "N", "P", "S", "Z", "Cc")), max_size=60)


def test_counts_equal_the_library(words):
    counter = WordCounter(WORDS)
    assert counter.count(TEXTS) == [len(e.ids) for e in words.encode_batch(TEXTS, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abe 'stΣσς\x85\x1c　日本１½🙂<|>$%_Ǻ\n", max_size=40), max_size=5))
def test_counts_of_odd_texts(texts):
    counter, library = WordCounter(WORDS), Tokenizer.from_file(WORDS)
    assert counter.count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_merge_takes_every_second_of_overlapping_pairs():
    pairs = PairTable([1, 2], [1, 1], [2, 3])
    # (1 1) → 2 first, then (2 1) → 3
    assert merge_all(np.array([1, 1, 1, 1, 1, 7]), np.array([3, 2, 1]), pairs).tolist() == [1, 1, 1]
    assert merge_all(np.array([], "int64"), np.array([], "int64"), pairs).tolist() == []


def test_ids_equal_the_library(ranks):
    codec = ByteCodec(BYTES, PATTERN)
    assert codec.encode(TEXTS) == [ranks.encode_ordinary(t) for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(ANY)
def test_round_trip_of_any_text(text):
    codec = ByteCodec(BYTES, PATTERN)
    assert codec.decode(codec.encode([text])[0]) == text.encode()


def test_codec_in_spark(spark, ranks):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, None, None, None), (0, "", "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = {r["doc_id"]: r for r in round_trip(docs, BYTES, PATTERN).collect()}
    assert round_trip(docs, BYTES, PATTERN).count() == len(rows)
    for i, text in enumerate(TEXTS):
        ids = ranks.encode_ordinary(text)
        assert found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert found[None]["n_tokens"] == 0
    encoded = encode_texts(docs, BYTES, PATTERN)
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()}[2] == ranks.encode_ordinary(TEXTS[2])
    assert {r["doc_id"]: bytes(r["bytes"]) for r in decode_ids(encoded, BYTES, PATTERN).collect()}[6] == TEXTS[6].encode()
    with_ids = {r["doc_id"]: r["ids"] for r in round_trip(docs, BYTES, PATTERN, with_ids=True).collect()}
    assert with_ids[6] == ranks.encode_ordinary(TEXTS[6]) and with_ids[None] == []


def test_counts_in_spark(spark, words):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, None, None, None)], SCHEMA)
    found = {r["doc_id"]: r for r in count_tokens(docs, WORDS, limit=100).collect()}
    for i, text in enumerate(TEXTS):
        n = len(words.encode(text, add_special_tokens=False).ids)
        assert (found[i]["n_bytes"], found[i]["n_tokens"], found[i]["over_limit"]) == (len(text.encode()), n, n > 100)
    assert (found[None]["n_bytes"], found[None]["n_tokens"]) == (0, 0)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert count_tokens(docs, WORDS).count() == 0
    assert round_trip(docs, BYTES, PATTERN).count() == 0
