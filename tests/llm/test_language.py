"""Cross-parsing against a plain parse, and language identification on the given texts."""

import numpy as np
from pyspark.sql import functions as F

from aqspark.llm import language as L
from aqspark.llm.batches import held_out

SAMPLES = {"xx": "abra cadabra abra", "yy": "lorem ipsum dolor lorem"}


def plain_phrases(text: str, sample: str) -> int:
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at:at + size + 1] in sample:
            size += 1
        at += size
        n += 1
    return n


def test_automaton_reads_exactly_the_substrings():
    moves = L.suffix_automaton(b"abcbcab")

    def reads(word):
        state = 0
        for c in word:
            if c not in moves[state]:
                return False
            state = moves[state][c]
        return True

    for a in (b"", b"abc", b"bcb", b"cab", b"abcbcab"):
        assert reads(a)
    for a in (b"ac", b"bb", b"abcbcaba", b"x"):
        assert not reads(a)


def test_phrases_equal_a_plain_parse():
    automata = L.build_automata(SAMPLES)
    texts = ["abra lorem", "zzz", "cadabra", "dolor ipsum abra x lorem ipsum", ""]
    found = L.phrase_counts([t.encode() for t in texts], automata)
    for row, text in zip(found, texts, strict=True):
        assert row.tolist() == [plain_phrases(text, SAMPLES[name]) for name in automata.languages]


def test_a_long_text_counts_whole():
    automata = L.build_automata(SAMPLES)
    text = ("lorem ipsum " * 2000).strip().encode()
    short, long = L.phrase_counts([b"lorem ipsum", text], automata)
    assert long[1] > 1500 * short[1] / 2
    assert np.argmin(long * automata.bits) == 1


def test_held_out_texts_are_recognised(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    automata = L.learn_languages(docs.where(~held_out(F.col("doc_id"))))
    found = L.identify(docs, automata).join(docs.select("doc_id", "lang", "text"), "doc_id").where(held_out(F.col("doc_id")))
    right, n = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right / n > 0.98


def test_odd_rows(spark):
    rows = [(1, "Abra cadabra", "xx", 1.0), (2, "dolor LOREM", "yy", 1.0), (3, None, "xx", 1.0), (4, "", "yy", 1.0),
            (5, "12 !?", None, None), (None, "lorem ipsum", None, None), (2, "dolor LOREM", "yy", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double")
    automata = L.learn_languages(docs)
    found = L.identify(docs, automata).collect()
    by_id = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows)
    assert [by_id[i]["lang_pred"] for i in (1, 2, 3, 4, 5, None)] == ["xx", "yy", "und", "und", "und", "yy"]
    assert all(0 <= r["score"] <= 1 for r in found) and by_id[3]["score"] == 0
    kept = L.identify(docs, automata, keep=docs.columns, names=("a", "b"))
    assert kept.columns == [*docs.columns, "a", "b"] and kept.count() == len(rows)


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    automata = L.learn_languages(empty)
    assert L.identify(empty, automata).count() == 0
    one = spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")
    assert L.identify(one, automata).first()["lang_pred"] == "und"
