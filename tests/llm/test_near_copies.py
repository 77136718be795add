"""Consistent weighted sampling, components, and classes against all pairs."""

import re

import numpy as np
import pytest

from aqspark.llm import near_copies as N
from aqspark.llm import shingles as S
from aqspark.llm.components import connected_components

SCHEMA = "doc_id bigint, text string"


def prose(seed, n):
    random = np.random.default_rng(seed)
    return [f"w{x}" for x in random.integers(0, 5000, n)]


def edited(words, seed, changes):
    random = np.random.default_rng(seed)
    words = list(words)
    for at in random.choice(len(words), changes, replace=False):
        words[at] = f"e{seed}x{at}"
    return words


def test_shingles_of_many_texts_equal_those_of_one():
    texts = [b"", b"one two", b"a b c d e f", "é ü ñ 1 2 3 4".encode(), b"x" * 50, b"a b c d e a b c d e a b c d e", b"... !"]
    hashes, counts, n = S.shingle_sets(texts)
    assert n.tolist() == [0, 1, 2, 3, 1, 5, 0]
    at = 0
    for text, size in zip(texts, n, strict=True):
        own, often, _ = S.shingle_sets([text])
        assert (own == hashes[at:at + size]).all() and (often == counts[at:at + size]).all()
        at += size
    assert counts.max() == 3


def test_long_texts_are_hashed_in_parts(monkeypatch):
    text = " ".join(prose(1, 3000)).encode()
    whole = S.shingle_sets([text])[0]
    monkeypatch.setattr(S, "PART", 997)
    assert (S.shingle_sets([text])[0] == whole).all()


def test_samples_agree_as_often_as_the_sets_are_similar():
    random = np.random.default_rng(0)
    hashes = np.sort(random.integers(0, 1 << 63, 900, dtype="uint64") * np.uint64(2))
    weights = random.uniform(1, 2, 900)
    left, right = np.arange(700), np.arange(200, 900)
    heavier = weights * random.uniform(0.7, 1.4, 900)
    sampler = S.ConsistentSampler(3000)
    a = sampler.samples(hashes[left], weights[left], np.array([700]))
    b = sampler.samples(hashes[right], heavier[right], np.array([700]))
    want = S.weighted_jaccard(hashes[left], weights[left], hashes[right], heavier[right])
    assert abs((a == b).mean() - want) < 0.03


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)] + [(200, 200 + k) for k in range(1, 30)]
    found = connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))
    labels = {r["node"]: r["label"] for r in found.collect()}
    assert found.count() == len(labels)
    assert {labels[i] for i in range(41)} == {0} and {labels[i] for i in (90, 95, 100)} == {90}
    assert {labels[200 + k] for k in range(30)} == {200}
    none = connected_components(spark.createDataFrame([], "a bigint, b bigint"))
    assert none.count() == 0


def shingles(text):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def all_pairs_classes(rows, similarity):
    """Classes by the plain Jaccard similarity of all pairs."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(rows))]


@pytest.fixture(scope="module")
def rows():
    out = []
    for group in range(6):
        words = prose(group, 200 + 40 * group)
        out += [" ".join(words)] + [" ".join(edited(words, 100 * group + k, 2)) for k in range(9)]
    # a large group, and texts that share a long passage but little else
    base = prose(50, 150)
    out += [" ".join(edited(base, 5000 + k, 1)) for k in range(120)]
    passage = prose(60, 60)
    out += [" ".join(prose(700 + k, 90) + passage + prose(900 + k, 90)) for k in range(80)]
    out += ["short text", "Short  TEXT!", "other words", "one"]
    return list(enumerate(out))


def test_classes_equal_those_of_all_pairs(spark, rows):
    found = {r["doc_id"]: r["class_id"] for r in N.near_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [found[i] for i, _ in rows] == all_pairs_classes(rows, 0.8)


def test_large_buckets_are_searched_to_the_end(spark, rows, monkeypatch):
    monkeypatch.setattr(N, "SMALL", 2)
    monkeypatch.setattr(N, "BLOCK", 7)
    found = {r["doc_id"]: r["class_id"] for r in N.near_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [found[i] for i, _ in rows] == all_pairs_classes(rows, 0.8)


def test_odd_rows(spark):
    text = " ".join(prose(3, 60))
    rows = [(5, text), (3, text), (3, text), (None, text), (7, None), (8, ""), (9, "?!"), (9, "?!"), (10, "x" * 100_000),
            (None, "alone and nameless words here")]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = N.near_classes(docs).collect()
    assert len(found) == len(rows)
    named = sorted(((r["doc_id"], r["class_id"], r["class_size"]) for r in found), key=repr)
    assert named == sorted([(5, 3, 4), (3, 3, 4), (3, 3, 4), (None, 3, 4), (7, 7, 1), (8, 8, 1), (9, 9, 1), (9, 9, 1),
                            (10, 10, 1), (None, None, 1)], key=repr)


def test_one_row_of_a_class_stays(spark):
    text, other = " ".join(prose(3, 60)), " ".join(prose(4, 60))
    rows = [(5, text, 1, 2), (3, text, 1, 2), (3, text, 1, 2), (None, text, 1, 2), (7, None, 1, 2), (7, None, 1, 2),
            (2, other, 1, 2), (9, " ".join(edited(prose(4, 60), 1, 1)), 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row_key int, group int")
    found = N.without_near_copies(docs)
    assert found.columns == docs.columns
    assert sorted(r["doc_id"] for r in found.collect()) == [2, 3, 7, 7]
    empty = spark.createDataFrame([], SCHEMA)
    assert N.without_near_copies(empty).count() == 0 and N.near_classes(empty).count() == 0
