"""Ranked search against scores of every document for every item."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from aqspark.llm import bag_search
from aqspark.llm.bag_search import Best, bag_classes, rank_documents, terms_of

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t)
            for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain_ranks(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    lengths = [sum(b.values()) for _, b in bags]
    n_docs, n_terms = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in wanted.items():
        scored = []
        for (i, bag), n in zip(bags, lengths, strict=True):
            m = 100 - 90 + (90 * n * n_docs) // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * bag[t] // (1000 * bag[t] + 8 * m))
                        for t in own & bag.keys())
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        scored.sort()
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def check(spark, docs, items, k=10, **options):
    found = rank_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), k, **options)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain_ranks(docs, items, k)


def test_odd_rows(spark):
    docs = [(i, f"alpha beta{i % 4} gamma Über-x É é {'filler ' * (i % 5)}") for i in range(50)]
    docs += [(None, "alpha"), (None, "alpha"), (7, None), (8, ""), (9, "!!"), docs[0], docs[0], (60, "Alpha, ALPHA alpha" * 9)]
    items = [(1, "alpha beta1"), (1, "gamma"), (2, "É über"), (3, None), (4, "--"), (None, "beta2 beta2"), (5, "nowhere"), (2, "É über")]
    check(spark, docs, items)
    check(spark, docs, items, k=3, block_terms=2)


def test_empty_tables(spark):
    check(spark, [], [(1, "a")])
    check(spark, [(1, "a")], [])
    check(spark, [(1, None), (2, "?")], [(1, "a")])


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "same words", 1, 2, 3) for i in range(5)], "doc_id int, text string, n int, terms int, item_id int")
    items = spark.createDataFrame([("x", "words", 9, 8)], "item_id string, text string, term int, doc_id int")
    docs = docs.unionByName(docs.selectExpr("doc_id + 10 AS doc_id", "'others' AS text", "n", "terms", "item_id"))
    assert [tuple(r)[:3] for r in rank_documents(docs, items, 3).orderBy("rank").collect()] == [("x", 1, 0), ("x", 2, 1), ("x", 3, 2)]


def test_copies_are_scored_once(spark):
    """A third of all documents are one class; it keeps its first ids and is scored as one row."""
    docs = [(i, "copied text of words") for i in range(1000, 400, -1)] + [(i, f"own words {i}") for i in range(400)]
    items = [(1, "copied words"), (2, "own 17 copied")]
    check(spark, docs, items)
    vectors = spark.createDataFrame([(i, 4, [0, 1], [1, 1]) for i in range(100, 0, -1)] + [(0, 4, [0, 1], [1, 2]), (3, 9, [0, 1], [1, 1])],
                                    "doc_id long, n long, terms array<int>, tfs array<long>")
    classes = bag_classes(vectors, 102, 411, members=10).collect()
    assert sorted(r["members"] for r in classes) == [[0], [1, 2, 3, 4, 5, 6, 7, 8, 9, 10], [3]]


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_texts_in_pieces(piece, monkeypatch):
    monkeypatch.setattr(bag_search, "PIECE", piece)
    text = "Ein längeres Wört; and_some\tmore-words x1 " * 5
    assert [t.decode() for p in terms_of(text.encode()) for t in p] == terms(text)


def test_steps_of_any_size(spark, monkeypatch):
    """Classes scored one at a time give the same ranks."""
    table = np.random.default_rng(3)
    best, rows = Best(3, 4), []
    for _ in range(40):
        item, score, doc = table.integers(0, 3, 9), table.integers(1, 6, 9), table.integers(0, 50, 9)
        keep = score >= best.least[item]
        rows += list(zip(item, -score, doc, strict=True))
        best.add(item[keep], score[keep], np.zeros(keep.sum(), int), doc[keep])
    got = sorted(zip(best.rows[0], -best.rows[1], best.rows[3], strict=True))
    assert got == sorted(r for i in range(3) for r in sorted(x for x in rows if x[0] == i)[:4])


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab É", max_size=30), min_size=1, max_size=12), st.lists(st.text(alphabet="abÉ ", max_size=12), min_size=1, max_size=4))
def test_any_texts(spark, docs, items):
    check(spark, list(enumerate(docs)), list(enumerate(items)), k=3)


def test_sums_beyond_doubles():
    cell, value = np.zeros(3, int), np.array([2 ** 61, 2 ** 60 + 1, 3])
    assert bag_search._summed(cell, value, 2).tolist() == [2 ** 61 + 2 ** 60 + 4, 0]
