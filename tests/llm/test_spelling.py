"""Spelling variants against a comparison of all words with each other."""

import re
import zlib
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from aqspark.llm.spelling import Acceptor, bounded_states, count_words, near_words, one_edit, spelling_variants

DOCS = "doc_id bigint, text string"


def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    u, v = sorted((u, v), key=len)
    return len(u) + 1 == len(v) and any(u == v[:i] + v[i + 1:] for i in range(len(v)))


def plain_words(rows, least, damage):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += len(run) >= least
    return +out


def plain_variants(words, ratio):
    out, forms = {}, {}
    for w, n in words.items():
        around = [v for v in words if near(w, v)]
        best = min(around, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= ratio * n:
            forms[w] = best
        out[w] = [n, len(around), forms.get(w), words.get(forms.get(w))]
    for w in out:
        root = w
        while root in forms:
            root = forms[root]
        out[w].append(root)
    return sorted((w, *x) for w, x in out.items())


def check(spark, rows, least=6, count=5, ratio=5, damage=3):
    found = spelling_variants(spark.createDataFrame(rows, DOCS), min_length=least, min_count=count, ratio=ratio, damage=damage)
    words = {w: n for w, n in plain_words(rows, least, damage).items() if n >= count}
    got = sorted(map(tuple, found.select("word", "n", "n_near", "form", "form_n", "root").collect()))
    assert got == plain_variants(words, ratio)
    return got


def test_odd_texts(spark):
    rows = [(i, "Straße straße STRASSE naïveté naivete colour color colours ÀÉÎÕÜß aaaaaaa aaaaaab aaaaaaaa") for i in range(40)]
    rows += [(None, "colour colours colourz"), (None, None), (1, ""), (2, "123 ! ×÷×÷×÷"), rows[0], rows[0]]
    rows += [(i, "Coluor colur colouur " * 6) for i in range(100, 103)]
    got = check(spark, rows, damage=7)
    assert any(form for _, _, _, form, _, _ in got) and any(len(r[0]) == 7 for r in got)
    check(spark, rows, damage=0)


def test_chains_of_forms(spark):
    rows = [(i, " ".join(["abcdef"] * n1 + ["abcdeg"] * n2 + ["abcdhg"] * n3)) for i, (n1, n2, n3) in enumerate([(130, 26, 5)])]
    got = {r[0]: r for r in check(spark, rows, damage=0)}
    assert got["abcdhg"][3] == "abcdeg" and got["abcdhg"][5] == "abcdef"


def test_no_words_and_clashing_columns(spark):
    assert spelling_variants(spark.createDataFrame([], DOCS)).count() == 0
    docs = spark.createDataFrame([(i, "wonder wonders", 1, 2, 3) for i in range(9)], "doc_id int, text string, word int, state int, n int")
    assert {r["word"]: r["n_near"] for r in spelling_variants(docs, damage=0).collect()} == {"wonder": 1, "wonders": 1}


def test_one_very_long_word(spark):
    long = "ab" * 20_000
    rows = [(i, long) for i in range(6)] + [(i, long + "a") for i in range(6, 40)]
    found = spelling_variants(spark.createDataFrame(rows, DOCS), damage=0).collect()
    assert {len(r["word"]): len(r["root"]) for r in found} == {40_000: 40_001, 40_001: 40_001}


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text(alphabet="abc", min_size=1, max_size=7), max_size=25))
def test_composition_lists_each_pair_once(words):
    length = 4
    a, b = Acceptor(sorted(w for w in words if len(w) == length)), Acceptor(sorted(words))
    got = list(one_edit(a, b, length + 1))
    assert len(got) == len(set(got))
    assert set(got) == {(u, v) for u in words for v in words if len(u) == length and len(v) in (length, length + 1) and near(u, v)}


@given(st.sets(st.text(alphabet="ab", min_size=1, max_size=6), max_size=30))
@settings(max_examples=40, deadline=None)
def test_acceptor_is_minimal(words):
    """Two states never have the same future."""
    a = Acceptor(sorted(words))

    def future(s):
        return frozenset([""] * a.final[s]) | {x + r for x, t in a.arcs[s].items() for r in future(t)}

    reached, todo = {0}, [0]
    while todo:
        for t in a.arcs[todo.pop()].values():
            if t not in reached:
                reached.add(t)
                todo.append(t)
    futures = [future(s) for s in reached]
    assert future(0) == words and len(set(futures)) == len(futures)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.text(alphabet="abc", min_size=3, max_size=9), st.integers(1, 50), min_size=1, max_size=120), st.sampled_from([2, 5]))
def test_divided_states_find_the_same(spark, words, most):
    """However few words a state may hold, every pair is found once."""
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r["word"]: (r["n_near"], r["best"], r["best_n"]) for r in near_words(table, 3, most).collect()}
    want = {w: [v for v in words if near(w, v)] for w in words}
    assert got == {w: (len(a), min(a, key=lambda v: (-words[v], v)), max(words[v] for v in a)) for w, a in want.items() if a}


def test_a_third_of_the_words_begin_alike(spark):
    """A crowded state is divided; no state that is walked holds more words than allowed."""
    words = {f"commonest{a}{b}{c}" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"}
    words |= {f"{a}{b}ending" for a in "abcdefghijklmnop" for b in "abcdefghijklmnop"}
    table = spark.createDataFrame([(w, 5 + i) for i, w in enumerate(sorted(words))], "word string, n long")
    counts = bounded_states(table, 6, 40).groupBy("state", "head", "tail", "short").count()
    assert counts.where("count > 40 AND short - head - tail > 1").count() == 0
    got = {r["word"]: r["n_near"] for r in near_words(table, 6, 40).collect()}
    assert got == {w: 21 for w in words if w.startswith("common")} | {w: 30 for w in words if w.endswith("ending")}


def test_counts_leave_a_task_in_parts(spark):
    rows = [(i, f"repeated word{chr(97 + i % 26)}ing") for i in range(200)]
    got = {r["word"]: r["n"] for r in count_words(spark.createDataFrame(rows, DOCS).repartition(3), damage=0).collect()}
    assert got == plain_words(rows, 6, 0)
