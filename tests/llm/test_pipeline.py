"""The pipeline against its stages done one by one in plain Python."""

import pytest

import corpus_pipeline
from aqspark.llm.queries import ORACLES, QUERIES
from check import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs.toPandas()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        out.append(docs.toPandas())
    return out


def test_stages_keep_the_columns_and_only_drop_rows(kept):
    for before, after in zip(kept, kept[1:-1], strict=False):
        assert list(after.columns) == list(before.columns)
        assert set(after["doc_id"]) <= set(before["doc_id"])


def test_decisions_take_effect(kept):
    start, language, lines, near, benchmark, last = kept
    assert len(language) == start["text"].map(lambda t: any(c.isalpha() for c in t)).sum()
    assert len(lines) == len(language)
    assert (lines["n_chars"] == lines["text"].map(len)).all()
    assert len(near) < len(lines) and near["text"].is_unique
    assert len(benchmark) < len(near)
    assert set(last["doc_id"]) == set(benchmark["doc_id"])
    assert (last["n_tokens"] == last["ids"].map(len)).all()


def test_run_gives_the_last_stage(spark, kept):
    assert sorted(r["ids_sha256"] for r in corpus_pipeline.run(spark, FOLDER).collect()) == sorted(kept[-1]["ids_sha256"])


def test_odd_documents(spark):
    rows = [(1, None, None, None, None), (None, "Some words here", "en", "a", 1), (2, "", "en", None, 0), (2, "", "en", None, 0),
            (3, "Some other words", None, "a", 16)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert sorted(str(r["doc_id"]) for r in docs.collect()) in (["3", "None"], [])
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, FOLDER)
    assert empty.count() == 0


def test_lines_of_small_sources_are_judged_by_their_share(spark):
    def page(source, n, *lines):
        return n, "\n".join([f"own words {n} of {source}", *lines]), "en", source, None

    rows = [page("five", n, "common footer") for n in range(5)]
    rows += [page("nine", 10 + n, "common footer", *["twice"] * (n < 2)) for n in range(9)]
    rows += [page("fifty", 20 + n, *["six of fifty"] * (n < 6), *["five of fifty"] * (n < 5)) for n in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    texts = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_stage(spark, docs, FOLDER).collect()}
    assert all(texts[n] == f"own words {n} of five" for n in range(5))
    assert texts[10] == "own words 10 of nine\ntwice" and texts[18] == "own words 18 of nine"
    assert texts[20] == "own words 20 of fifty\nfive of fifty"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries(spark, name):
    _, verdict = compare(spark, connect(FOLDER), name, FOLDER)
    assert verdict == ("ok" if name in ORACLES else "rows only")
