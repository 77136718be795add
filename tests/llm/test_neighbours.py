"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from aqspark.llm import neighbours as V

SCHEMA = "vec_id bigint, embedding array<float>"


def rows_of(points, first=0):
    return [(first + i, [float(x) for x in p]) for i, p in enumerate(points)]


def brute(rows, queries, k):
    """{query: [(id, score), ...]} over distinct valid rows."""
    width = max(set(len(v) for _, v in rows if v), key=[len(v) for _, v in rows if v].count)
    good = {(i, tuple(np.float32(v).tolist())) for i, v in rows if i is not None and v is not None and len(v) == width
            and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = [i for i, _ in good]
    points = np.array([v for _, v in good])
    out = {}
    for q, v in good:
        if q in queries:
            score = (points * np.array(v)).sum(1)
            out[q] = sorted(((i, s) for i, s in zip(ids, score, strict=True) if i != q), key=lambda x: (-x[1], x[0]))[:k]
    return out


def found_by(spark, rows, asked, k, **options):
    table = spark.createDataFrame(rows, SCHEMA)
    found = V.search(V.build_index(table, k=k, **options), table.where(asked), k=k)
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


@pytest.fixture(scope="module")
def clustered():
    random = np.random.default_rng(1)
    centres = random.normal(size=(40, 16)) * 3
    return np.concatenate([c + random.normal(size=(60, 16)) for c in centres])


def test_parts_are_balanced_and_keep_neighbours_together(clustered):
    score = clustered @ clustered.T
    np.fill_diagonal(score, -np.inf)
    near = np.argsort(-score, axis=1)[:, :10]
    label = V.balanced_parts(near, clustered, 8)
    sizes = np.bincount(label, minlength=8)
    assert sizes.max() <= 1.06 * len(clustered) / 8 + 1
    assert (label[near] == label[:, None]).mean() > 0.5


def test_recall_and_exact_scores(spark, clustered, monkeypatch):
    monkeypatch.setattr(V, "PART_SIZE", 200)
    monkeypatch.setattr(V, "BLOCK", 128)
    monkeypatch.setattr(V, "QUERY_BLOCK", 32)
    rows = rows_of(clustered)
    found = found_by(spark, rows, "vec_id % 20 = 0", 20)
    want = brute(rows, {i for i, _ in rows if i % 20 == 0}, 20)
    assert found.keys() == want.keys()
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    score = {(q, i): s for q in want for i, s in want[q]}
    assert all(abs(s - score[q, i]) < 1e-9 for q in found for i, s in found[q] if (q, i) in score)


def test_copies_ties_and_odd_vectors(spark):
    random = np.random.default_rng(2)
    points = random.normal(size=(30, 4)).round(1)
    rows = rows_of(points) + rows_of(np.repeat(points[:1], 60, axis=0), 100)
    rows += [(500, None), (501, [0.0] * 4), (502, [1.0, None, 0.0, 0.0]), (503, [1.0, float("nan"), 0.0, 0.0]), (504, [1.0, 2.0]),
             (505, [1.0, float("inf"), 0.0, 0.0]), (None, [1.0] * 4), (0, rows[0][1]), rows[1]]
    found = found_by(spark, rows, "vec_id % 20 = 0 OR vec_id IS NULL", 20)
    want = brute(rows, {i for i, _ in rows if i is not None and i % 20 == 0}, 20)
    assert found.keys() == want.keys()
    for q in want:
        assert [i for i, _ in found[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in found[q]], [s for _, s in want[q]])


def test_few_rows_and_empty_tables(spark):
    rows = rows_of(np.eye(4)[:3])
    assert {q: len(v) for q, v in found_by(spark, rows, "vec_id = 0", 20).items()} == {0: 2}
    assert found_by(spark, rows[:1], "vec_id = 0", 20) == {}
    assert found_by(spark, [], "vec_id = 0", 20) == {}


@pytest.mark.parametrize("size", [2100, 4000, 8192, 8200])
def test_visited_parts_are_fitted_on_unseen_vectors_at_every_size(spark, size, monkeypatch):
    seen, learned = [], []
    set_probes, learn = V._set_probes, V.Router.learn
    monkeypatch.setattr(V, "_set_probes", lambda index, tests, *rest: (seen.append(tests), set_probes(index, tests, *rest)))
    monkeypatch.setattr(V.Router, "learn", staticmethod(lambda points, shares: (learned.append(points), learn(points, shares))[1]))
    points = np.random.default_rng(size).normal(size=(size, 8)).astype("float32")
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    table = spark.createDataFrame(rows_of(points), SCHEMA)
    index = V.build_index(table)
    (tests,), (known,) = seen, learned
    assert len(tests) == min(V.TESTS, size // 16)
    assert not {tuple(p) for p in tests} & {tuple(p) for p in known}
    assert index.recall >= 0.95
    asked = [i for i in range(size) if i % 20 == 0]
    rows = V.search(index, table.where("vec_id % 20 = 0")).collect()
    found = {i: set() for i in asked}
    for r in rows:
        found[r["query_id"]].add(r["vec_id"])
    score = points[asked].astype(float) @ points.T.astype(float)
    score[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-score, axis=1)[:, :20]
    hits = sum(len(found[i] & set(near)) for i, near in zip(asked, best.tolist(), strict=True))
    assert hits >= 0.9 * 20 * len(asked)


def test_given_vectors_are_searched_by_parts(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    index = V.build_index(table)
    assert index.vectors.select("part").distinct().count() > 8
    found = {}
    for r in V.search(index, table.where("vec_id % 20 = 0")).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute([tuple(r) for r in table.select("vec_id", "embedding").collect()], found.keys(), 20)
    assert sum(len(found[q] & {i for i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)


def test_clustered_vectors_visit_few_parts(spark):
    random = np.random.default_rng(4)
    centres = random.normal(size=(100, 16)) * 4
    points = np.concatenate([c + random.normal(size=(200, 16)) * 0.3 for c in centres])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    table = spark.createDataFrame(rows_of(points), SCHEMA)
    index = V.build_index(table)
    assert len(index.sizes) == 141
    assert index.probes < len(index.sizes) / 4
    asked = np.arange(0, len(points), 500)
    found = {int(i): set() for i in asked}
    for r in V.search(index, table.where("vec_id % 500 = 0")).collect():
        found[r["query_id"]].add(r["vec_id"])
    points = points.astype("float32").astype(float)
    score = points[asked] @ points.T
    score[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-score, axis=1)[:, :20]
    assert sum(len(found[int(i)] & set(near)) for i, near in zip(asked, best.tolist(), strict=True)) >= 0.9 * 20 * len(asked)


def test_queries_of_another_common_length(spark):
    random = np.random.default_rng(5)
    table = spark.createDataFrame(rows_of(random.normal(size=(300, 8))), SCHEMA)
    queries = spark.createDataFrame([*rows_of(random.normal(size=(5, 4)), 1000), *rows_of(random.normal(size=(2, 8)), 2000)], SCHEMA)
    found = V.search(V.build_index(table), queries).collect()
    assert {r["query_id"] for r in found} == {2000, 2001}
