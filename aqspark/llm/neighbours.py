"""Approximate nearest neighbours by learned partitions.

A neighbour graph over a bounded sample of the vectors is cut into balanced parts that keep neighbours
together. A small network learns which parts hold the neighbours of a vector. It assigns every vector
to its most probable part, and routes a query to its several most probable ones; the vectors there are ranked by
the exact inner product in double precision.

How many parts a query visits is measured, not guessed: for test vectors all true neighbours are
found by brute force over the whole table, and the fewest parts are taken that reach the wanted recall.

Vectors that are equal stand in the index once, with the smallest ids that bear them, so copies cost nothing and ties
go to the smaller id. Vectors that are null, zero, hold null or non-finite components, or are not as long as most, take no part, nor
do rows without an id; rows repeated wholly count once. Where there are fewer candidates than wanted, all are returned; an empty
table gives an empty result. Only the id and the vector are read, so other columns cannot clash.
"""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aqspark.llm.batches import map_arrow, written

# vectors of the sample that the parts are learned from
SAMPLE = 8192
# there are as many parts as vectors in each (the root of their number), as long as the sample shows so many of each part;
# more if that leaves parts too large
PART_SIZE, SHOWN = 1024, 32
# fewer distinct vectors than this are one part
LEAST_VECTORS = 256
# edges per vector of the neighbour graph
DEGREE = 10
# vectors whose true neighbours are found by brute force to set the number of visited parts
TESTS = 256
# of a small sample a sixteenth, but so many
LEAST_TESTS = 32
# vectors and queries that meet in one task: small parts share a block, large ones are split
BLOCK, QUERY_BLOCK = 16384, 1024


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str, width: int | None = None) -> DataFrame:
    """(id, vector) of the rows that take part: those of the given or commonest length."""
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where("id IS NOT NULL AND vector IS NOT NULL").where(~bad & F.exists("vector", lambda x: x != 0))
    if width is None:
        sizes = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows"))
        width = sizes.agg(F.max(F.struct("rows", "n"))["n"].alias("n")).first()["n"]
    return rows.where(F.size("vector") == (width or 0))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def vectors_array(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] if rows.size else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype="int32") * width), pa.array(rows.ravel(), pa.float64()))


def balanced_parts(neighbours: np.ndarray, points: np.ndarray, parts: int, rounds: int = 25) -> np.ndarray:
    """Cut the graph into parts of nearly equal size, with few edges between them.

    It starts from halves by the median along a principal direction, halved again and again, and then moves
    vertices to the part that most of their neighbours are in, the most gainful first, while there is room.
    """
    label = np.zeros(len(points), "int64")
    work = [(np.arange(len(points)), 0, parts)]
    while work:
        own, first, n = work.pop()
        if n == 1 or len(own) < 2:
            label[own] = first
            continue
        centred = points[own] - points[own].mean(0)
        direction = np.linalg.svd(centred[:: max(1, len(own) // 2000)], full_matrices=False)[2][0]
        order = np.argsort(centred @ direction, kind="stable")
        left = n // 2
        cut = len(own) * left // n
        work += [(own[order[:cut]], first, left), (own[order[cut:]], first + left, n - left)]
    # edges count both ways
    a = np.r_[np.repeat(np.arange(len(points)), neighbours.shape[1]), neighbours.ravel()]
    b = np.r_[neighbours.ravel(), np.repeat(np.arange(len(points)), neighbours.shape[1])]
    room = int(np.ceil(1.05 * len(points) / parts))
    for _ in range(rounds):
        votes = np.bincount(a * parts + label[b], minlength=len(points) * parts).reshape(-1, parts)
        here = votes[np.arange(len(points)), label]
        best = votes.argmax(1)
        gain = votes[np.arange(len(points)), best] - here
        size = np.bincount(label, minlength=parts)
        moved = 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if size[best[v]] < room:
                size[label[v]] -= 1
                size[best[v]] += 1
                label[v] = best[v]
                moved += 1
        if not moved:
            break
    return label


@dataclass
class Router:
    """A network of one hidden layer: vector → probability of each part."""

    layers: list[np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum(x @ w1 + b1, 0) @ w2 + b2

    @staticmethod
    def learn(points: np.ndarray, shares: np.ndarray, hidden: int = 128, epochs: int = 40, seed: int = 11) -> "Router":
        """Fit to the shares of each part among a vector's neighbours (cross entropy, Adam)."""
        random = np.random.default_rng(seed)
        width, parts = points.shape[1], shares.shape[1]
        layers = [random.normal(0, np.sqrt(2 / width), (width, hidden)), np.zeros(hidden),
                  random.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
        # vectors of any length get inputs of the same scale
        scale = np.sqrt(width) / max(np.sqrt((points ** 2).sum(1).mean()), 1e-300)
        x_all = points * scale
        first, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
        step = 0
        for _ in range(epochs):
            order = random.permutation(len(points))
            for start in range(0, len(points), 256):
                own = order[start:start + 256]
                x, y = x_all[own], shares[own]
                h = np.maximum(x @ layers[0] + layers[1], 0)
                z = h @ layers[2] + layers[3]
                z -= z.max(1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(1, keepdims=True)
                dz = (p - y) / len(own)
                dh = (dz @ layers[2].T) * (h > 0)
                step += 1
                for i, g in enumerate((x.T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    layers[i] -= 2e-3 * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
        layers[0] = layers[0] * scale
        return Router(layers)


@dataclass
class Index:
    """``vectors``: (part, ids, vector), one row per distinct vector. ``sizes``: their number in every part."""

    vectors: DataFrame
    router: Router
    sizes: np.ndarray
    probes: int
    recall: float
    width: int


def nearest_in_block(queries: np.ndarray, vectors: np.ndarray, visited: np.ndarray, k: int) -> list[np.ndarray]:
    """Of each query the places of its ``k`` nearest among the vectors it may visit, and of all that tie
    with the last of them."""
    score = np.where(visited, queries @ vectors.T, -np.inf)
    # products of blocks may differ in their last digits
    slack = 1e-12 * np.abs(np.where(visited, score, 0)).max(1)
    least = np.partition(score, max(score.shape[1] - k, 0), axis=1)[:, max(score.shape[1] - k, 0)]
    return [np.flatnonzero((row >= bound) & (row > -np.inf)) for row, bound in zip(score, least - slack, strict=True)]


def _ranked(own_id, query, places, vectors, ids, k) -> list[tuple[int, float]]:
    """The ``k`` nearest (id, score) among the vectors at those places, without the query's own row."""
    exact = (vectors[places] * query).sum(1)
    order = np.lexsort((np.array([ids[p][0] for p in places]), -exact))
    out: list[tuple[int, float]] = []
    for at in order:
        score = float(exact[at])
        if len(out) >= k and score < out[k - 1][1]:
            break
        out += [(i, score) for i in ids[places[at]] if i != own_id]
        out = sorted(out, key=lambda x: (-x[1], x[0]))
    return out[:k]


def _sample(rows: DataFrame, n: int, most: int) -> list:
    """At most ``most`` of ``n`` rows, those with the smallest hash of their first id."""
    share = min(1.0, 2 * most / max(n, 1))
    top = 2 ** 63 - 1 if share == 1 else int(-2 ** 63 + share * 2 ** 64)
    key = F.xxhash64(F.col("ids")[0])
    return rows.where(key <= F.lit(top)).orderBy(key, F.col("ids")[0]).limit(most).collect()


def build_index(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20,
                recall: float = 0.95) -> Index | None:
    """Learn the parts on a sample and put every vector into its part. None if no vector takes part."""
    spark = rows.sparkSession
    valid = valid_vectors(rows, id_col, vector_col).distinct()
    # k + 1 ids of equal vectors are enough for any answer; the limit works before the shuffle
    few = valid.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("n") <= k + 1)
    distinct = written(few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids")), "vectors")
    total = distinct.count()
    if not total:
        return None
    picked = _sample(distinct, total, SAMPLE + TESTS)
    points = np.array([r["vector"] for r in picked])
    parts = min(max(math.isqrt(total), total // PART_SIZE), len(points) // SHOWN) if total >= LEAST_VECTORS else 1
    # the last of the sample test the index, and are not learned from
    tests = min(TESTS, max(len(points) // 16, LEAST_TESTS)) if parts > 1 else 0
    learn = points[:len(points) - tests]
    if parts == 1:
        router = Router([np.zeros((points.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)])
    else:
        graph = _graph(spark, learn)
        label = balanced_parts(graph, learn, parts)
        shares = np.zeros((len(learn), parts))
        np.add.at(shares, (np.repeat(np.arange(len(learn)), graph.shape[1]), label[graph].ravel()), 1.0)
        np.add.at(shares, (np.arange(len(learn)), label), 1.0)
        router = Router.learn(learn, shares / shares.sum(1, keepdims=True))
    shared = spark.sparkContext.broadcast(router)

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                part = shared.value.scores(matrix(batch.column(1))).argmax(1)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *batch.columns], ["part", "ids", "vector"])

    index = written(map_arrow(distinct.select("ids", "vector"), assign, "part int, ids array<bigint>, vector array<double>"), "index")
    sizes = np.zeros(parts, "int64")
    for row in index.groupBy("part").agg(F.count("*").alias("n")).collect():
        sizes[row["part"]] = row["n"]
    out = Index(index, router, sizes, parts, 1.0, points.shape[1])
    if parts > 1:
        _set_probes(out, points[len(points) - tests:], [r["ids"][0] for r in picked[len(points) - tests:]], k, recall)
    return out


def _graph(spark, points: np.ndarray) -> np.ndarray:
    """The ``DEGREE`` nearest others of every point (rows of a bounded sample), blocks of points in parallel."""
    shared = spark.sparkContext.broadcast(points)
    degree = min(DEGREE, len(points) - 1)

    def run(batches):
        for batch in batches:
            for block in batch.column(0).to_pylist():
                own = np.arange(block * 512, min(block * 512 + 512, len(shared.value)))
                score = shared.value[own] @ shared.value.T
                score[np.arange(len(own)), own] = -np.inf
                near = np.argpartition(-score, degree - 1, axis=1)[:, :degree]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), pa.array(list(near.astype("int32")), pa.list_(pa.int32()))], ["i", "near"])

    found = spark.range(-(-len(points) // 512)).repartition(8).mapInArrow(run, "i bigint, near array<int>").collect()
    out = np.empty((len(points), degree), "int64")
    for row in found:
        out[row["i"]] = row["near"]
    return out


def _set_probes(index: Index, tests: np.ndarray, own: list[int], k: int, wanted: float) -> None:
    """Find the true neighbours of the tests, whose ids are ``own``, by brute force, and how many parts must be visited for them."""
    spark = index.vectors.sparkSession
    shared = spark.sparkContext.broadcast(tests)
    ids = np.array(own)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, part = matrix(batch.column(1)), batch.column(0).to_numpy()
            first = batch.column(2).to_numpy()
            score = shared.value @ vectors.T
            # a test does not find itself
            score[ids[:, None] == first[None, :]] = -np.inf
            keep = np.argpartition(-score, min(k, len(vectors) - 1), axis=1)[:, :k]
            test = np.repeat(np.arange(len(score)), keep.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(test), pa.array(part[keep.ravel()]), pa.array(first[keep.ravel()]),
                 pa.array(score[test, keep.ravel()])], ["test", "part", "first", "score"])

    near = map_arrow(index.vectors.select("part", "vector", F.col("ids")[0].alias("first")),
                     run, "test bigint, part int, first bigint, score double")
    order = Window.partitionBy("test").orderBy(F.desc("score"), "first")
    near = near.where(F.col("score") > float("-inf")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).collect()
    visit = np.argsort(-index.router.scores(tests), axis=1, kind="stable")
    turn = np.empty_like(visit)
    np.put_along_axis(turn, visit, np.arange(visit.shape[1])[None, :], axis=1)
    needed = np.sort([turn[r["test"], r["part"]] + 1 for r in near])
    if len(needed):
        index.probes = int(needed[min(int(np.ceil(wanted * len(needed))) - 1, len(needed) - 1)])
        index.recall = float((needed <= index.probes).mean())


def search(index: Index | None, queries: DataFrame, k: int = 20, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for every query, nearest first.

    A query that is a row of the table (by its id) does not find itself.
    """
    spark = queries.sparkSession
    schema = "query_id bigint, vec_id bigint, score double"
    if index is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    asked = valid_vectors(queries, id_col, vector_col, index.width).distinct()
    router, sizes, probes = spark.sparkContext.broadcast(index.router), index.sizes, index.probes
    # small parts next to each other share a pack of one block
    pack, filled = np.zeros(len(sizes), "int64"), 0
    for part in range(1, len(sizes)):
        filled += sizes[part - 1]
        fits = filled + sizes[part] <= BLOCK
        pack[part] = pack[part - 1] + (not fits)
        filled = filled if fits else 0

    def route(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = matrix(batch.column(1))
            visit = np.argsort(-router.value.scores(vectors), axis=1, kind="stable")
            # go on until enough candidates are met
            met = np.cumsum(sizes[visit], axis=1)
            n = np.maximum(probes, np.minimum((met < 2 * (k + 1)).sum(1) + 1, len(sizes)))
            packs, rows, parts = [], [], []
            for row, (own, count) in enumerate(zip(visit, n, strict=True)):
                own = np.sort(own[:count])
                for name in np.unique(pack[own]):
                    packs.append(name)
                    rows.append(row)
                    parts.append(own[pack[own] == name].astype("int32"))
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(packs, pa.int32()), *taken.columns, pa.array(parts, pa.list_(pa.int32()))],
                ["pack", "id", "vector", "parts"])

    routed = written(map_arrow(asked, route, "pack int, id bigint, vector array<double>, parts array<int>"), "routed")
    asked_sizes = {r["pack"]: r["n"] for r in routed.groupBy("pack").agg(F.count("*").alias("n")).collect()}
    # at most as many rows as parts: the blocks of a pack, and of the queries routed there
    plan = F.broadcast(spark.createDataFrame(
        [(int(part), int(name), int(-(-sizes[pack == name].sum() // BLOCK)) or 1, -(-asked_sizes[name] // QUERY_BLOCK))
         for part, name in enumerate(pack) if name in asked_sizes],
        "part int, pack int, blocks int, query_blocks int"))
    base = index.vectors.join(plan, "part").select(
        "pack", F.pmod(F.xxhash64(F.col("ids")[0]), F.col("blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("query_block"), "part", "ids", "vector")
    asking = routed.join(plan.drop("part").distinct(), "pack").select(
        "pack", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("id"), F.col("query_blocks")).cast("int").alias("query_block"), "id", "vector", "parts")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            vectors, ids, part = matrix(left["vector"]), left["ids"].to_pylist(), left["part"].to_numpy()
            asked_ids, points, parts = right["id"].to_pylist(), matrix(right["vector"]), right["parts"].to_pylist()
            for start in range(0, len(points), 128):
                step = points[start:start + 128]
                allowed = np.zeros((len(step), len(sizes)), bool)
                for i, names in enumerate(parts[start:start + 128]):
                    allowed[i, names] = True
                for i, places in enumerate(nearest_in_block(step, vectors, allowed[:, part], k + 1)):
                    own = asked_ids[start + i]
                    out += [(own, *found) for found in _ranked(own, step[i], places, vectors, ids, k)]
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()),
                         "score": pa.array(columns[2], pa.float64())})

    keys = ["pack", "block", "query_block"]
    met = base.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(meet, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
