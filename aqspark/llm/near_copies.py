"""Near copies by consistent weighted sampling.

Texts are sets of five-word shingles weighted by TF-IDF. Improved consistent weighted sampling draws samples that
two sets share with the probability of their weighted Jaccard similarity; bands of samples bring likely
pairs together, and each pair is verified by the weighted Jaccard similarity of the whole texts.
Documents linked by pairs of ``similarity`` or more form a class.

The inverse document frequency lies between 1 (a shingle of every text) and 1.2 (of one): boilerplate counts
less, but the few words in which copies differ do not outweigh what they share, and a similarity means nearly
what it means without weights. Frequencies come from all documents,
in a table of hash buckets of fixed size.

No bucket is expanded into all its pairs. Copies with one text are one node. In every bucket all
nodes are compared with one leader; where that leaves several components, small buckets compare nodes of
different components, and large ones compare the rest with the nodes of the largest component that are nearest
to its leader. What still is apart in a large bucket is compared in blocks inside tasks, which give out links only.

Words are runs of digits, a-z and characters beyond ASCII, after lower-casing. A text of one to four words has one
shingle. Null texts and texts without a word are in no group: each is a class of its own. The class is named by its smallest id; null ids take part, and
a class of null ids alone has a null name. Repeated rows belong to one class. Only the named columns are read by ``near_classes``;
``without_near_copies`` keeps all columns, and working columns avoid their names.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aqspark.llm.batches import fresh, map_arrow, text_steps, written
from aqspark.llm.components import connected_components
from aqspark.llm.shingles import (
    BUCKETS, ConsistentSampler, band_hashes, buckets, shingle_sets, weighted_jaccard)

SAMPLES = 64
BAND = 4
# nodes of a bucket whose components are compared node by node at once
SMALL = 32
# nodes of a large component that the rest of a large bucket is compared with
PIVOTS = 4
# keys of texts that may be broadcast: 16 bytes each
BROADCAST_KEYS = 200_000
# texts that one leader is compared with in one group of rows, or that meet as one side of a block
BLOCK = 128


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def _lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text.cast("string"), F.lit("")))


def shingle_weights(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Inverse document frequency per hash bucket, from all documents: 1 + 0.2 (1 - ln(df) / ln(N)), at least 1."""
    def run(batches):
        seen, n = np.zeros(BUCKETS, "int64"), 0
        for batch in batches:
            for _, texts in text_steps(batch, "__low"):
                hashes, _, sizes = shingle_sets([t.encode() for t in texts])
                owner = np.repeat(np.arange(len(sizes)), sizes)
                # a document counts once in a bucket
                pairs = np.unique(owner * BUCKETS + buckets(hashes))
                seen += np.bincount(pairs % BUCKETS, minlength=BUCKETS)
                n += len(texts)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[-1, at]), pa.array(np.r_[n, seen[at]])], ["bucket", "n"])

    rows = map_arrow(docs.select(_lowered(F.col(text_col)).alias("__low")), run, "bucket bigint, n bigint", trim=True)
    counts = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = max(int(counts.loc[counts["bucket"] < 0, "n"].sum()), 2)
    out = np.zeros(BUCKETS)
    real = counts[counts["bucket"] >= 0]
    out[real["bucket"].to_numpy("int64")] = np.log(real["n"].to_numpy(float))
    return np.maximum(1 + 0.2 * (1 - out / np.log(total)), 1).astype("float32")


def sketches(docs: DataFrame, weights, text_col: str = "text") -> DataFrame:
    """(node, text_key, total, bands): one row per distinct text that has a word."""
    source = docs.select(text_key(F.col(text_col)).alias("text_key"), _lowered(F.col(text_col)).alias("__low"))

    def run(batches):
        own, sampler = weights.value, ConsistentSampler(SAMPLES)
        for batch in batches:
            for part, texts in text_steps(batch, "__low"):
                hashes, often, n = shingle_sets([t.encode() for t in texts])
                if not len(hashes):
                    continue
                weight = often * own[buckets(hashes)].astype("float64")
                bands = band_hashes(sampler.samples(hashes, weight, n), BAND).view("int64")
                total = np.add.reduceat(weight, (np.cumsum(n) - n)[n > 0])
                offsets = np.arange(len(bands) + 1, dtype="int32") * bands.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).filter(pa.array(n > 0)), pa.array(total),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.ravel()))],
                    ["text_key", "total", "bands"])

    found = map_arrow(source, run, "text_key binary, total double, bands array<bigint>", trim=True)
    found = found.groupBy("text_key").agg(F.first("total").alias("total"), F.first("bands").alias("bands"))
    return written(found.select(F.monotonically_increasing_id().alias("node"), "text_key", "total", "bands"), "sketches")


def verified(pairs: DataFrame, texts: DataFrame, weights) -> DataFrame:
    """(a, b, similarity) of pairs (a, b) of nodes, given the texts (node, low).

    Texts go to the task of the other node of the pair; a node with many partners is split into blocks.
    """
    partners = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    partners = written(partners, "partners")
    members = (pairs.join(partners, "a")
               .select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), F.col("b").alias("node")))
    leaders = partners.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                              F.col("a").alias("node"))
    rows = members.union(leaders).join(texts, "node")
    rows = (rows.select("a", "block", "node", "low").repartition("a", "block")
            .sortWithinPartitions("a", "block", F.col("node") != F.col("a")))

    def run(batches):
        own = weights.value
        leader, known, weight = None, None, None
        for batch in batches:
            for part, texts in text_steps(batch, "low"):
                hashes, often, n = shingle_sets([t.encode() for t in texts])
                heavy = often * own[buckets(hashes)].astype("float64")
                ends = np.cumsum(n)
                left, right, same = [], [], []
                for a, node, size, end in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), n, ends, strict=True):
                    own_part = slice(end - size, end)
                    if a == node:
                        leader, known, weight = a, hashes[own_part].copy(), heavy[own_part].copy()
                        continue
                    assert a == leader
                    left.append(a)
                    right.append(node)
                    same.append(weighted_jaccard(known, weight, hashes[own_part], heavy[own_part]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(same, pa.float64())],
                    ["a", "b", "similarity"])

    return written(map_arrow(rows, run, "a bigint, b bigint, similarity double", trim=True), "verified")


def block_links(left: list, right: list, weights: np.ndarray, least: float) -> pa.RecordBatch:
    """(a, b, similarity) of the links between two blocks of (node, label, text) with different labels."""
    out: list[tuple[int, int, float]] = []
    if left and right:
        sides = []
        for block in (left, right):
            hashes, often, n = shingle_sets([text for _, _, text in block])
            weight = weights[buckets(hashes)].astype("float64")
            total = np.bincount(np.repeat(np.arange(len(n)), n), often * weight, minlength=len(n))
            # a shingle that occurs k times stands as k elements, so common weights are sums
            which = np.repeat(np.arange(len(hashes)), often)
            turn = np.arange(len(which)) - np.repeat(np.cumsum(often) - often, often)
            element = hashes[which] ^ (turn.astype("uint64") * np.uint64(0x9E3779B97F4A7C15))
            sides.append((element, weight[which], np.repeat(np.arange(len(n)), n)[which], total))
        (element, weight, row, total), (other, _, column, other_total) = sides
        shared, first = np.unique(element, return_index=True)
        shared_weight = weight[first]
        both = np.isin(shared, other)
        shared, shared_weight = shared[both], shared_weight[both]
        common = np.zeros((len(left), len(right)))
        for start in range(0, len(shared), 4096):
            part, part_weight = shared[start:start + 4096], shared_weight[start:start + 4096]
            a, b = (np.zeros((len(block), len(part)), "float32") for block in (left, right))
            for matrix, elements, owner in ((a, element, row), (b, other, column)):
                at = np.searchsorted(part, elements)
                at[at == len(part)] = 0
                hit = part[at] == elements
                matrix[owner[hit], at[hit]] = 1
            common += (a * part_weight.astype("float32")) @ b.T
        similarity = common / np.maximum(total[:, None] + other_total[None, :] - common, 1e-9)
        for i, j in zip(*np.nonzero(similarity >= least - 1e-5), strict=True):
            (node, label, text), (partner, other_label, other_text) = left[i], right[j]
            if label != other_label:
                hashes, often, n = shingle_sets([text, other_text])
                heavy = often * weights[buckets(hashes)].astype("float64")
                exact = weighted_jaccard(hashes[:n[0]], heavy[:n[0]], hashes[n[0]:], heavy[n[0]:])
                if exact >= least:
                    out.append((min(node, partner), max(node, partner), exact))
    columns = list(zip(*out, strict=True)) if out else [[], [], []]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
        ["a", "b", "similarity"])


class _Search:
    """Pairs tested so far, and the components they make."""

    def __init__(self, docs, nodes, weights, similarity, text_col):
        self.docs, self.nodes, self.weights = docs, nodes, weights
        self.similarity, self.text_col = similarity, text_col
        self.tested: list[DataFrame] = []
        self.labels: DataFrame | None = None

    def try_pairs(self, pairs: DataFrame) -> None:
        """Verify pairs (a, b, total_a, total_b) that may reach the threshold and were not tested."""
        # the lighter set's weight bounds what both have in common
        fair = F.least("total_a", "total_b") >= F.lit(self.similarity) * F.greatest("total_a", "total_b")
        pairs = pairs.where(fair).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        for done in self.tested:
            pairs = pairs.join(done.select("a", "b"), ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        if pairs.isEmpty():
            return
        texts = self.texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")))
        self.tested.append(verified(pairs, texts, self.weights))
        self.labels = written(connected_components(self.links()), "labels")

    def texts_of(self, nodes: DataFrame) -> DataFrame:
        """(node, low): the texts of some nodes, each read once."""
        wanted = written(self.nodes.select("node", "text_key").join(nodes.select("node").distinct(), "node"), "wanted")
        texts = self.docs.select(text_key(F.col(self.text_col)).alias("text_key"), _lowered(F.col(self.text_col)).alias("low"))
        # copies of a text meet only after each task has kept one of them
        if wanted.count() <= BROADCAST_KEYS:
            texts = texts.join(F.broadcast(wanted.select("text_key")), "text_key", "left_semi")
        texts = texts.groupBy("text_key").agg(F.first("low").alias("low"))
        return written(texts.join(wanted, "text_key").select("node", "low"), "pair-texts")

    def compare_blocks(self, members: DataFrame) -> None:
        """Link what is still apart in large buckets (bucket, node, label, size): every node outside the
        largest component is compared with all nodes of its bucket.

        Nodes meet in blocks, whose similarities one task computes as products of matrices; only
        links leave the task.
        """
        sizes = members.groupBy("bucket", "label").agg(F.count("*").alias("n"))
        largest = sizes.groupBy("bucket").agg(
            F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"))
        n_blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
        plan = largest.select("bucket", "main", n_blocks(F.col("n") - F.col("most")).alias("rows"), n_blocks(F.col("n")).alias("columns"))
        dealt = members.select("bucket", "node", "label").join(plan, "bucket")
        own = F.xxhash64("node", "bucket")
        rest = dealt.where("label <> main").select(
            "bucket", "node", "label", F.lit(0).alias("side"), F.pmod(own, F.col("rows")).cast("int").alias("r"),
            F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("c"))
        every = dealt.select(
            "bucket", "node", "label", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r"),
            F.pmod(own, F.col("columns")).cast("int").alias("c"))
        keys = ["bucket", "r", "c"]
        rows = rest.union(every.select(rest.columns)).join(self.texts_of(members), "node")
        rows = rows.select(*keys, "side", "node", "label", "low").repartition(*keys).sortWithinPartitions(*keys, "side")
        weights, least = self.weights, self.similarity

        def run(batches):
            key, left, right = None, [], []
            for row in (r for batch in batches for part, _ in text_steps(batch, "low") for r in part.to_pylist()):
                now = (row["bucket"], row["r"], row["c"])
                if now != key:
                    yield block_links(left, right, weights.value, least)
                    key, left, right = now, [], []
                (right if row["side"] else left).append((row["node"], row["label"], row["low"].encode()))
            yield block_links(left, right, weights.value, least)

        found = written(map_arrow(rows, run, "a bigint, b bigint, similarity double", trim=True), "block-links")
        self.tested.append(found.distinct())
        self.labels = written(connected_components(self.links()), "labels")

    def links(self) -> DataFrame:
        return reduce(DataFrame.union, self.tested).where(F.col("similarity") >= self.similarity).select("a", "b")

    def mixed_buckets(self, members: DataFrame) -> DataFrame:
        """(bucket, node, total, label, size): the members (bucket, node, total) of buckets that hold several components."""
        if self.labels is not None:
            members = members.join(self.labels, "node", "left")
            members = members.withColumn("label", F.coalesce("label", "node"))
        else:
            members = members.withColumn("label", F.col("node"))
        held = members.groupBy("bucket").agg(
            F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
        return members.join(held.select("bucket", "size"), "bucket")


def _across(members: DataFrame) -> DataFrame:
    """Pairs of nodes in one bucket that are in different components."""
    a = members.select("bucket", F.col("node").alias("a"), F.col("label").alias("la"), F.col("total").alias("total_a"))
    b = members.select("bucket", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("total").alias("total_b"))
    return a.join(b, "bucket").where("a < b AND la <> lb")


def _nearest_members(members: DataFrame, tested: DataFrame) -> DataFrame:
    """(bucket, node, total, label): up to ``PIVOTS`` nodes of each bucket's largest component, those most similar to what
    they were compared with first."""
    sizes = members.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("label"))
    near = tested.groupBy(F.col("b").alias("node")).agg(F.max("similarity").alias("near"))
    own = members.join(largest, ["bucket", "label"]).join(near, "node", "left")
    # the best few per bucket: first of every 64 slots, so that no task ranks a whole component
    slot = F.pmod(F.xxhash64("node"), F.lit(64))
    order = F.struct(F.coalesce("near", F.lit(0.0)).alias("near"), F.col("node"), F.col("total"), F.col("label"))
    best = own.groupBy("bucket", slot.alias("slot")).agg(F.max(order).alias("m"))
    best = best.groupBy("bucket").agg(F.slice(F.reverse(F.array_sort(F.collect_list("m"))), 1, PIVOTS).alias("ms"))
    return best.select("bucket", F.inline("ms")).drop("near")


def near_links(docs: DataFrame, similarity: float = 0.8, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(nodes, labels): the distinct texts (node, text_key, ...), and the component of every node that has a link."""
    spark = docs.sparkSession
    weights = spark.sparkContext.broadcast(shingle_weights(docs, text_col))
    nodes = sketches(docs, weights, text_col)
    search = _Search(docs, nodes, weights, similarity, text_col)
    members = nodes.select("node", "total", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct("node", "total")).alias("lead"))
    shared = shared.where("n > 1")
    members = written(members.join(shared, "bucket"), "members")
    search.try_pairs(members.where("node <> lead.node").select(
        F.col("lead.node").alias("a"), F.col("lead.total").alias("total_a"),
        F.col("node").alias("b"), F.col("total").alias("total_b")))
    members = members.select("bucket", "node", "total")

    apart = written(search.mixed_buckets(members), "apart")
    large = apart.where(F.col("size") > SMALL)
    pairs = _across(apart.where(F.col("size") <= SMALL)).select("a", "b", "total_a", "total_b")
    if search.tested:
        pivots = _nearest_members(large, reduce(DataFrame.union, search.tested)).select(
            "bucket", F.col("node").alias("a"), F.col("total").alias("total_a"), F.col("label").alias("la"))
        others = large.select("bucket", F.col("node").alias("b"), F.col("total").alias("total_b"), "label")
        pairs = pairs.union(others.join(pivots, "bucket").where("label <> la").select("a", "b", "total_a", "total_b"))
    search.try_pairs(pairs)

    apart = written(search.mixed_buckets(large.select("bucket", "node", "total")), "apart")
    if not apart.isEmpty():
        search.compare_blocks(apart)
    labels = search.labels
    if labels is None:
        labels = nodes.select("node", F.col("node").alias("label")).where("false")
    return nodes, labels


def _classes(rows: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``group`` to rows with a ``text_key``: the component of the text, null for texts without a word."""
    of_text = nodes.join(labels, "node", "left").select("text_key", F.coalesce("label", "node").alias("group"))
    return rows.join(of_text, "text_key", "left")


def near_classes(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, class_size) of every row: the smallest id of its class of near copies and the number of its rows."""
    nodes, labels = near_links(docs, similarity, text_col)
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("text_key"))
    rows = written(_classes(rows, nodes, labels), "classed")
    named = rows.where("group IS NOT NULL").groupBy("group").agg(
        F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    alone = rows.where("group IS NULL").select(F.col("id").alias(id_col), F.col("id").alias("class_id"),
                                               F.lit(1).cast("bigint").alias("class_size"))
    return rows.join(named, "group").select(F.col("id").alias(id_col), "class_id", "class_size").union(alone)


def without_near_copies(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every class, that of the smallest id (a null id comes last); all columns are kept."""
    nodes, labels = near_links(docs, similarity, text_col)
    row, n = fresh(docs, "row_key", "row_count")

    def row_key(id_column, key):
        return F.md5(F.concat(F.coalesce(id_column.cast("string"), F.lit("null")).cast("binary"), key))

    key = text_key(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("text_key"))
    rows = _classes(rows, nodes, labels).groupBy("id", "text_key", "group").agg(F.count("*").alias("n"))
    rows = written(rows, "classed")
    first = rows.where("group IS NOT NULL").groupBy("group").agg(
        F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("text_key"), F.col("n"))).alias("m")).select("m.id", "m.text_key", "m.n")
    # texts without a word are classes of their own: all their rows stay
    keep = first.union(rows.where("group IS NULL").select("id", "text_key", F.lit(1).cast("bigint")))
    keep = keep.select(row_key(F.col("id"), F.col("text_key")).alias(row), F.col("n").alias(n))
    found = docs.withColumn(row, row_key(F.col(id_col), key)).join(keep, row)
    once = found.where(F.col(n) == 1)
    # rows with one id and one text are repeated: only these few are gathered
    again = found.where(F.col(n) > 1).dropDuplicates([row])
    return once.select(docs.columns).union(again.select(docs.columns))
