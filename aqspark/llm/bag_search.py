"""Ranked lexical search that scores every distinct bag of words once.

Only the terms of the items can score, so each document is reduced to the item terms it holds, their counts, and ``m``, the
quantity through which its length enters. Documents of which these are identical form one class: they have the same score for
every item. Classes are found by a hash and told apart by the counts themselves, are scored once, and are expanded into their members by
ascending id; more members than ranks asked for are never needed.

With N documents that have a term, L terms in all of them, n terms in a document, and df documents that hold a term:

    w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))        m = 100 - 90 + (90 * n * N) div L
    score = sum over the item's terms of w * ((1000000000 * tf) div (1000 * tf + 8 * m))

in 64-bit integers but for the logarithm. N, L and df are counted over all documents. Scores add up as doubles only where they are exact.

Items are taken in blocks of at most ``BLOCK_TERMS`` expected terms, and only the vocabulary of a block is broadcast; every block reads all
documents. Each task keeps the best documents per item of what it has seen, so what is ranked in the end is a few rows per item
and task. A large class is cut to its first members before any shuffle.

Null and empty texts have no terms and are found for no item. Ids are integers; documents without an id are ranked, after those with one.
Repeated rows are documents of their own. Rows with one item id are one item with the terms of all of them; items without terms or
hits return no rows, and so do empty tables. Other columns are not read, whatever their names. Texts are read whole, a long one in pieces.
"""

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aqspark.llm.batches import map_arrow, written

# item terms, with repeats over items, that one block is expected to hold
BLOCK_TERMS = 1 << 20
# bytes of a text that are split into terms at a time
PIECE = 1 << 20
# numbers that a step of scoring holds
STEP = 1 << 22

_KEPT = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
# separators become spaces, A-Z becomes a-z, bytes of other characters stay
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20 for b in range(256))


def terms_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text, piece after piece."""
    at, size = 0, len(text or b"")
    while at < size:
        end = at + PIECE
        if end < size:
            # a piece ends behind a separator
            while end < size and text[end] in _KEPT:
                end += 1
        yield text[at:end].translate(_BYTES).split()
        at = end


def _binary(batch: pa.RecordBatch, column: str) -> list:
    return batch.column(column).cast(pa.binary()).to_pylist()


def _lists(values: np.ndarray, sizes: list[int], kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct (item_id, term)."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [sorted(set(chain.from_iterable(terms_of(t)))) for t in _binary(batch, "text")]
            sizes = [len(f) for f in found]
            yield pa.record_batch([batch.column("item_id").take(pa.array(np.repeat(np.arange(len(sizes)), sizes))),
                                   pa.array(list(chain.from_iterable(found)), pa.binary())], ["item_id", "term"])

    rows = items.select(F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return map_arrow(rows, run, f"item_id {kind}, term binary").distinct()


def bags(docs: DataFrame, vocabulary, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n, terms, tfs) of every document; ``vocabulary`` is a broadcast dict of terms to numbers."""
    def run(batches):
        known = vocabulary.value
        for batch in batches:
            n, sizes, terms, tfs = [], [], [], []
            for text in _binary(batch, "text"):
                counts, total = Counter(), 0
                for words in terms_of(text):
                    counts.update(words)
                    total += len(words)
                held = sorted((known[w], counts[w]) for w in counts.keys() & known.keys())
                n.append(total)
                sizes.append(len(held))
                terms += [t for t, _ in held]
                tfs += [c for _, c in held]
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), _lists(terms, sizes, pa.int32()),
                                   _lists(tfs, sizes, pa.int64())], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, n long, terms array<int>, tfs array<long>")


def document_counts(vectors: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each of ``size`` terms, added up in every task before the shuffle."""
    def run(batches):
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        terms = np.flatnonzero(total)
        yield pa.record_batch([pa.array(terms, pa.int32()), pa.array(total[terms])], ["term", "df"])

    counts = np.zeros(size, dtype=np.int64)
    for term, df in map_arrow(vectors.select("terms"), run, "term int, df long").groupBy("term").agg(F.sum("df")).toLocalIterator():
        counts[term] = df
    return counts


def bag_classes(vectors: DataFrame, n_docs: int, n_terms: int, members: int) -> DataFrame:
    """(terms, tfs, m, members): one row per class of identical bags, with the first ids among it."""
    rows = vectors.where("size(terms) > 0").select(
        "doc_id", "terms", "tfs", F.expr(f"100 - 90 + (90L * n * {n_docs}L) div {n_terms}L").alias("m"))
    # the hash decides where a class is gathered, and mostly how it is sorted; the bag itself decides what belongs to it
    rows = rows.withColumn("print", F.xxhash64("terms", "tfs", "m"))
    same = ["print", "terms", "tfs", "m"]
    order = Window.partitionBy(*same).orderBy(F.asc_nulls_last("doc_id"))
    first = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= members)
    ids = F.transform(F.sort_array(F.collect_list(F.struct("place", "doc_id"))), lambda s: s["doc_id"])
    return first.groupBy(*same).agg(ids.alias("members")).drop("print")


class Best:
    """The ``k`` best documents per item among those seen."""

    def __init__(self, items: int, k: int):
        self.k = k
        # a document below this score cannot be among an item's best
        self.least = np.ones(items, dtype=np.int64)
        self.rows = [np.empty(0, dtype=np.int64)] * 4

    def add(self, item, score, missing, doc):
        rows = [np.concatenate(p) for p in zip(self.rows, (item, score, missing, doc), strict=True)]
        item, score, missing, doc = (x[np.lexsort((rows[3], rows[2], -rows[1], rows[0]))] for x in rows)
        starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]][:len(item)])
        place = np.arange(len(item)) - np.repeat(starts, np.diff(np.r_[starts, len(item)]))
        last = place == self.k - 1
        self.least[item[last]] = score[last]
        self.rows = [x[place < self.k] for x in (item, score, missing, doc)]


def score_classes(classes: DataFrame, model, k: int) -> DataFrame:
    """(item, doc_id, score): every task's best documents of each item.

    ``model`` is a broadcast (weights, starts, postings, items): the weight of each term, and the items that hold it.
    """
    def run(batches):
        weights, starts, postings, items = model.value
        best = Best(items, k)
        for batch in batches:
            _score(batch, weights, starts, postings, best)
        item, score, missing, doc = best.rows
        yield pa.record_batch([pa.array(item, pa.int32()), pa.array(doc, pa.int64(), mask=missing.astype(bool)),
                               pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return map_arrow(classes, run, "item int, doc_id long, score long")


def _flat(batch, column):
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())


def _score(batch, weights, starts, postings, best):
    terms, sizes = _flat(batch, "terms")
    tfs = batch.column("tfs").flatten().to_numpy()
    m = batch.column("m").to_numpy()
    ids = batch.column("members").flatten()
    heads = batch.column("members").offsets.to_numpy() - batch.column("members").offsets[0].as_py()
    missing = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
    ids = ids.fill_null(0).to_numpy()
    row = np.repeat(np.arange(batch.num_rows), sizes)
    value = weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 8 * m[row]))
    fan = starts[terms + 1] - starts[terms]
    # classes are scored in steps of bounded size, at least one class each
    work = np.maximum(np.bincount(row, weights=fan, minlength=batch.num_rows), len(best.least))
    step = (np.cumsum(work) // STEP).astype(np.int64)
    for s in np.unique(step):
        chosen = np.flatnonzero(step == s)
        a, z = chosen[0], chosen[-1] + 1
        lo, hi = np.searchsorted(row, [a, z])
        own = fan[lo:hi]
        at = np.repeat(starts[terms[lo:hi]] - np.r_[0, np.cumsum(own)[:-1]], own) + np.arange(own.sum()) if hi > lo else np.empty(0, int)
        cell = np.repeat(row[lo:hi] - a, own) * len(best.least) + postings[at]
        scores = _summed(cell, np.repeat(value[lo:hi], own), (z - a) * len(best.least)).reshape(z - a, -1)
        if z - a >= best.k:
            # every class has a document, so the k-th best class bounds what can be among the best
            best.least = np.maximum(best.least, np.partition(scores, z - a - best.k, axis=0)[z - a - best.k])
        which, item = np.nonzero(scores >= best.least)
        count = heads[a + which + 1] - heads[a + which]
        member = np.repeat(heads[a + which] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum()) if len(which) else which
        best.add(np.repeat(item, count), np.repeat(scores[which, item], count), missing[member], ids[member])


def _summed(cell, value, cells):
    """Sums of 64-bit numbers per cell, by halves where a double could not hold them."""
    if not len(cell):
        return np.zeros(cells, dtype=np.int64)
    if float(value.max()) * len(cell) < 2 ** 53:
        return np.bincount(cell, weights=value, minlength=cells).astype(np.int64)
    high = np.bincount(cell, weights=value >> 20, minlength=cells).astype(np.int64)
    return (high << 20) + np.bincount(cell, weights=value & ((1 << 20) - 1), minlength=cells).astype(np.int64)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col="doc_id", text_col="text", item_col="item_id",
                   item_text_col="text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item."""
    spark = docs.sparkSession
    pairs = written(item_terms(items, item_col, item_text_col), "item-terms")
    blocks = -(-pairs.count() // block_terms)
    kind = items.schema[item_col].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else pairs
        found = _rank_block(docs, own, kind, k, id_col, text_col)
        out = out if found is None else out.unionByName(found)
    return out


def _rank_block(docs, pairs, kind, k, id_col, text_col):
    spark = docs.sparkSession
    held: dict = {}
    for item, term in pairs.toLocalIterator():
        held.setdefault(item, []).append(bytes(term))
    ids = list(held)
    known = {t: i for i, t in enumerate(sorted(set(chain.from_iterable(held.values()))))}
    vocabulary = spark.sparkContext.broadcast(known)
    vectors = written(bags(docs, vocabulary, id_col, text_col), "bags")
    vocabulary.destroy()
    n_docs, n_terms = vectors.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    if not n_docs or not ids:
        return None
    df = document_counts(vectors, len(known))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
    term, item = np.array(sorted((known[t], i) for i, x in enumerate(ids) for t in held[x]), dtype=np.int64).T
    starts = np.searchsorted(term, np.arange(len(known) + 1))
    model = spark.sparkContext.broadcast((weights, starts, item, len(ids)))
    scored = written(score_classes(bag_classes(vectors, n_docs, n_terms, k), model, k), "bag-scores")
    model.destroy()
    names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {kind}")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # a block names as many items as its terms allow
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
