"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score over its words and their
beginnings; the document is toxic unless every sentence is not (noisy-or). The weights are fitted by
the documents' labels alone, and then point at the sentences that make a document toxic.

Sentences end at ``. ! ?`` (also full-width) and line breaks; more than 64 words without an end make
several instances. The whole text counts. Null and empty texts, and texts without a word, score
0. Repeated rows give repeated results. Rows without a text or label teach nothing; with no labelled rows every
score is 0. Only the named columns are read, so other columns cannot clash.
"""

import re
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aqspark.llm.batches import map_arrow, text_steps

TOKEN = re.compile(r"[^\W\d_]+|[.!?。！？\n]+")
FEATURES = 1 << 18
LONGEST = 64
# words whose weight a worker remembers; a full memory is emptied, which changes no result
MEMORY = 1 << 19


@dataclass
class Model:
    bias: float
    weights: np.ndarray


def word_features(word: str) -> list[int]:
    """The word itself and its beginnings of 4, 5 and 6 letters, hashed."""
    parts = [f"={word}"] + [word[:n] for n in (4, 5, 6) if len(word) >= n]
    return [zlib.crc32(p.encode()) % FEATURES for p in parts]


def is_end(token: str) -> bool:
    return not token[0].isalpha()


def instances(ends: np.ndarray) -> np.ndarray:
    """First token of every instance, given which tokens end a sentence."""
    n = len(ends)
    opens = np.r_[True, ends[:-1]] if n else np.empty(0, bool)
    first = np.maximum.accumulate(np.where(opens, np.arange(n), 0)) if n else opens
    return np.flatnonzero(opens | ((np.arange(n) - first) % LONGEST == 0))


def softplus(z):
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def surprise(toxic_docs, clean_docs, n_toxic, n_clean):
    """Log-likelihood ratio (G squared) of features that toxic documents hold more often, else 0."""
    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-300) / np.maximum(expected, 1e-300)), 0.0)
    n = n_toxic + n_clean
    seen = toxic_docs + clean_docs
    g = 2 * (part(toxic_docs, seen * n_toxic / n) + part(clean_docs, seen * n_clean / n)
             + part(n_toxic - toxic_docs, (n - seen) * n_toxic / n)
             + part(n_clean - clean_docs, (n - seen) * n_clean / n))
    return np.where(toxic_docs * n_clean > clean_docs * n_toxic, g, 0.0)


def _spread(numbers, feature, begin):
    """Features of words given by number, and which of the words each belongs to."""
    begin, feature = np.frombuffer(begin, "int32"), np.frombuffer(feature, "int32")
    n = begin[numbers + 1] - begin[numbers]
    which = np.repeat(np.arange(len(numbers)), n)
    return feature[begin[numbers][which] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)], which


def fit(texts: list[str], labels: list[int], rounds: int = 400, evidence: float = 12.0,
        rate: float = 0.1, shrink: float = 5e-5, emphasis: float = 3.0) -> Model:
    """Full-batch fit of the noisy-or likelihood.

    Only features take part whose documents are toxic more often than chance explains (``evidence`` is a
    likelihood ratio), so that no document is learned by heart; ``shrink`` pulls to exact zeros those
    that others make needless. Toxic documents, being few, count ``emphasis`` times. Both numbers were chosen by leaving out
    thirds of the teaching rows: the most found with fewer than 1 % of clean documents flagged.
    """
    weights = np.zeros(FEATURES)
    label = np.asarray(labels, "int64")
    n_toxic = int(label.sum())
    # features of word number w: feature[begin[w]:begin[w + 1]]
    words: dict[str, int] = {}
    feature, begin = array("i"), array("i", [0])
    docs, seen = [], np.zeros((2, FEATURES), "int32")
    for text, toxic in zip(texts, label, strict=True):
        numbers = array("i")
        for token in TOKEN.findall(text.lower()):
            if is_end(token):
                numbers.append(-1)
                continue
            number = words.setdefault(token, len(words))
            if number == len(begin) - 1:
                feature.extend(word_features(token))
                begin.append(len(feature))
            numbers.append(number)
        docs.append(np.array([*numbers, -1], "int32"))
        own, _ = _spread(np.unique(docs[-1][docs[-1] >= 0]), feature, begin)
        seen[toxic, np.unique(own)] += 1
    if not words or not 0 < n_toxic < len(label):
        return Model(20.0 if words and n_toxic else -20.0, weights)
    useful = surprise(seen[1].astype(float), seen[0].astype(float), n_toxic, len(label) - n_toxic) >= evidence

    # where useful features occur: few places, so that a round is cheap
    found, where, held, doc_of = [], [], [], []
    total = 0
    for doc, numbers in enumerate(docs):
        starts = instances(numbers < 0)
        held.append(np.add.reduceat(numbers >= 0, starts, dtype="int64") > 0)
        doc_of.append(np.full(len(starts), doc))
        at = np.flatnonzero(numbers >= 0)
        own, which = _spread(numbers[at], feature, begin)
        which = which[useful[own]]
        found.append(own[useful[own]])
        where.append(total + np.searchsorted(starts, at[which], side="right") - 1)
        total += len(starts)
    held, doc_of, where = np.concatenate(held), np.concatenate(doc_of), np.concatenate(where)
    kept, found = np.unique(np.concatenate(found), return_inverse=True)

    theta, m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    theta[-1] = -4.0
    for step in range(1, rounds + 1):
        z = np.where(held, theta[-1] + np.bincount(where, theta[found], minlength=total), -40.0)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        clean = np.bincount(doc_of, softplus(z), minlength=len(texts))
        toxic = np.clip(-np.expm1(-clean), 1e-12, 1)
        # slope of the loss by every sentence's z
        slope = np.where(label[doc_of] > 0, -emphasis * p * np.exp(-clean[doc_of]) / toxic[doc_of], p) / len(texts)
        grad = np.append(np.bincount(found, slope[where], minlength=len(kept)), slope.sum())
        grad[:-1] += shrink * np.sign(theta[:-1])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        theta -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
    theta[:-1] = np.where(np.abs(theta[:-1]) < 2 * rate, 0, theta[:-1])
    weights[kept] = theta[:-1]
    return Model(float(theta[-1]), weights)


class Scorer:
    """Scores of documents and of their sentences."""

    def __init__(self, model: Model):
        class Memory(dict):
            def __missing__(self, token):
                value = np.nan if is_end(token) else float(model.weights[word_features(token)].sum())
                self[token] = value
                return value

        self.bias, self.memory = model.bias, Memory()

    def sentences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each instance its document, its first token in that document, and its score z."""
        if len(self.memory) > MEMORY:
            self.memory.clear()
        tokens = [TOKEN.findall(t) for t in texts]
        sizes = np.fromiter(map(len, tokens), "int64", len(tokens)) + 1
        values = np.empty(sizes.sum())
        at = 0
        for line, n in zip(tokens, sizes, strict=True):
            values[at:at + n - 1] = np.fromiter(map(self.memory.__getitem__, line), float, n - 1)
            at += n
        values[np.cumsum(sizes) - 1] = np.nan
        ends = np.isnan(values)
        values[ends] = 0.0
        starts = instances(ends)
        if not len(starts):
            return np.empty(0, "int64"), starts, np.empty(0)
        # instances that hold a sentence end alone say nothing
        held = np.add.reduceat(~ends, starts, dtype="int64") > 0
        z = self.bias + np.add.reduceat(values, starts)
        doc = np.searchsorted(np.cumsum(sizes), starts, side="right")
        first = starts - (np.cumsum(sizes) - sizes)[doc]
        return doc[held], first[held], z[held]

    def score(self, texts: list[str]) -> np.ndarray:
        doc, _, z = self.sentences(texts)
        return -np.expm1(-np.bincount(doc, softplus(z), minlength=len(texts)))

    def offending(self, text: str, least: float) -> list[dict]:
        """Spans (code points) of the sentences that score ``least`` or more."""
        _, first, z = self.sentences([text])
        spans = [m.span() for m in TOKEN.finditer(text)]
        nexts = np.r_[first[1:], len(spans)]
        return [{"start": spans[a][0], "stop": spans[min(b, len(spans)) - 1][1], "score": float(1 / (1 + np.exp(-s)))}
                for a, b, s in zip(first, nexts, z, strict=True) if s >= np.log(least / (1 - least))]


def learn_toxicity(labelled: DataFrame, max_docs: int = 5000, max_bytes: int = 16_000_000,
                   text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on a bounded sample: whole texts in the order of a hash, at most ``max_docs`` distinct ones
    with ``max_bytes`` bytes together. A text that is labelled both ways counts as toxic."""
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("int").alias("label"))
    rows = rows.where("text IS NOT NULL AND label IS NOT NULL").withColumn("key", F.xxhash64("text"))
    sizes = rows.groupBy("key").agg(F.max(F.octet_length("text")).alias("size"), F.max("label").alias("label"))
    total = rows.count()
    # hashes are spread evenly: this share holds about twice the rows that are wanted
    share = min(1.0, 2 * max_docs / max(total, 1))
    top = int(-2 ** 63 + share * (2 ** 64 - 1)) if share < 1 else 2 ** 63 - 1
    picked, used = {}, 0
    for row in sizes.where(F.col("key") <= F.lit(top)).orderBy("key").limit(max_docs).collect():
        if used + row["size"] <= max_bytes:
            picked[row["key"]] = row["label"]
            used += row["size"]
    if not picked:
        return fit([], [])
    last = max(picked)
    texts = rows.where(F.col("key") <= F.lit(last)).groupBy("key").agg(F.first("text").alias("text"))
    texts = {r["key"]: r["text"] for r in texts.join(
        F.broadcast(labelled.sparkSession.createDataFrame([(k,) for k in picked], "key bigint")), "key").collect()}
    order = sorted(texts)
    return fit([texts[k] for k in order], [picked[k] for k in order])


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.3, sentence_threshold: float = 0.3,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted, offending): the score of every row, whether it reaches the
    threshold, and then the spans of the sentences at fault."""
    source = docs.select(F.col(id_col), F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("__low"))
    kind = source.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        own = Scorer(shared.value)
        for batch in batches:
            for part, texts in text_steps(batch, "__low"):
                scores = own.score(texts)
                spans = [own.offending(t, sentence_threshold) if s >= threshold else []
                         for t, s in zip(texts, scores, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(scores, pa.float64()),
                     pa.array((scores >= threshold).astype("int32")), pa.array(spans, span)],
                    [id_col, "score", "predicted", "offending"])

    return map_arrow(source, run, f"`{id_col}` {kind}, score double, predicted int, "
                             "offending array<struct<start:int,stop:int,score:double>>")
