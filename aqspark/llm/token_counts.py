"""Token counts by rank-synchronous merging of many pre-tokens at once.

The pre-tokens of a step lie in one ragged array of symbols. Each round finds the pair of the
lowest rank in every pre-token, merges all its occurrences there at the same time, and goes on
with the pre-tokens that still have a pair. What survives are the tokens. Merging all occurrences
at once equals merging them one by one, because a pair that holds the new symbol has a later rank.

The vocabulary file gives normalisation (NFC, white space to one space, lower case), the pattern,
the end-of-word mark and the special tokens; special strings inside a text count as one token each.

Null and empty texts have 0 bytes and 0 tokens. Texts of any length are counted whole. Repeated rows
give repeated results. Only the id and the text column are read, so other columns cannot clash.
"""

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aqspark.llm.batches import map_arrow, text_steps
from aqspark.llm.byte_codec import byte_characters

# pre-tokens whose counts a worker remembers; a full memory is emptied, which changes no result
MEMORY = 1 << 18
NO_RANK = np.iinfo(np.int32).max


class PairTable:
    """(left, right) → (rank, merged symbol) in an open-addressing table of numpy arrays."""

    def __init__(self, left, right, merged):
        keys = (np.asarray(left, "uint64") << np.uint64(32)) | np.asarray(right, "uint64")
        self.bits = max(8, int(len(keys)).bit_length() + 3)
        size = 1 << self.bits
        self.keys = np.full(size, np.iinfo(np.uint64).max, "uint64")
        self.ranks = np.full(size, NO_RANK, "int32")
        self.merged = np.zeros(size, "int32")
        waiting, slot = np.arange(len(keys)), self._slot(keys)
        while len(waiting):
            empty = self.keys[slot[waiting]] == np.iinfo(np.uint64).max
            first = np.unique(np.where(empty, slot[waiting], -1), return_index=True)
            take = waiting[first[1][first[0] >= 0]]
            self.keys[slot[take]], self.ranks[slot[take]] = keys[take], take
            self.merged[slot[take]] = np.asarray(merged, "int32")[take]
            waiting = np.setdiff1d(waiting, take)
            slot[waiting] = (slot[waiting] + 1) % size

    def _slot(self, keys):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype("int64")

    def find(self, left, right):
        """The ranks (``NO_RANK`` where the pair never merges) and merged symbols of pairs."""
        keys = (left.astype("uint64") << np.uint64(32)) | right.astype("uint64")
        slot = self._slot(keys)
        ranks, merged = self.ranks[slot], self.merged[slot]
        found = self.keys[slot]
        other = np.flatnonzero((found != keys) & (ranks != NO_RANK))
        ranks[found != keys] = NO_RANK
        while len(other):
            slot[other] = (slot[other] + 1) % len(self.keys)
            at = slot[other]
            hit = self.keys[at] == keys[other]
            ranks[other[hit]], merged[other[hit]] = self.ranks[at[hit]], self.merged[at[hit]]
            other = other[~hit & (self.ranks[at] != NO_RANK)]
        return ranks, merged


def merge_all(symbols: np.ndarray, lengths: np.ndarray, pairs: PairTable) -> np.ndarray:
    """How many symbols survive in each of the sequences that lie end to end in ``symbols``."""
    counts = lengths.astype("int64").copy()
    names = np.flatnonzero(lengths > 1)
    keep = np.repeat(lengths > 1, lengths)
    symbols, lengths = symbols[keep].astype("int64"), lengths[names].astype("int64")
    if not len(names):
        return counts
    # rank and merged[i] belong to the pair (i, i + 1); a sequence's last symbol has no pair
    ranks, merged = _ranked(symbols, np.cumsum(lengths) - 1, pairs)
    while len(names):
        starts = np.cumsum(lengths) - lengths
        least = np.minimum.reduceat(ranks, starts)
        counts[names] = lengths
        going = least < NO_RANK
        if not going.all():
            keep = np.repeat(going, lengths)
            symbols, ranks, merged = symbols[keep], ranks[keep], merged[keep]
            names, lengths, least = names[going], lengths[going], least[going]
            if not len(names):
                break
        hit = ranks == np.repeat(least, lengths)
        at = np.flatnonzero(hit)
        # occurrences that overlap come in runs (a a a): every second one merges, from the left
        first = np.flatnonzero(np.r_[True, np.diff(at) > 1])
        in_run = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
        at = at[in_run % 2 == 0]
        symbols[at] = merged[at]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        ends = np.cumsum(lengths) - 1
        last = np.zeros(len(symbols), bool)
        last[ends] = True
        last[at] |= last[at + 1]
        gone = np.add.reduceat(~keep, ends - lengths + 1, dtype="int64")
        lengths = lengths - gone
        # only pairs beside a new symbol change
        new = np.zeros(len(symbols), bool)
        new[at] = True
        symbols, ranks, merged, last, new = symbols[keep], ranks[keep], merged[keep], last[keep], new[keep]
        changed = np.flatnonzero((new | np.r_[new[1:], False]) & ~last)
        ranks[last] = NO_RANK
        ranks[changed], merged[changed] = pairs.find(symbols[changed], symbols[changed + 1])
    return counts


def _ranked(symbols, ends, pairs):
    ranks, merged = pairs.find(symbols, np.r_[symbols[1:], 0])
    ranks[ends] = NO_RANK
    return ranks, merged


class WordCounter:
    """Token counts by one vocabulary file."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        ids = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = PairTable([ids[a] for a, _ in merges], [ids[b] for _, b in merges],
                               [ids[a + b] for a, b in merges])
        characters = byte_characters()
        self.inner = np.array([ids[characters[b]] for b in range(256)], "int64")
        self.final = np.array([ids[characters[b] + end] for b in range(256)], "int64")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # both classes of white space name the Unicode property, as the vocabulary's library does
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        self.marks = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, self.marks)))
        self.known: dict[str, int] = {}

    def words(self, text: str) -> list[str]:
        if not text.isascii():
            # lower() turns a final sigma into another letter, the vocabulary's library does not
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.split(text.lower())

    def count(self, texts: list[str]) -> list[int]:
        parts = [self.special.split(text) if any(m in text for m in self.marks) else [text] for text in texts]
        words = [[w for part in line for w in self.words(part)] for line in parts]
        if len(self.known) > MEMORY:
            self.known.clear()
        new = list(set().union(*words).difference(self.known))
        if new:
            data = [w.encode() for w in new]
            lengths = np.fromiter(map(len, data), "int64", len(data))
            raw = np.frombuffer(b"".join(data), "uint8")
            symbols = self.inner[raw]
            ends = np.cumsum(lengths) - 1
            symbols[ends] = self.final[raw[ends]]
            self.known.update(zip(new, merge_all(symbols, lengths, self.pairs).tolist(), strict=True))
        return [sum(map(self.known.__getitem__, line)) + len(part) - 1
                for line, part in zip(words, parts, strict=True)]


@lru_cache(maxsize=2)
def counter(vocabulary: str) -> WordCounter:
    return WordCounter(vocabulary)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; ``over_limit`` tells n_tokens > ``limit``."""
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = source.schema[id_col].dataType.simpleString()

    def run(batches):
        own = counter(vocabulary)
        for batch in batches:
            for part, texts in text_steps(batch, "text"):
                counts = own.count(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()),
                     pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                    [id_col, "n_bytes", "n_tokens", "over_limit"])

    return map_arrow(source, run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
