"""Spelling variants: words one edit apart, found by composing automata, and the form each word stands for.

The vocabulary is a minimised acyclic acceptor. Composed with a transducer that changes, adds or takes away exactly one symbol, and with
the acceptor again, it accepts the pairs of words one edit apart. The composed machine is walked by its initial states: a
walk begins in a state reached without an edit, where both words read the same symbols, and what it enumerates belongs to the
initial state alone. That divides the work among tasks, each of which builds the acceptor of its initial state and no more.

Initial states are halves of words. Two words of length L, or L and L + 1, one edit apart share the first L div 2 symbols or, if their common
beginning is shorter, the last L - L div 2; so every word enters by its beginnings and by its ends, once as the shorter and once as
the longer of a pair. The common beginning decides to which of the two a pair belongs, hence no pair is enumerated twice. A state with more than
``STATE_WORDS`` words is divided again, by halves of what its words don't share yet, until that is one symbol and the alphabet bounds it.

Words are maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case, of at least ``min_length`` code points and
``min_count`` occurrences in all texts. As a test for variants, one run in about ``damage`` loses a code point, by a checksum of
document id and run; ``damage=0`` leaves runs as they are. A word's form is its near word of most occurrences (ties: the first in code-point order) if
these are at least ``ratio`` times its own; its root is where following forms ends.

Null and empty texts have no runs. A null id counts as an empty one in the checksum. Repeated rows count as often as they occur. Empty tables
have no words. Only id and text are read, whatever other columns are named. Long texts are read whole. Words are counted in every task before
they are shuffled, so a frequent word travels once per task.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aqspark.llm.batches import map_arrow, written

LETTERS = "A-Za-zÀ-ÿ"
# distinct words that a task counts before it sends them on
HELD_WORDS = 1 << 18
# words of an initial state that is walked as a whole; one symbol more than shared leaves fewer: 89 letters and 89^2 pairs
STATE_WORDS = 1 << 13


def count_words(docs: DataFrame, id_col="doc_id", text_col="text", min_length=6, damage=199) -> DataFrame:
    """(word, n) of all texts."""
    runs = re.compile(f"[{LETTERS}]{{{min_length},}}")

    def run(batches):
        held = Counter()
        for batch in batches:
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                start = zlib.crc32(f"{'' if key is None else key}:".encode())
                # all occurrences of a run in a document share its checksum
                for found, n in Counter(runs.findall(text)).items():
                    # bytes fold A-Z only
                    low = found.encode().lower()
                    h = zlib.crc32(low, start)
                    word = low.decode()
                    if damage and h % damage == 0:
                        gone = h % len(word)
                        word = word[:gone] + word[gone + 1:]
                        if len(word) < min_length:
                            continue
                    held[word] += n
            if len(held) >= HELD_WORDS:
                yield _counted(held)
                held = Counter()
        yield _counted(held)

    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return map_arrow(rows, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(held):
    return pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])


# --- automata ------------------------------------------------------------------------------

class Acceptor:
    """Minimal acyclic acceptor of sorted, distinct words: state 0 is initial, states with equal futures are one."""

    def __init__(self, words):
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [False]
        known: dict = {}
        path, last = [0], ""
        for word in words:
            shared = 0
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
            self._fold(path, last, shared, known)
            for symbol in word[shared:]:
                self.arcs.append({})
                self.final.append(False)
                self.arcs[path[-1]][symbol] = len(self.arcs) - 1
                path.append(len(self.arcs) - 1)
            self.final[path[-1]] = True
            last = word
        self._fold(path, last, 0, known)

    def _fold(self, path, word, keep, known):
        """What lies beyond the first ``keep`` symbols is complete: states like earlier ones are replaced by them."""
        for depth in range(len(word), keep, -1):
            state = path.pop()
            same = known.setdefault((self.final[state], tuple(self.arcs[state].items())), state)
            self.arcs[path[-1]][word[depth - 1]] = same


def _rests(a: Acceptor, p: int, b: Acceptor, q: int, not_first: str | None = None) -> Iterator[str]:
    """Strings that lead to acceptance from both states; the transducer has made its edit and copies."""
    todo = [(p, q, "")]
    while todo:
        p, q, read = todo.pop()
        if a.final[p] and b.final[q]:
            yield read
        there = b.arcs[q]
        for symbol, state in a.arcs[p].items():
            if symbol in there and (read or symbol != not_first):
                todo.append((state, there[symbol], read + symbol))


def one_edit(a: Acceptor, b: Acceptor, before: int) -> Iterator[tuple[str, str]]:
    """Pairs accepted by a, one edit, and b: ``b``'s word has another symbol or one more. The edit lies where the common beginning of both
    words ends, and that is shorter than ``before``. So each pair comes once: a symbol added is not followed by its like."""
    todo = [(0, 0, "")]
    while todo:
        p, q, read = todo.pop()
        if len(read) >= before:
            continue
        mine, there = a.arcs[p], b.arcs[q]
        for symbol, state in there.items():
            for other, left in mine.items():
                if other == symbol:
                    todo.append((left, state, read + symbol))
                else:
                    for rest in _rests(a, left, b, state):
                        yield read + other + rest, read + symbol + rest
            for rest in _rests(a, p, b, state, not_first=symbol):
                yield read + rest, read + symbol + rest


# --- pairs by initial state ----------------------------------------------------------------

def initial_states(words: DataFrame, min_length: int) -> DataFrame:
    """(word, n, short, head, tail, before, state): every word with the halves it enters by.

    ``short`` is the length of the shorter word of a pair, ``head`` and ``tail`` say how many symbols all words
    of the state share, and ``before`` bounds the common beginning of its pairs.
    """
    length = F.length("word")
    rows = words.withColumn("short", F.explode(F.array(length, length - 1))).where(F.col("short") >= min_length)
    return _named(_halved(rows.withColumns({"head": F.lit(0), "tail": F.lit(0), "before": F.col("short") + 1})))


def _halved(rows: DataFrame) -> DataFrame:
    free = F.col("short") - F.col("head") - F.col("tail")
    half = F.floor(free / 2).cast("int")
    first = F.struct((F.col("head") + half).alias("head"), F.col("tail"), F.col("before"))
    second = F.struct(F.col("head"), (F.col("tail") + free - half).alias("tail"),
                      F.least("before", F.col("head") + half).alias("before"))
    return rows.select("word", "n", "short", F.explode(F.array(first, second)).alias("s")).select(
        "word", "n", "short", "s.head", "s.tail", "s.before")


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("state", F.concat_ws(" ", "short", "head", "tail", "before", F.expr("left(word, head)"),
                                                F.expr("right(word, tail)")))


def bounded_states(words: DataFrame, min_length: int, most: int) -> DataFrame:
    """Rows of ``initial_states`` of states with two words or more, divided until they have no more than ``most``."""
    todo, out = initial_states(words, min_length), None
    while True:
        todo = written(todo, "states")
        counts = todo.groupBy("state", "short", "head", "tail").agg(F.count("*").alias("words")).where("words > 1")
        counts = counts.withColumn("large", (F.col("words") > most) & (F.col("short") - F.col("head") - F.col("tail") > 1))
        counts = written(counts.select("state", "large"), "state-counts")
        done = todo.join(counts.where("NOT large"), "state", "left_semi")
        out = done if out is None else out.unionByName(done)
        if counts.where("large").isEmpty():
            return out
        todo = _named(_halved(todo.join(counts.where("large"), "state", "left_semi")))


def _state_pairs(head: int, short: int, before: int, words: list[str], counts: list[int]) -> dict[str, list]:
    """Word → [near words, their largest count negated, the first such word], as far as one state knows."""
    n = dict(zip(words, counts, strict=True))
    # all words of a state begin alike
    begin = len(words[0])
    for word in words:
        while not word.startswith(words[0][:begin]):
            begin -= 1
    begin = max(min(begin, short), head)
    shared = words[0][:begin]
    ordered = sorted(words)
    shorter = Acceptor([w[begin:] for w in ordered if len(w) == short])
    all_of_it = Acceptor([w[begin:] for w in ordered])
    out: dict[str, list] = {}
    for u, v in one_edit(shorter, all_of_it, before - begin):
        u, v = shared + u, shared + v
        for one, other in ((u, v), (v, u)) if len(u) < len(v) else ((u, v),):
            seen = out.setdefault(one, [0, 0, ""])
            seen[0] += 1
            if (-n[other], other) < (seen[1], seen[2]):
                seen[1], seen[2] = -n[other], other
    return out


def near_words(words: DataFrame, min_length=6, most=STATE_WORDS) -> DataFrame:
    """(word, n_near, best, best_n): how many words are near, and the most frequent of them."""
    def run(batches):
        state, rows, group = None, [], None

        def finished():
            found = _state_pairs(*group, [w for w, _ in rows], [n for _, n in rows]) if len(rows) > 1 else {}
            for word, (near, count, best) in found.items():
                out.append((word, near, count, best))

        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                word, n, short, head, before, key = row
                if key != state:
                    finished()
                    state, rows, group = key, [], (head, short, before)
                rows.append((word, n))
            yield _best(out)
        out = []
        finished()
        yield _best(out)

    states = bounded_states(words, min_length, most).select("word", "n", "short", "head", "before", "state")
    # a state is a run of rows of one partition
    sorted_states = states.repartition("state").sortWithinPartitions("state")
    found = map_arrow(sorted_states, run, "word string, n_near long, count long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("count", "best")).alias("b")).select(
        "word", "n_near", F.col("b.best").alias("best"), (-F.col("b.count")).alias("best_n"))


def _best(rows):
    names = ["word", "n_near", "count", "best"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.record_batch([pa.array([r[i] for r in rows], kinds[i]) for i in range(4)], names)


def follow(links: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form, by doubling: forms are more frequent by a factor, so chains are short."""
    roots = written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        step = written(roots.join(ahead, "root", "left").select(
            "word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        roots = step.select("word", "root")
        if step.where("moved").isEmpty():
            return roots


def spelling_variants(docs: DataFrame, id_col="doc_id", text_col="text", min_length=6, min_count=5, ratio=5, damage=199) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the vocabulary."""
    words = written(count_words(docs, id_col, text_col, min_length, damage).where(F.col("n") >= min_count), "words")
    known = words.join(near_words(words, min_length), "word", "left")
    takes = F.col("best_n") >= ratio * F.col("n")
    known = written(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("best")).alias("form"),
                                 F.when(takes, F.col("best_n")).alias("form_n")), "variants")
    roots = follow(known.where("form IS NOT NULL"))
    return known.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
