"""Language identification by cross-parsing.

For each language a suffix automaton of labelled text recognises every substring of that text. A
document is cut greedily into phrases, each the longest substring found at its place; a phrase
costs as many bits as it takes to point into the labelled text, so counts of languages with more
or less text compare. The language needing the fewest bits wins, ties going to the earlier name.

Texts count as lower-case letters with one space between words, as UTF-8. A long text is parsed in
pieces side by side, which adds at most one phrase per piece; every letter counts.

Null texts and texts without a letter are ``und`` with score 0. Rows without a label, or without
an id, teach nothing; with no labelled text at all every document is ``und``. Repeated rows give repeated
results. Only the named columns are read, so other columns cannot clash.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aqspark.llm.batches import map_arrow, text_steps

UNKNOWN = "und"
# bytes of one piece of a text
PIECE = 1024


@dataclass
class Automata:
    """Suffix automata of all languages in one table: ``step[state * width + symbol]``, 0 for none.

    ``roots`` are the states before any letter, ``bits`` the price of a phrase.
    """

    languages: list[str]
    symbols: np.ndarray
    width: int
    step: np.ndarray
    roots: np.ndarray
    bits: np.ndarray


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads exactly the substrings of ``data``."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in data:
        state = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and symbol not in moves[p]:
            moves[p][symbol] = state
            p = link[p]
        if p >= 0:
            q = moves[p][symbol]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(symbol) == q:
                    moves[p][symbol] = clone
                    p = link[p]
                link[q] = link[state] = clone
        last = state
    return moves


def build_automata(samples: dict[str, str]) -> Automata:
    """Automata of the (normalised) text per language."""
    languages = sorted(samples)
    data = {name: samples[name].encode() for name in languages}
    used = sorted(set(b"".join(data.values())))
    # symbol 0 is every byte that no sample has
    symbols = np.zeros(256, "int64")
    symbols[used] = np.arange(1, len(used) + 1)
    width = len(used) + 1
    tables, roots, offset = [], [], 1
    for name in languages:
        moves = suffix_automaton(data[name])
        table = np.zeros((len(moves), width), "int32")
        for state, row in enumerate(moves):
            for byte, to in row.items():
                table[state, symbols[byte]] = to + offset
        tables.append(table)
        roots.append(offset)
        offset += len(moves)
    empty = np.zeros((1, width), "int32")
    step = np.concatenate([empty, *tables]).ravel()
    bits = np.array([np.log2(max(len(data[name]), 2)) for name in languages])
    return Automata(languages, symbols, width, step, np.array(roots, "int64"), bits)


def phrase_counts(texts: list[bytes], automata: Automata) -> np.ndarray:
    """Phrases of every text (row) in every language (column)."""
    sizes = np.fromiter(map(len, texts), "int64", len(texts))
    n_pieces = -(-sizes // PIECE)
    owner = np.repeat(np.arange(len(texts)), n_pieces)
    total = np.zeros((len(texts), len(automata.languages)), "int64")
    if not len(owner):
        return total
    symbols = automata.symbols[np.frombuffer(b"".join(texts), "uint8")]
    within = np.arange(len(owner)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
    start = np.repeat(np.cumsum(sizes) - sizes, n_pieces) + within * PIECE
    size = np.minimum(np.repeat(sizes, n_pieces) - within * PIECE, PIECE)
    order = np.argsort(-size, kind="stable")
    owner, start, size = owner[order], start[order], size[order]
    # pieces still being read at each place: they come first, longest pieces leading
    reading = np.searchsorted(-size, -np.arange(PIECE), side="left")
    first = automata.step.reshape(-1, automata.width)[automata.roots]
    # state 0 reads nothing: before a piece, and behind a byte that a language does not have
    state = np.zeros((len(automata.roots), len(owner)), "int64")
    phrases = np.zeros(state.shape, "int32")
    for place in range(int(size[0])):
        n = reading[place]
        symbol = symbols[start[:n] + place]
        now = automata.step[state[:, :n] * automata.width + symbol]
        starts = now == 0
        phrases[:, :n] += starts
        state[:, :n] = np.where(starts, first[:, symbol], now)
    np.add.at(total, owner, phrases.T)
    return total


def letters(text: Column) -> Column:
    """Lower-case letters, one space between words."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " "))


def learn_languages(docs: DataFrame, sample_bytes: int = 32_000, text_col: str = "text",
                    lang_col: str = "lang") -> Automata:
    """Fit automata on labelled rows.

    Of each language at most ``sample_bytes`` bytes of whole texts are learned from, chosen by a hash
    of the text; a language whose chosen texts are all longer gives the beginning of one of them.
    This bounds the table by about ``2 * sample_bytes`` states per language.
    """
    labelled = docs.select(F.col(lang_col).cast("string").alias("lang"), letters(F.col(text_col)).alias("text"))
    labelled = labelled.where("lang IS NOT NULL AND text <> ''").withColumn("key", F.xxhash64("text"))
    by_hash = Window.partitionBy("lang").orderBy("key")
    # 200 candidates per language; copies of a text count once
    candidates = (labelled.groupBy("lang", "key").agg(F.max(F.octet_length("text")).alias("size"))
                  .withColumn("n", F.row_number().over(by_hash)).where("n <= 200").collect())
    chosen: dict[str, list[int]] = {}
    left: dict[str, int] = {}
    for row in sorted(candidates, key=lambda r: (r["lang"], r["n"])):
        rest = left.setdefault(row["lang"], sample_bytes)
        if row["size"] <= rest:
            chosen.setdefault(row["lang"], []).append(row["key"])
            left[row["lang"]] = rest - row["size"] - 1
    for row in candidates:
        chosen.setdefault(row["lang"], [row["key"]])
    wanted = sorted({key for keys in chosen.values() for key in keys})
    if not wanted:
        return build_automata({})
    texts = {(r["lang"], r["key"]): r["text"] for r in
             labelled.where(F.col("key").isin(wanted)).groupBy("lang", "key")
             .agg(F.min(F.substring("text", 1, sample_bytes)).alias("text")).collect()}
    return build_automata({
        lang: " ".join(texts[lang, key] for key in keys) for lang, keys in chosen.items()})


def identify(docs: DataFrame, automata: Automata, id_col: str = "doc_id", text_col: str = "text",
             keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """(id, lang_pred, score) of every row; with ``keep`` these columns instead of the id, and with ``names`` other
    names for the two new ones, which must not be among the columns kept.

    The score tells how far the winner leads: 1/2 when the two best languages cost the same, towards 1
    when the runner-up costs many times as much, and 1 where only one language is known.
    """
    kept = [F.col(f"`{c}`") for c in (keep or [id_col])]
    source = docs.select(*kept, letters(F.col(f"`{text_col}`")).alias("__letters"))
    fields = source.schema.fields[:-1]
    shared = docs.sparkSession.sparkContext.broadcast(automata)

    def run(batches):
        own = shared.value
        for batch in batches:
            batch = batch.rename_columns([str(i) for i in range(len(fields))] + ["letters"])
            for part, texts in text_steps(batch, "letters"):
                found, scores = [], []
                bits = phrase_counts([t.encode() for t in texts], own) * own.bits
                for text, cost in zip(texts, bits, strict=True):
                    if not text or not len(cost):
                        found.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    best = int(np.argmin(cost))
                    rival = np.partition(cost, 1)[1] if len(cost) > 1 else np.inf
                    found.append(own.languages[best])
                    scores.append(float(rival / (rival + cost[best])) if np.isfinite(rival) else 1.0)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                    [f.name for f in fields] + [*names])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
                       + [f"`{names[0]}` string", f"`{names[1]}` double"])
    return map_arrow(source, run, schema, trim=True)
