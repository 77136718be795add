"""Roles and turns of raw transcripts by a hidden Markov model.

A transcript is a sequence of lines (its records in order, each cut at line breaks). The hidden state of a line is the
speaker's role and whether the line starts a turn or goes on with it. A line shows its speaker marker, if it has one, its length,
how it starts and ends, and whether it opens a record. All counts come from labelled transcripts, over the whole table;
Viterbi's algorithm finds the likeliest states, and each turn is rendered in one canonical form without its marker.

Lines are dealt out by ranges of (transcript, record, text), so a transcript of any length spreads over many tasks. A run is what one
range holds of a transcript. Where a transcript crosses ranges, each run is first reduced to its best score
between every entering and leaving state; these few matrices fix the states at the borders, and the runs are then decoded on their
own, with the same result as in one piece.

No record is lost: those without a transcript id form one transcript, whose id is null; repeated records stand as often as they
come, next to each other. A null record number comes first; records of one number are ordered by their text. A null or empty text is one empty line. Unknown markers are read as text. Without a labelled line the result is empty. Only the named
columns are read, so other columns cannot clash.
"""

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aqspark.llm.batches import map_arrow, written

# fixed values: words that name a speaker
SPEAKERS = ("user human customer question q prompt instruction input me assistant ai bot model agent answer a response "
            "output gpt system context setup narrator moderator interviewer interviewee tool function speaker").split()
MARKER = re.compile(r"""^\s{0,3}(?:\#{1,6}\s*|\*\*|__|>\s*|<\|?|\[)?\s*(SPEAKERS)\s*\d{0,2}\s*
                        (?:\|?>|\]|\*\*:?|__:?|:\**|\s-\s)\s*""".replace("SPEAKERS", "|".join(
                            sorted(SPEAKERS, key=len, reverse=True))), re.I | re.X)
START, INSIDE = 0, 1


def line_features(line: str, opens: bool) -> tuple[str, ...]:
    """What a line shows, one value per feature."""
    mark = MARKER.match(line)
    body = (line[mark.end():] if mark else line).strip()
    ends = body[-1:] if body[-1:] in "?.!:,;" else "x"
    first = body[:1]
    begins = ("empty" if not first else "upper" if first.isupper() else "lower" if first.islower()
              else "digit" if first.isdigit() else "list" if first in "-*+•>" else "other")
    return (mark[1].lower() if mark else "none", str(min(len(body), 4095).bit_length()), ends, begins,
            "opens" if opens else "within")


@dataclass
class Model:
    """Log probabilities. State ``2 * role + INSIDE`` or ``2 * role + START``."""

    roles: list[str]
    first: np.ndarray
    move: np.ndarray
    shows: list[dict[str, np.ndarray]]

    def emission(self, lines: list[str], opens: list[bool]) -> np.ndarray:
        rows = np.zeros((len(lines), len(self.first)))
        for i, (line, open_) in enumerate(zip(lines, opens, strict=True)):
            for table, value in zip(self.shows, line_features(line, open_), strict=True):
                rows[i] += table.get(value, table[""])
        return rows


def viterbi(emission: np.ndarray, move: np.ndarray, enter: np.ndarray, leave: int | None = None) -> list[int]:
    """The likeliest states, given scores of the state of the first line (``enter``, before its emission)
    and, if known, the state of the last one."""
    best = enter + emission[0]
    back = []
    for row in emission[1:]:
        score = best[:, None] + move
        source = score.argmax(0)
        back.append(source)
        best = score[source, np.arange(len(best))] + row
    state = int(best.argmax()) if leave is None else leave
    out = [state]
    for source in reversed(back):
        state = int(source[state])
        out.append(state)
    return out[::-1]


def run_matrix(emission: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best scores from every state before a run to every state of its last line."""
    out = move + emission[0]
    for row in emission[1:]:
        out = (out[:, :, None] + move[None]).max(1) + row
    return out


def ordered_lines(records: DataFrame, id_col: str, order_col: str, text_col: str, role_col: str | None = None) -> DataFrame:
    """(conv, record, line, text, role, seq, chunk): lines in order of ``seq``; ``chunk`` is the range that holds them.

    ``conv`` is the id as a string after a sign, and empty for a null id, so that it can be joined.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = records.select(
        F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("")).alias("conv"), F.col(order_col).alias("record"), text.alias("text"),
        (F.lower(F.col(role_col)) if role_col else F.lit(None).cast("string")).alias("role"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    order = ["conv", "record", "tie", "text", "role"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("conv", "record", "role", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    # this id counts up within a partition, above the number of the partition
    rows = rows.withColumn("seq", F.monotonically_increasing_id())
    return written(rows.withColumn("chunk", F.shiftright("seq", 33)), "lines")


def _in_order(lines: DataFrame) -> DataFrame:
    return lines.repartition("chunk").sortWithinPartitions("seq")


def _runs(batches):
    """(chunk, conv, rows) of every run in a task that has the lines in order."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            now = (row["chunk"], row["conv"])
            if now != key and rows:
                yield *key, rows
                rows = []
            key = now
            rows.append(row)
    if rows:
        yield *key, rows


def learn_transcripts(records: DataFrame, id_col: str = "conv_id", order_col: str = "turn", text_col: str = "text",
                      role_col: str = "role", smooth: float = 0.1) -> Model:
    """Count states, moves and features over all labelled records; a record without a role teaches nothing."""
    lines = ordered_lines(records.where(F.col(role_col).isNotNull()), id_col, order_col, text_col, role_col)

    def run(batches):
        counts: dict[tuple, int] = {}
        borders = []

        def add(*key):
            counts[key] = counts.get(key, 0) + 1

        for chunk, conv, rows in _runs(batches):
            states = [f"{r['role']}\t{START if r['line'] == 0 else INSIDE}" for r in rows]
            for a, b in zip(states, states[1:], strict=False):
                add("move", a, b)
            for r, state in zip(rows, states, strict=True):
                for i, value in enumerate(line_features(r["text"], r["line"] == 0)):
                    add(f"show{i}", state, value)
            borders.append((chunk, conv, states[0], states[-1]))
            if len(borders) > 10_000 or len(counts) > 100_000:
                yield batch_of(counts, borders)
                counts, borders = {}, []
        yield batch_of(counts, borders)

    def batch_of(counts, borders):
        n = len(counts)
        return pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in counts] + ["border"] * len(borders), pa.string()),
            pa.array([k[1] for k in counts] + [b[2] for b in borders], pa.string()),
            pa.array([k[2] for k in counts] + [b[3] for b in borders], pa.string()),
            pa.array([*counts.values(), *[1] * len(borders)], pa.int64()),
            pa.array([None] * n + [b[0] for b in borders], pa.int64()),
            pa.array([None] * n + [b[1] for b in borders], pa.string())], ["kind", "a", "b", "n", "chunk", "conv"])

    found = written(map_arrow(
        _in_order(lines), run, "kind string, a string, b string, n bigint, chunk bigint, conv string"), "counts")
    sums = found.where("kind <> 'border'").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    # runs in order: the first starts a transcript, the others go on from the run before
    before = F.lag("b").over(Window.partitionBy("conv").orderBy("chunk"))
    ends = (found.where("kind = 'border'").withColumn("before", before)
            .groupBy(F.when(F.col("before").isNull(), "first").otherwise("move").alias("kind"), "before", "a").agg(F.count("*").alias("n"))
            .select("kind", F.coalesce("before", F.lit("")).alias("a"), F.col("a").alias("b"), "n"))
    rows = [tuple(r) for r in sums.union(ends).collect()]

    roles = sorted({a.split("\t")[0] for k, a, _, _ in rows if k.startswith("show")})
    states = {f"{role}\t{part}": 2 * i + part for i, role in enumerate(roles) for part in (START, INSIDE)}
    n = len(states)
    first, move = np.full(n, smooth), np.full((n, n), smooth)
    shows: list[dict[str, np.ndarray]] = [{"": np.full(n, smooth)} for _ in range(5)]
    for kind_, a, b, count in rows:
        if kind_ == "first":
            first[states[b]] += count
        elif kind_ == "move":
            move[states[a], states[b]] += count
        else:
            shows[int(kind_[4:])].setdefault(b, np.full(n, smooth))[states[a]] += count
    for i, role in enumerate(roles):
        # a line inside a turn follows a line of the same role
        for j in range(n):
            if j // 2 != i:
                move[j, 2 * i + INSIDE] = 1e-9
        first[2 * i + INSIDE] = 1e-9
    logs = []
    for i, table in enumerate(shows):
        total = sum(table.values())
        shares = {value: c / total for value, c in table.items()}
        if i == 4:
            # where labelled turns are records, records say too much: other transcripts hold several turns in one
            shares = {value: 0.98 * share + 0.02 / len(table) for value, share in shares.items()}
        logs.append({value: np.log(share) for value, share in shares.items()})
    return Model(roles, np.log(first / max(first.sum(), 1e-300)), np.log(move / move.sum(1, keepdims=True)) if n else move, logs)


def recover_turns(records: DataFrame, model: Model, id_col: str = "conv_id", order_col: str = "turn", text_col: str = "text"
                  ) -> DataFrame:
    """(id, order, line, role, text, rendered, n_lines): one row per recovered turn.

    ``order`` and ``line`` tell the record and the line in it where the turn starts.
    """
    lines = ordered_lines(records, id_col, order_col, text_col)
    if not model.roles:
        lines = lines.where("false")
    shared = records.sparkSession.sparkContext.broadcast(model)
    kind, record = records.schema[id_col].dataType.simpleString(), lines.schema["record"].dataType.simpleString()
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}

    def reduce_runs(batches):
        """Matrices of the first and the last run of every chunk: others are whole transcripts."""
        own = shared.value

        def give(chunk, conv, rows):
            emission = own.emission([r["text"] for r in rows], [r["line"] == 0 for r in rows])
            return pa.RecordBatch.from_arrays(
                [pa.array([conv], pa.string()), pa.array([chunk], pa.int64()),
                 pa.array([run_matrix(emission, own.move).ravel()], pa.list_(pa.float64())),
                 pa.array([(own.first + emission[0]).tolist() if len(rows) == 1 else _from_start(own, emission)], pa.list_(pa.float64()))],
                ["conv", "chunk", "matrix", "start"])

        last = None
        for chunk, conv, rows in _runs(batches):
            if last is None or last[0] != chunk:
                if last is not None and not last[3]:
                    yield give(*last[:3])
                yield give(chunk, conv, rows)
                last = chunk, conv, rows, True
            else:
                last = chunk, conv, rows, False
        if last is not None and not last[3]:
            yield give(*last[:3])

    runs = written(map_arrow(
        _in_order(lines), reduce_runs, "conv string, chunk bigint, matrix array<double>, start array<double>"), "runs")

    def borders(table: pa.Table) -> pa.Table:
        """States before and at the end of every run of one transcript that crosses chunks."""
        table = table.sort_by("chunk")
        n = len(table["start"][0])
        best = np.array(table["start"][0].as_py())
        back = []
        for matrix in table["matrix"].to_pylist()[1:]:
            score = best[:, None] + np.array(matrix).reshape(n, n)
            back.append(score.argmax(0))
            best = score.max(0)
        states = [int(best.argmax())]
        for source in reversed(back):
            states.append(int(source[states[-1]]))
        states.reverse()
        return pa.table({"conv": table["conv"], "chunk": table["chunk"],
                         "enter": pa.array([None, *states[:-1]], pa.int32()), "leave": pa.array(states, pa.int32())})

    crossing = runs.join(runs.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select("conv"), "conv")
    fixed = written(crossing.groupBy("conv").applyInArrow(borders, "conv string, chunk bigint, enter int, leave int"), "borders")

    def decode(batches):
        own = shared.value
        out = []
        for chunk, conv_, rows in _runs(batches):
            texts = [r["text"] for r in rows]
            emission = own.emission(texts, [r["line"] == 0 for r in rows])
            enter, leave = rows[0]["enter"], rows[0]["leave"]
            states = viterbi(emission, own.move, own.first if enter is None else own.move[enter], leave)
            at = 0
            for i in range(1, len(states) + 1):
                if i == len(states) or states[i] % 2 == START:
                    goes_on = states[at] % 2 == INSIDE and enter is not None and at == 0
                    body = texts[at:i]
                    mark = None if goes_on else MARKER.match(body[0])
                    if mark:
                        body = [body[0][mark.end():], *body[1:]]
                        body = body[1:] if not body[0].strip() and len(body) > 1 else body
                    out.append((conv_, chunk, rows[at]["seq"], rows[at]["record"], rows[at]["line"],
                                own.roles[states[at] // 2], "\n".join(body), i - at, goes_on))
                    at = i
            if len(out) > 5000:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    def batch_of(out):
        columns = list(zip(*out, strict=True)) if out else [[]] * 9
        kinds = [pa.string(), pa.int64(), pa.int64(), types.get(record, pa.string()), pa.int32(),
                 pa.string(), pa.string(), pa.int32(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                          ["conv", "chunk", "seq", "record", "line", "role", "text", "n_lines", "goes_on"])

    # at most two rows per chunk
    dealt = lines.drop("role").join(F.broadcast(fixed), ["conv", "chunk"], "left")
    turns = written(map_arrow(
        _in_order(dealt), decode, f"conv string, chunk bigint, seq bigint, record {record}, line int, role string, text string, "
        "n_lines int, goes_on boolean"), "turns")

    # a turn that crosses chunks: its parts are joined. Only turns at the borders of chunks are concerned.
    edge = turns.join(F.broadcast(fixed.select("conv", "chunk")), ["conv", "chunk"])
    tails = edge.groupBy("conv", "chunk").agg(F.max(F.when(~F.col("goes_on"), F.col("seq"))).alias("tail"))
    order = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    heads = tails.withColumn("head", F.last("tail", True).over(order)).select("conv", "chunk", "head")
    parts = turns.where("goes_on").join(F.broadcast(heads), ["conv", "chunk"])
    whole = parts.groupBy("conv", F.col("head").alias("seq")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("seq").alias("at"), "text", "n_lines"))).alias("more"))
    turns = turns.where(~F.col("goes_on")).join(whole, ["conv", "seq"], "left")
    more = F.col("more").isNotNull()
    text = F.when(more, F.concat_ws("\n", F.col("text"), F.col("more")["text"])).otherwise(F.col("text"))
    count = F.when(more, F.col("n_lines") + F.aggregate("more", F.lit(0), lambda a, p: a + p["n_lines"])).otherwise(F.col("n_lines"))
    return turns.select(
        F.when(F.col("conv") != "", F.expr("substring(conv, 2)").cast(kind)).alias(id_col), F.col("record").alias(order_col), "line", "role", text.alias("text"),
        F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), text, F.lit("\n<|end|>")).alias("rendered"),
        count.cast("int").alias("n_lines"))


def _from_start(model: Model, emission: np.ndarray) -> list[float]:
    """Best scores of the states of the last line of a run that starts a transcript."""
    best = model.first + emission[0]
    for row in emission[1:]:
        best = (best[:, None] + model.move).max(0) + row
    return best.tolist()
