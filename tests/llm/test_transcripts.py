"""Transcript parsing: decoding in runs equals decoding whole, and roles of the given conversations."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from aqspark.llm import transcripts as T
from aqspark.llm.batches import held_out
from aqspark.llm.queries import op3_transcripts

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_viterbi_equals_trying_all_paths():
    random = np.random.default_rng(0)
    emission, move, first = random.normal(size=(5, 3)), random.normal(size=(3, 3)), random.normal(size=3)

    def score(path):
        return first[path[0]] + emission[0, path[0]] + sum(
            move[a, b] + emission[i + 1, b] for i, (a, b) in enumerate(zip(path, path[1:])))

    best = max(itertools.product(range(3), repeat=5), key=score)
    assert T.viterbi(emission, move, first) == list(best)
    best = max((p for p in itertools.product(range(3), repeat=5) if p[-1] == 1), key=score)
    assert T.viterbi(emission, move, first, leave=1) == list(best)
    matrix = T.run_matrix(emission, move)
    want = max(score(p) - first[p[0]] + move[2, p[0]] for p in itertools.product(range(3), repeat=5) if p[-1] == 1)
    assert abs(matrix[2, 1] - want) < 1e-9


def test_markers():
    for line, mark in [("User: hi", "user"), ("### Human:", "human"), ("[assistant] x", "assistant"), ("<|system|> x", "system"),
                       ("**AI:** x", "ai"), ("Q: why", "q"), ("Userland is", "none"), ("plain", "none"), ("answering: no", "none")]:
        assert T.line_features(line, True)[0] == mark, line


def made_up():
    rows = []
    for conv in range(30):
        for turn in range(6):
            role = ("user", "assistant")[turn % 2]
            body = f"Why {turn}?" if role == "user" else "Because of this.\n" + "It is a long story that goes on.\n" * 3 + "So it is."
            style = conv % 3
            mark = ("", f"{role.title()}: ", f"### {role.title()}:\n")[style]
            rows.append((conv, turn, role, mark + body))
    return rows


def turns(found):
    return sorted(((r["conv_id"], r["turn"], r["line"], r["role"], r["text"], r["n_lines"]) for r in found.collect()), key=repr)


def test_turns_are_recovered_and_rendered(spark):
    records = spark.createDataFrame(made_up(), SCHEMA)
    model = T.learn_transcripts(records)
    found = T.recover_turns(records.drop("role"), model)
    by_turn = {(c, t): (role, text) for c, t, line, role, text, _ in turns(found) if line == 0}
    assert len(by_turn) == 180
    assert all(by_turn[c, t][0] == role for c, t, role, _ in made_up())
    assert by_turn[1, 0][1] == by_turn[2, 0][1] == "Why 0?"
    row = found.where("conv_id = 2 AND turn = 0").first()
    assert row["rendered"] == "<|user|>\nWhy 0?\n<|end|>" and row["n_lines"] == 2


def test_a_transcript_in_one_record(spark):
    records = spark.createDataFrame(made_up(), SCHEMA)
    model = T.learn_transcripts(records)
    text = "User: Why?\nAssistant: Because of this.\nIt is a long story that goes on.\nUser: Why not?\nAssistant: So it is."
    found = turns(T.recover_turns(spark.createDataFrame([(1, 0, text)], "conv_id bigint, turn bigint, text string"), model))
    assert [(line, role) for _, _, line, role, _, _ in found] == [(0, "user"), (1, "assistant"), (3, "user"), (4, "assistant")]


def test_a_long_transcript_spread_over_tasks_gives_the_same(spark):
    records = spark.createDataFrame(made_up(), SCHEMA)
    model = T.learn_transcripts(records)
    long = [(7, turn, made_up()[6 * 1 + turn % 6][3].split(": ", turn % 3 % 2)[-1]) for turn in range(400)]
    table = spark.createDataFrame(long, "conv_id bigint, turn bigint, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            lines = T.ordered_lines(table, "conv_id", "turn", "text")
            assert (lines.select("chunk").distinct().count() > 1) == (n == "7")
            results.append(turns(T.recover_turns(table, model)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert results[0] == results[1]


def test_odd_rows(spark):
    rows = [*made_up(), (None, 0, "user", "lost"), (50, None, "user", "Why?"), (50, 1, "assistant", None), (51, 0, None, ""),
            (52, 0, "user", "Why " * 30_000), made_up()[0]]
    records = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", line string, seq int")
    model = T.learn_transcripts(records)
    found = turns(T.recover_turns(records, model))
    # every line of every record is in one turn
    want = sum((r[3] or "").count("\n") + 1 for r in rows)
    assert sum(r[5] for r in found) == want
    empty = spark.createDataFrame([], SCHEMA)
    assert T.recover_turns(empty, T.learn_transcripts(empty)).count() == 0
    assert T.recover_turns(records, T.learn_transcripts(empty)).count() == 0


def test_records_without_id_or_number_and_repeated_ones_are_kept(spark):
    model = T.learn_transcripts(spark.createDataFrame(made_up(), SCHEMA))
    rows = [(1, None, "ok"), (1, None, "ok"), (1, 2, "User: Why?"), (None, 0, "User: Why?"), (None, 1, "Assistant: So it is."), (None, 0, "User: Why?")]
    for kind, name in (("bigint", int), ("string", str)):
        own = [(None if c is None else name(c), t, x) for c, t, x in rows]
        found = turns(T.recover_turns(spark.createDataFrame(own, f"conv_id {kind}, turn bigint, text string"), model))
        assert sum(r[5] for r in found) == len(rows)
        assert {(r[0], r[1], r[4]) for r in found if r[0] is None} == {(None, 0, "Why?"), (None, 1, "So it is.")}
        assert sum(r[0] is None for r in found) == 3
        assert {type(r[0]) for r in found} == {name, type(None)}


def test_held_out_conversations(spark):
    folder = "/root/testdata/sf0.1"
    found = op3_transcripts(spark, folder).where("line = 0").select("conv_id", "turn", F.col("role").alias("found"))
    truth = spark.read.parquet(f"{folder}/conversations.parquet").where(held_out(F.col("conv_id")))
    joined = truth.join(found, ["conv_id", "turn"], "left")
    right, n = joined.agg(F.sum((F.col("role") == F.col("found")).cast("int")), F.count("*")).first()
    assert right / n > 0.97
