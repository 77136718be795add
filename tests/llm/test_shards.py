"""Shards against the plain greedy walk over all groups."""

import hashlib
import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aqspark.llm import shards as sharding
from aqspark.llm.queries import op13_contiguous_shards
from aqspark.llm.shards import plan_shards, shard_documents, write_shards
from aqspark.storage import new_path


def number(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def ends(sizes, capacity, shards):
    """How many groups the greedy walk places in each shard."""
    out, at = [], 0
    for _ in range(shards):
        total = 0
        while at < len(sizes) and total + sizes[at] <= capacity:
            total += sizes[at]
            at += 1
        out.append(at)
    return out


def plain_plan(groups, shards):
    """Group → shard, with the capacity tried one after the other between its bounds."""
    left, alone = sum(groups.values()), []
    for key in sorted(groups, key=lambda k: (-groups[k], k)):
        if groups[key] * (shards - len(alone)) < left:
            break
        alone.append(key)
        left -= groups[key]
    place = {k: i for i, k in enumerate(alone)}
    rest = sorted(k for k in groups if k not in place)
    sizes, n = [groups[k] for k in rest], shards - len(alone)
    if rest:
        low, high = 0, sum(sizes)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (low, middle) if ends(sizes, middle, n)[-1] == len(sizes) else (middle, high)
        for i, key in enumerate(rest):
            place[key] = len(alone) + sum(e <= i for e in ends(sizes, high, n))
    return place


def plain_shards(rows, shards):
    groups = {}
    for _, text in rows:
        key = number(text or "")
        groups[key] = groups.get(key, 0) + len((text or "").encode()) + 16
    place = plain_plan(groups, shards)
    found = []
    for i, text in rows:
        key = number(text or "")
        spot = number(f"{'' if i is None else i}:{key}")
        found.append((place[key], spot, i is not None, i or 0, len((text or "").encode()) + 16, zlib.crc32((text or "").encode()), i))
    found.sort()
    out, slots = [], {}
    for shard, *_, size, crc, i in found:
        slots[shard] = slots.get(shard, -1) + 1
        out.append((i, size, crc, shard, slots[shard]))
    return sorted(out, key=repr)


def check(spark, rows, shards):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = shard_documents(docs, shards)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_shards(rows, shards)


def test_odd_rows(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (None, "b"), (3, None), (4, ""), (None, None), (5, "é" * 500), (6, "long " * 4000)]
    rows += [(i, f"text {i % 23} " * (i % 7 + 1)) for i in range(10, 120)]
    for shards in (1, 4, 40):
        check(spark, rows, shards)


def test_no_rows_and_clashing_columns(spark):
    assert shard_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    docs = spark.createDataFrame([(i, f"t{i}", 1, 2, 3) for i in range(30)],
                                 "doc_id int, text string, size int, `group` int, slot int")
    found = shard_documents(docs, 3)
    assert found.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert found.groupBy("shard").agg(F.max("slot") + 1 - F.count("*")).where("shard >= 0").collect()[0][1] == 0


def test_group_of_half_the_rows(spark):
    """A large group takes a shard of its own; the rest is spread evenly over the others."""
    rows = [(i, "copy " * 40) for i in range(3000)] + [(i, f"own {i} " * (i % 9 + 3)) for i in range(3000, 6000)]
    check(spark, rows, 8)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sizes = [r[1] for r in shard_documents(docs, 8).where("shard > 0").groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sizes) == 7 and max(sizes) < 1.02 * sum(sizes) / 7


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 2 ** 60 - 1), st.integers(1, 1000)), min_size=1, max_size=200, unique_by=lambda g: g[0]),
       st.integers(1, 12), st.sampled_from([16, 64]))
def test_few_ranges_at_a_time(spark, groups, shards, ranges):
    """However few ranges a round may count, the cuts are those of the walk over all groups."""
    before = sharding.RANGES, sharding.FIRST_BITS
    sharding.RANGES, sharding.FIRST_BITS = ranges, 2
    try:
        table = spark.createDataFrame(groups, "group long, bytes long")
        plan = plan_shards(table, shards)
        got = {r[0]: r[1] for r in table.select("group", plan.shard(F.col("group"))).collect()}
    finally:
        sharding.RANGES, sharding.FIRST_BITS = before
    assert got == plain_plan(dict(groups), shards)


def test_given_documents(spark):
    found = op13_contiguous_shards(spark, "/root/testdata/sf0.001")
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = found.drop("law", "grown_shard").select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    assert sorted(map(tuple, got), key=repr) == plain_shards(rows, 40)
    assert {tuple(r) for r in found.select("law", "grown_shard").distinct().collect()} == {("bytes", None)}


def test_written_folders(spark):
    docs = spark.createDataFrame([(i, f"t{i % 11}" * 5, i) for i in range(60)] + [(None, None, None)],
                                 "doc_id long, text string, extra int")
    path = new_path(spark, "shards")
    plan = write_shards(docs, path, shards=4, files=2)
    back = spark.read.parquet(path)
    assert sorted(map(tuple, back.drop("shard").collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)
    assert back.groupBy("text").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    assert back.agg(F.max("shard")).first()[0] < plan.shards
    with pytest.raises(ValueError):
        write_shards(docs.withColumn("shard", F.lit(1)), path)
