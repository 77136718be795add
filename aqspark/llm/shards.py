"""Shards of nearly equal size, cut by a minimax contiguous partition of groups that stay whole.

Documents of equal text are one group, and a group is never divided. Groups are ordered by a digest of their text, and a
binary search finds the smallest capacity with which a greedy walk over that order fills no more than the wanted shards;
there the order is cut. A group that holds the mean of what is left or more would decide the capacity of all shards, so the largest
such groups get a shard each first, which is no more than they take anyhow, and the search is over the rest.

No machine sees all groups. The driver holds sums, largest sizes and counts of ranges of the digest, and walks over these twice: as if
a range could be cut anywhere, and as if a cut lost the largest group of its range. Both searches bound the capacity and every cut;
ranges that a cut may lie in are divided further and counted again, until only single groups are left there and both
walks agree. So the result is that of the plain greedy walk over all groups, with at most ``RANGES`` ranges counted at a time.

Slots number the rows of a shard without gaps, in the order of a digest of id and text. They come from counts of ranges
of that digest and from numbers inside a range, so neither a large shard nor a large group meets in one task.

Null texts have no bytes, and the group of empty ones. Null ids are ids like others. Repeated rows are rows, with a slot each. More shards
than groups leave shards empty, and an empty table has no rows to place. Only the id and the text are read; other columns do not matter,
whatever their names. Texts count with all their bytes. Groups are told apart by 60 bits of MD5: should two
texts share them, they are one group. Only DataFrame operations run.
"""

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aqspark.llm.batches import written

# bits of a digest, and of the ranges counted first
BITS, FIRST_BITS = 60, 12
# ranges that one round of counting sends to the driver
RANGES = 1 << 15
# a row costs these bytes besides its text
ROW_BYTES = 16
# rows of one range of slots; a shard has at least 64 ranges
SLOT_ROWS, LEAST_BITS = 1 << 16, 6


def digest(text: Column) -> Column:
    """The first 60 bits of MD5 as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def group_of(text: Column) -> Column:
    return digest(F.coalesce(text, F.lit("")))


@dataclass
class ShardPlan:
    """Where each group goes: ``alone`` have the first shards, ``starts`` are the first groups of the others."""
    shards: int
    capacity: int = 0
    alone: list[int] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)

    def shard(self, group: Column) -> Column:
        """The shard of a group: a few comparisons, no join."""
        out = F.lit(len(self.alone))
        for start in self.starts:
            out = out + (group >= start).cast("int")
        for number, key in enumerate(self.alone):
            out = F.when(group == key, F.lit(number)).otherwise(out)
        return out.cast("int")


class Ranges:
    """Sums, largest groups and counts of consecutive ranges of the digest, as far as they hold groups."""

    def __init__(self, rows):
        table = np.array(rows, dtype=np.int64).reshape(-1, 6)
        self.table = table[np.argsort(table[:, 0])]
        self.start, self.shift, self.first, self.sums, self.largest, self.counts = self.table.T
        self.ends = np.cumsum(self.sums)
        self.total = int(self.ends[-1]) if len(table) else 0

    def walk(self, capacity: int, shards: int, careful: bool) -> list[int]:
        """Where each shard ends. Inside a range of several groups the end is too late, or, if ``careful``, too early."""
        at, path = 0, []
        for _ in range(shards):
            target = at + capacity
            if target >= self.total:
                at = self.total
            else:
                i = int(np.searchsorted(self.ends, target, side="right"))
                start = int(self.ends[i] - self.sums[i])
                if self.counts[i] == 1:
                    at = start
                else:
                    at = max(start, target - int(self.largest[i]) + 1) if careful else target
            path.append(at)
        return path

    def smallest(self, shards: int, careful: bool) -> int:
        """The smallest capacity that reaches the end."""
        largest = int(self.largest.max())
        low = max(largest, -(-self.total // shards))
        high = low + largest
        while low < high:
            middle = (low + high) // 2
            if self.walk(middle, shards, careful)[-1] >= self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def unsure(self, shards: int) -> tuple[int, np.ndarray]:
        """The capacity as known so far, and the ranges of several groups that may hold a cut."""
        low, high = self.smallest(shards, False), self.smallest(shards, True)
        marked = np.zeros(len(self.table), dtype=bool)
        for a, b in zip(self.walk(low, shards, True), self.walk(high, shards, False), strict=True):
            if a < self.total:
                i, j = np.searchsorted(self.ends, [a, min(b, self.total - 1)], side="right")
                marked[i:j + 1] = True
        return high, marked & (self.counts > 1)


def _counted(groups: DataFrame, shift: int) -> list[tuple]:
    """(start, shift, first group, bytes, largest, groups) of every range of 2^shift digests."""
    start = F.shiftleft(F.shiftright("group", shift), shift)
    rows = groups.groupBy(start.alias("start")).agg(
        F.min("group"), F.sum("bytes"), F.max("bytes"), F.count("*")).collect()
    return [(r[0], shift, r[1], r[2], r[3], r[4]) for r in rows]


def _divided(groups: DataFrame, ranges: Ranges, marked: np.ndarray) -> Ranges:
    """The coarsest marked ranges divided, into no more than ``RANGES`` altogether."""
    bits = max(1, int(np.log2(RANGES / max(marked.sum(), 1))))
    shift = max(0, int(ranges.shift[marked].max()) - bits)
    marked = marked & (ranges.shift > shift)
    # neighbours are read as one interval
    spans = []
    for start, width in zip(ranges.start[marked].tolist(), ranges.shift[marked].tolist(), strict=True):
        if spans and spans[-1][1] == start:
            spans[-1][1] = start + (1 << width)
        else:
            spans.append([start, start + (1 << width)])
    inside = " OR ".join(f"(group >= {a} AND group < {b})" for a, b in spans)
    finer = _counted(groups.where(inside), shift)
    return Ranges([tuple(r) for r in ranges.table[~marked].tolist()] + finer)


def plan_shards(groups: DataFrame, shards: int) -> ShardPlan:
    """The minimax partition of ``groups`` (group long, bytes long; one row each)."""
    plan = ShardPlan(shards)
    left = groups.agg(F.sum("bytes")).first()[0]
    if not left:
        return plan
    for key, size in groups.orderBy(F.desc("bytes"), "group").limit(shards).select("group", "bytes").collect():
        if size * (shards - len(plan.alone)) < left:
            break
        plan.alone.append(key)
        plan.capacity = max(plan.capacity, size)
        left -= size
    if not left:
        return plan
    if plan.alone:
        groups = groups.where(f"group NOT IN ({', '.join(map(str, plan.alone))})")
    ranges, rest = Ranges(_counted(groups, BITS - FIRST_BITS)), shards - len(plan.alone)
    capacity, marked = ranges.unsure(rest)
    while marked.any():
        ranges = _divided(groups, ranges, marked)
        capacity, marked = ranges.unsure(rest)
    plan.capacity = max(plan.capacity, capacity)
    for end in ranges.walk(capacity, rest, False):
        if end < ranges.total:
            plan.starts.append(int(ranges.first[np.searchsorted(ranges.ends, end, side="right")]))
    return plan


def sized(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, size, text_crc32, group) of every row: all that placing it needs."""
    text = F.col(f"`{text_col}`")
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        group_of(text).alias("group"))


def with_slots(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Number the rows of every shard from 0; ``counts`` has the rows of each shard."""
    order = digest(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("group").cast("string")))
    bits = {s: max(LEAST_BITS, (n // SLOT_ROWS).bit_length()) for s, n in counts.items()}
    shifts = ", ".join(str(BITS - bits.get(s, LEAST_BITS)) for s in range(max(counts, default=0) + 1))
    rows = rows.withColumn("spot", order).withColumn("part", F.expr(f"shiftright(spot, element_at(array({shifts}), shard + 1))"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "part").agg(F.count("*").alias("n")).select(
        "shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "part").orderBy("spot", "doc_id", "group", "size")
    return rows.join(offsets, ["shard", "part"]).withColumn(
        "slot", (F.col("offset") + F.row_number().over(inside) - 1).cast("long"))


def shard_documents(docs: DataFrame, shards: int = 40, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row."""
    rows = written(sized(docs, id_col, text_col), "shard-rows")
    groups = written(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "shard-groups")
    shard = plan_shards(groups, shards).shard(F.col("group"))
    counts = groups.groupBy(shard.alias("shard")).agg(F.sum("rows")).collect()
    return with_slots(rows.withColumn("shard", shard), dict(map(tuple, counts))).select(
        "doc_id", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 40, text_col="text", files: int = 8) -> ShardPlan:
    """Write all rows and columns as one folder per shard, ``shard=0`` and on, with up to ``files`` files each.

    Files follow a digest of the whole row, so copies are dealt over all files of their shard.
    """
    text = F.col(f"`{text_col}`")
    groups = written(sized(docs, text_col, text_col).groupBy("group").agg(
        F.sum("size").alias("bytes")), "shard-groups")
    plan = plan_shards(groups, shards)
    dealt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), F.lit(files))
    taken = [c for c in docs.columns if c.lower() == "shard"]
    if taken:
        raise ValueError("a column named shard would be lost in the folders' names")
    (docs.withColumn("shard", plan.shard(group_of(text))).repartition(shards * files, "shard", dealt)
     .write.partitionBy("shard").parquet(path))
    return plan
