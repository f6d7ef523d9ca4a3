"""Most frequent items of columns in bounded memory: heavy-light split.

Every part keeps, per group and column, buckets of a few exact cells (item,
positive votes) with a common count of negative votes, and a compact array of
counters. An item that owns a cell adds to its votes; any other takes a free
cell or votes against the bucket, and once the negative votes reach EVICT times
the smallest cell, that cell's item is evicted into the counter array and the
newcomer takes its place. Parts merge bucket by bucket: votes of the same item
add up, the largest cells stay, the rest falls into the added counters. The true
count of an item lies between its votes and its votes plus its counter; the
counter holds on average 1/COUNTERS of the group's rows.

`place` puts the rows in order of their group, in ranges of equal size: a hot
group is many ranges, and a range holds few groups. Inside a range the groups
come one after the other, so a task has the sketch of one group at a time and
writes BUCKETS x CELLS + COUNTERS entries a group at most, never more entries
than rows. Nothing grows with the number of groups, of different items or with
a hot item.

Defined results: null items count towards the group's total only; rows with a
null group are left out; an empty input gives an empty result; ties are all
returned; rows that aren't placed give the same bounds from more parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024
CELLS = 4
COUNTERS = 16_384
EVICT = 8
#: Rows that are counted together before they enter the sketch.
BATCH = 65_536
_TOTAL, _HEAVY, _LIGHT = 0, 1, 2
_SCHEMA = "kind int, grp {grp}, field string, slot int, item string, hash long, votes long"


def _slot(h: np.ndarray) -> np.ndarray:
    return ((h.view(np.uint64) >> np.uint64(24)) % np.uint64(COUNTERS)).astype(np.int64)


class HeavyLight:
    """The sketch of one group and column in one part."""

    def __init__(self) -> None:
        self.key = np.zeros((BUCKETS, CELLS), np.int64)
        self.votes = np.zeros((BUCKETS, CELLS), np.int64)
        self.item = np.empty((BUCKETS, CELLS), object)
        self.against = np.zeros(BUCKETS, np.int64)
        self.light = np.zeros(COUNTERS, np.int64)
        self.total = 0

    def add(self, h: np.ndarray, n: np.ndarray, items: np.ndarray) -> None:
        """Add distinct items with their hashes and counts."""
        order = np.argsort(-n, kind="stable")
        h, n, items = h[order], n[order], items[order]
        bucket = (h.view(np.uint64) % np.uint64(BUCKETS)).astype(np.int64)
        own = (self.key[bucket] == h[:, None]) & (self.votes[bucket] > 0)
        has = own.any(1)
        np.add.at(self.votes, (bucket[has], own[has].argmax(1)), n[has])
        h, n, items, bucket = h[~has], n[~has], items[~has], bucket[~has]
        # Free cells go to the largest newcomers of their bucket, in order.
        by = np.argsort(bucket, kind="stable")
        h, n, items, bucket = h[by], n[by], items[by], bucket[by]
        place = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)
        used = (self.votes > 0).sum(1)
        fits = used[bucket] + place < CELLS
        at = (bucket[fits], used[bucket[fits]] + place[fits])
        self.key[at], self.votes[at], self.item[at] = h[fits], n[fits], items[fits]
        h, n, items, bucket = h[~fits], n[~fits], items[~fits], bucket[~fits]
        if not len(h):
            return
        np.add.at(self.against, bucket, n)
        first = np.r_[True, bucket[1:] != bucket[:-1]]  # the largest newcomer of each bucket
        b = bucket[first]
        weakest = self.votes[b].argmin(1)
        out = self.against[b] >= EVICT * self.votes[b, weakest]
        stays = np.ones(len(h), bool)
        stays[np.flatnonzero(first)[out]] = False
        b, weakest = b[out], weakest[out]
        np.add.at(self.light, _slot(self.key[b, weakest]), self.votes[b, weakest])
        new = np.flatnonzero(first)[out]
        self.key[b, weakest], self.votes[b, weakest], self.item[b, weakest] = h[new], n[new], items[new]
        self.against[b] = 0
        np.add.at(self.light, _slot(h[stays]), n[stays])

    def rows(self) -> list[tuple[np.ndarray, ...]]:
        """(kind, slot, item, hash, votes) of the total, the cells and the counters in use."""
        b, c = np.nonzero(self.votes)
        light = np.flatnonzero(self.light)
        none = np.full(len(light), None, object)
        return [
            (np.full(1, _TOTAL), np.zeros(1, np.int64), np.full(1, None, object), np.zeros(1, np.int64), np.full(1, self.total)),
            (np.full(len(b), _HEAVY), b, self.item[b, c], self.key[b, c], self.votes[b, c]),
            (np.full(len(light), _LIGHT), light, none, np.zeros(len(light), np.int64), self.light[light]),
        ]


def place(rows: DataFrame, group: str, spread: Column) -> DataFrame:
    """rows in ranges of equal size along their group, and in order of it; spread (any hash) divides a hot group."""
    return rows.where(F.col(group).isNotNull()).withColumn("__spread", spread).repartitionByRange(group, "__spread").drop("__spread").sortWithinPartitions(group)


def sketch(rows: DataFrame, group: str, items: str | list[str], placed: bool = False) -> DataFrame:
    """Partial sketches of the items of every group, column by column (field). placed: the rows stand in order of their group."""
    items = [items] if isinstance(items, str) else items
    given = rows.where(F.col(group).isNotNull()).select(F.col(group).alias("grp"), *[x for i, c in enumerate(items) for x in (F.col(c).cast("string").alias(f"item{i}"), F.xxhash64(F.col(c).cast("string")).alias(f"hash{i}"))])
    given = given if placed else given.sortWithinPartitions("grp")
    kind = given.schema["grp"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, states = None, [HeavyLight() for _ in items]
        held: list[pa.RecordBatch] = []

        def enter() -> None:
            part = pa.Table.from_batches(held)
            held.clear()
            for i, state in enumerate(states):
                state.total += part.num_rows
                some = part.select([f"item{i}", f"hash{i}"]).filter(pc.is_valid(part.column(f"item{i}")))
                if some.num_rows:
                    counted = some.group_by(f"item{i}").aggregate([(f"hash{i}", "min"), (f"hash{i}", "count")])
                    state.add(counted.column(f"hash{i}_min").to_numpy(), counted.column(f"hash{i}_count").to_numpy().astype(np.int64), counted.column(f"item{i}").to_numpy(zero_copy_only=False))

        def written() -> Iterator[pa.RecordBatch]:
            for c, state in zip(items, states):
                if state.total:
                    parts = [np.concatenate(x) for x in zip(*state.rows())]
                    n = len(parts[0])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(parts[0], pa.int32()), pa.repeat(grp, n), pa.repeat(c, n), pa.array(parts[1], pa.int32()), pa.array(parts[2], pa.string()), pa.array(parts[3], pa.int64()), pa.array(parts[4], pa.int64())],
                        names=["kind", "grp", "field", "slot", "item", "hash", "votes"],
                    )

        for batch in batches:
            start = 0
            for end in pc.run_end_encode(batch.column(0)).run_ends.to_pylist():
                here = batch.column(0)[start]
                if grp is None or not here.equals(grp):
                    if held:
                        enter()
                    yield from written()
                    grp, states = here, [HeavyLight() for _ in items]
                held.append(batch.slice(start, end - start))
                if sum(x.num_rows for x in held) >= BATCH:
                    enter()
                start = end
        if held:
            enter()
        yield from written()

    return given.mapInArrow(run, _SCHEMA.format(grp=kind))


def frequent_items(sketches: DataFrame) -> DataFrame:
    """grp, field, item, at_least, at_most, total: the items that hold a cell after the merge. sketches should be cheap to read again."""
    by = ["grp", "field"]
    totals = sketches.where(F.col("kind") == _TOTAL).groupBy(*by).agg(F.sum("votes").alias("total"))
    heavy = sketches.where(F.col("kind") == _HEAVY).groupBy(*by, "slot", "item", "hash").agg(F.sum("votes").alias("votes"))
    heavy = heavy.withColumn("place", F.row_number().over(Window.partitionBy(*by, "slot").orderBy(F.desc("votes"), "item")))
    # hash >>> 24 is below 2^40 and so positive: the remainder is the same counter as in the parts.
    ranked = heavy.withColumn("counter", F.pmod(F.shiftrightunsigned("hash", 24), F.lit(COUNTERS)).cast("int"))
    fallen = ranked.where(F.col("place") > CELLS).select(*by, "counter", F.col("votes").alias("n"))
    light = sketches.where(F.col("kind") == _LIGHT).select(*by, F.col("slot").alias("counter"), F.col("votes").alias("n"))
    counters = light.unionByName(fallen).groupBy(*by, "counter").agg(F.sum("n").alias("n"))
    return (
        ranked.where(F.col("place") <= CELLS).join(counters, [*by, "counter"], "left")
        .join(totals, by)
        .select(*by, "item", F.col("votes").alias("at_least"), (F.col("votes") + F.coalesce("n", F.lit(0))).alias("at_most"), "total")
    )
