"""Items of varying length into containers of a fixed capacity.

The global histogram of item lengths (at most capacity entries, whatever the
number of items) goes to the driver. Dynamic programming over it chooses the
length buckets that minimise padding, the space lost by rounding every length up
to its bucket. Token-budget batches are then planned over the bucket counts:
buckets from long to short, each item into the open batch with the least room
that still holds it. (Batches of one bucket alone would leave far more space
unused; `plan` reports that figure too.) The plan is a short list of patterns,
"so many batches with these bucket counts"; each item finds its batch by its
rank in its bucket, a two-level count over shards, so no bucket or hot length
ever meets in one task.

An item above the capacity is cut into full pieces and a rest; no other is split.

Defined results: items of size null, zero or less are not packed; repeated ids
are packed as often as they occur; items of equal length are ordered by id; an
empty input gives an empty result.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def length_buckets(counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` length buckets with the least padding; counts[i] items have length i."""
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return []
    n = counts[lengths].astype(np.float64)
    items, tokens = np.r_[0.0, np.cumsum(n)], np.r_[0.0, np.cumsum(n * lengths)]
    m = len(lengths)
    best = lengths * items[1:] - tokens[1:]  # one bucket for the first j + 1 lengths
    back = np.zeros((min(buckets, m), m), dtype=np.int32)
    for k in range(1, len(back)):
        new, choice = _layer(best, lengths.astype(np.float64), items, tokens)
        better = new < best
        back[k, better] = choice[better] + 1
        best = np.where(better, new, best)
    out, j = [], m - 1
    for k in range(len(back) - 1, -1, -1):
        out.append(int(lengths[j]))
        j = back[k, j] - 1
        if j < 0:
            break
    return sorted(out)


def _layer(best: np.ndarray, lengths: np.ndarray, items: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """min over i < j of best[i] + padding of one bucket i + 1 .. j, and the i, for every j.

    The best i never falls as j grows, so halves of the range bound each other: all middles of a level at once.
    """
    m = len(best)
    new, choice = np.full(m, np.inf), np.zeros(m, dtype=np.int32)
    lo, hi, i_lo, i_hi = (np.array([x]) for x in (1, m - 1, 0, m - 2))
    while len(lo):
        keep = lo <= hi
        lo, hi, i_lo, i_hi = lo[keep], hi[keep], i_lo[keep], i_hi[keep]
        if not len(lo):
            break
        j = (lo + hi) // 2
        n = np.minimum(i_hi, j - 1) - i_lo + 1
        start = np.cumsum(n) - n
        i = np.arange(n.sum()) - np.repeat(start - i_lo, n)
        at = np.repeat(j, n)
        cost = best[i] + lengths[at] * (items[at + 1] - items[i + 1]) - (tokens[at + 1] - tokens[i + 1])
        least = np.minimum.reduceat(cost, start)
        hit = np.flatnonzero(cost == np.repeat(least, n))
        segment = np.repeat(np.arange(len(j)), n)[hit]
        i = i[hit[np.unique(segment, return_index=True)[1]]]
        new[j], choice[j] = least, i
        lo, hi, i_lo, i_hi = np.r_[lo, j + 1], np.r_[j - 1, hi], np.r_[i_lo, i], np.r_[i, i_hi]
    return new, choice


@dataclass
class Plan:
    """segments: (bucket, first rank, items a batch, first batch, batches); batches; and unused shares."""

    bounds: list[int]
    segments: list[tuple[int, int, int, int, int]]
    batches: int
    unused_one_bucket: float


def plan(counts: np.ndarray, capacity: int, buckets: int) -> Plan:
    """How to fill batches of the capacity with items of which counts[i] have length i."""
    bounds = length_buckets(counts, buckets)
    held = [int(counts[(bounds[b - 1] if b else 0) + 1 : bounds[b] + 1].sum()) for b in range(len(bounds))]
    # Open classes of equal batches: room -> list of (contents, how many).
    rooms: list[int] = []
    classes: dict[int, list[tuple[dict[int, int], int]]] = {}

    def put(room: int, contents: dict[int, int], n: int) -> None:
        if n:
            if room not in classes:
                bisect.insort(rooms, room)
            classes.setdefault(room, []).append((contents, n))

    for b in range(len(bounds) - 1, -1, -1):
        size, left = bounds[b], held[b]
        while left:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                fit = capacity // size
                full, rest = divmod(left, fit)
                put(capacity - fit * size, {b: fit}, full)
                if rest:
                    put(capacity - rest * size, {b: rest}, 1)
                break
            room = rooms[at]
            contents, n = classes[room].pop()
            if not classes[room]:
                del classes[room], rooms[at]
            fit = min(room // size, left)
            whole = min(n, left // fit)
            put(room, contents, n - whole)
            put(room - fit * size, contents | {b: contents.get(b, 0) + fit}, whole)
            left -= fit * whole
    segments, first, ranks = [], 0, [0] * len(bounds)
    for room in sorted(classes):
        for contents, n in classes[room]:
            for b, per in sorted(contents.items()):
                segments.append((b, ranks[b], per, first, n))
                ranks[b] += per * n
            first += n
    alone = sum(-(-h // (capacity // s)) for h, s in zip(held, bounds))
    total = float((counts * np.arange(len(counts))).sum())
    return Plan(bounds, segments, first, 1 - total / (alone * capacity) if alone else 0.0)


def pieces(items: DataFrame, item: str, size: str, capacity: int) -> DataFrame:
    """item, piece_no, token_start, tokens: items above the capacity cut into full pieces and a rest."""
    n = F.ceil(F.col(size) / capacity).cast("int")
    return (
        items.where(F.col(size) > 0)
        .select(F.col(item).alias("item"), F.col(size).alias("size"), F.explode(F.sequence(F.lit(0), n - 1)).alias("piece_no"))
        .select("item", "piece_no", (F.col("piece_no") * F.lit(capacity).cast("long")).alias("token_start"), F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("piece_no") * F.lit(capacity)).alias("tokens"))
    )


def pack(items: DataFrame, item: str, size: str, capacity: int, buckets: int = 256, rows_per_shard: int = 50_000) -> tuple[DataFrame, Plan]:
    """pack_id, item, piece_no, token_start, tokens; and the plan. items should be cheap to read twice."""
    spark = items.sparkSession
    cut = pieces(items, item, size, capacity)
    # At most `capacity` rows come to the driver.
    histogram = cut.groupBy(F.col("tokens").cast("int").alias("tokens")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    counts = np.zeros(capacity + 1, dtype=np.int64)
    counts[histogram["tokens"].to_numpy(dtype=np.int64)] = histogram["n"].to_numpy(dtype=np.int64)
    made = plan(counts, capacity, buckets)
    if not made.segments:
        return cut.where("false").select(F.lit(0).cast("long").alias("pack_id"), "item", "piece_no", "token_start", "tokens"), made
    shards = max(1, -(-int(counts.sum()) // rows_per_shard))
    bound_of = np.searchsorted(made.bounds, np.arange(capacity + 1)).tolist()
    bucket = F.element_at(F.array(*[F.lit(x) for x in bound_of]), (F.col("tokens") + 1).cast("int")) if capacity < 256 else None
    if bucket is None:  # a literal of the bounds, searched by counting the smaller ones
        bounds = F.lit(made.bounds)
        bucket = F.size(F.filter(bounds, lambda x: x < F.col("tokens")))
    placed = cut.withColumn("bucket", bucket).withColumn("shard", F.pmod(F.xxhash64("item", "piece_no"), F.lit(shards)))
    local = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("item", "piece_no"))
    ranked = placed.withColumn("local", local - 1)
    before = F.sum("n").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = placed.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("n")).withColumn("offset", F.coalesce(before, F.lit(0))).drop("n")
    per_bucket: dict[int, list[tuple[int, int, int]]] = {}
    for b, rank, per, first, _ in made.segments:
        per_bucket.setdefault(b, []).append((rank, per, first))
    table = spark.createDataFrame([(b, s) for b, s in per_bucket.items()], "seg_bucket int, segs array<struct<rank:long,per:long,first:long>>")
    # One row a bucket, as many segments as the plan has patterns: bounded by the capacity, not by the items.
    where = offsets.join(F.broadcast(table), F.col("bucket") == F.col("seg_bucket")).drop("seg_bucket")
    found = ranked.join(where, ["bucket", "shard"]).withColumn("rank", F.col("local") + F.col("offset"))
    seg = F.element_at(F.filter("segs", lambda s: s["rank"] <= F.col("rank")), -1)
    pack_id = seg["first"] + F.floor((F.col("rank") - seg["rank"]) / seg["per"])
    return found.select(pack_id.cast("long").alias("pack_id"), "item", "piece_no", "token_start", "tokens"), made
