"""A mix of sources with target shares of its size, by Sainte-Lague apportionment.

The mix is counted in equal-token blocks. Blocks go to sources by the highest
quotients weight / (2 n + 1), with the weights of the targets; each source can
give at most its tokens times its cap on repeats. A source's blocks are then
divided among its shards the same way, which gives an integer quota for each
(source, shard), and every shard takes its documents in a seeded order, all of
them as often as the quota holds them and then the first ones once more.

Without a given total the mix is as large as it can be with every source that has
documents at its target; a source without documents leaves its share to the others.
With a larger given total, capped sources give all they may and the rest is
apportioned to the others.

Scale: only totals per source (one row a target) come to the driver; quotas per
shard are computed per source over shard totals; documents are ordered inside
(source, shard), which holds at most about rows_per_shard documents however hot
a source is.

Defined results: sources are compared trimmed, in lower case, with - as _; null
sources and those without a target take no part; documents of size null, zero
or less take no part; an empty input gives an empty mix.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.functions.frames import frame

SEED = 7


def source_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "-", "_")


def sainte_lague(weights: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by highest quotients w / (2 n + 1), none above its cap; of equal quotients the first wins."""
    got = [0] * len(weights)
    live = [i for i, w in enumerate(weights) if w > 0 and caps[i] > 0]
    left = seats
    # Whole blocks of seats at once: rounding down never gives more than the quotients would.
    while live and left > 4 * len(live):
        total = sum(weights[i] for i in live)
        target = {i: min(caps[i], int((left + sum(got[j] for j in live)) * weights[i] / total) - 1) for i in live}
        step = {i: max(0, target[i] - got[i]) for i in live}
        if not sum(step.values()):
            break
        for i in live:
            got[i] += step[i]
        left = seats - sum(got)
        live = [i for i in live if got[i] < caps[i]]
    heap = [(-weights[i] / (2 * got[i] + 1), i) for i in live]
    heapq.heapify(heap)
    while left > 0 and heap:
        _, i = heapq.heappop(heap)
        got[i] += 1
        left -= 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def mix(
    documents: DataFrame,
    doc_id: str,
    source: str,
    size: str,
    targets: list[tuple[str, float, int]],
    total: int | None = None,
    block_tokens: int = 512,
    rows_per_shard: int = 50_000,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, source, tokens, repeats of every document that is used. documents should be cheap to read twice.

    targets: (source, target share, most repeats), the source as source_name() gives it.
    """
    spark = documents.sparkSession
    wanted = {s: (float(w or 0), int(r or 0)) for s, w, r in targets if s is not None}
    docs = documents.select(F.col(doc_id).alias("doc_id"), source_name(F.col(source)).alias("source"), F.col(size).cast("long").alias("tokens")).where((F.col("tokens") > 0) & F.col("source").isin(*wanted))
    sums = {r["source"]: (r["n"], r["t"]) for r in docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t")).collect()}
    names = [s for s in wanted if s in sums and wanted[s][0] > 0 and wanted[s][1] > 0]
    shares = sum(wanted[s][0] for s in names)
    most = {s: sums[s][1] * wanted[s][1] for s in names}
    if total is None:
        total = int(min((most[s] * shares / wanted[s][0] for s in names), default=0))
    seats = sainte_lague([wanted[s][0] for s in names], max(1, total // block_tokens), [most[s] // block_tokens for s in names]) if names else []
    shards = max(1, -(-sum(n for n, _ in sums.values()) // rows_per_shard))
    given = spark.createDataFrame([(s, k, wanted[s][1]) for s, k in zip(names, seats)], "source string, blocks long, cap int")
    placed = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(shards)))

    def divide(pdf: pd.DataFrame) -> pd.DataFrame:
        held, blocks, cap = pdf["held"].tolist(), int(pdf["blocks"].iloc[0]), int(pdf["cap"].iloc[0])
        got = sainte_lague([float(h) for h in held], blocks, [-(-h * cap // block_tokens) for h in held])
        # A source at its cap gives everything, beyond whole blocks too.
        everything = blocks >= sum(held) * cap // block_tokens
        quota = [h * cap if everything else min(g * block_tokens, h * cap) for g, h in zip(got, held)]
        return frame({"source": pdf["source"].iloc[0], "shard": pdf["shard"].to_numpy(), "held": pdf["held"].to_numpy(), "quota": np.asarray(quota, dtype=np.int64)})

    quotas = placed.groupBy("source", "shard").agg(F.sum("tokens").alias("held")).join(F.broadcast(given), "source").groupBy("source").applyInPandas(divide, "source string, shard long, held long, quota long")
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "tokens")
    running = placed.withColumn("before", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    used = running.join(quotas, ["source", "shard"])
    full = F.floor(F.col("quota") / F.col("held"))
    # Once more as long as at least half of the document lies within the quota.
    extra = F.when(F.col("before") + F.col("tokens") / 2 <= F.col("quota") - full * F.col("held"), 1).otherwise(0)
    return used.select("doc_id", "source", "tokens", (full + extra).cast("int").alias("repeats")).where("repeats > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, documents, tokens, share: what the mix reached for every target."""
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"))
    every = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").join(got, "source", "left").na.fill(0, ["documents", "tokens"])
    total = F.sum("tokens").over(Window.partitionBy())
    return every.withColumn("share", F.coalesce(F.try_divide("tokens", total), F.lit(0.0)))
