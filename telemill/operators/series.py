"""Running statistics along each service: z-scores and exponential averages.

Both are computed chunk by chunk of a service's time line, with the state at
the chunk's start carried over from the small table of chunk totals, so a
service that holds a third of all rows is spread over its chunks.

Defined results: rows are ordered by time and tie-break; null values are left
out by the caller; a first row or a scatter up to 1e-9 has z-score 0; the
average starts from 0; empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The chunk of all rows of earlier calls.
_BEFORE = -(2**62)


def running_zscore(rows: DataFrame, key: str, order: list[str], features: list[str], chunk_s: int = 86_400, slot=None) -> DataFrame:
    """rows with z_<feature>: (x - mean) / sample deviation over all rows so far, this one included.

    slot (get, put): the totals of the rows of earlier calls, on streams.
    """
    chunked = rows.withColumn("chunk", F.floor(F.col(order[0]) / chunk_s))
    sums = chunked.groupBy(key, "chunk").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f).alias(f"s_{f}") for f in features], *[F.sum(F.col(f) * F.col(f)).alias(f"q_{f}") for f in features])
    if slot is not None:
        before = slot.get()
        sums = sums if before is None else sums.unionByName(before)
        slot.put(sums.groupBy(key).agg(F.lit(_BEFORE).alias("chunk"), *[F.sum(c).alias(c) for c in ["n", *[f"{p}_{f}" for p in "sq" for f in features]]]).where(F.col(key).isNotNull()))
    whole = Window.partitionBy(key)
    # Deviations from the key's mean keep the sums of squares well conditioned.
    centred = sums.withColumns({f"c_{f}": F.sum(f"s_{f}").over(whole) / F.sum("n").over(whole) for f in features})
    prior = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = centred.select(
        key, "chunk", F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("n0"), *[f"c_{f}" for f in features],
        *[F.coalesce(F.sum(F.col(f"s_{f}") - F.col("n") * F.col(f"c_{f}")).over(prior), F.lit(0.0)).alias(f"s0_{f}") for f in features],
        *[F.coalesce(F.sum(F.col(f"q_{f}") - 2 * F.col(f"c_{f}") * F.col(f"s_{f}") + F.col("n") * F.col(f"c_{f}") * F.col(f"c_{f}")).over(prior), F.lit(0.0)).alias(f"q0_{f}") for f in features],
    )
    so_far = Window.partitionBy(key, "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = chunked.join(carried, [key, "chunk"]).withColumn("n1", F.col("n0") + F.count(F.lit(1)).over(so_far))
    out = joined
    for f in features:
        d = F.col(f) - F.col(f"c_{f}")
        out = out.withColumns({f"s1_{f}": F.col(f"s0_{f}") + F.sum(d).over(so_far), f"q1_{f}": F.col(f"q0_{f}") + F.sum(d * d).over(so_far)})
    for f in features:
        mean = F.col(f"s1_{f}") / F.col("n1")
        sd = F.sqrt(F.greatest(F.try_divide(F.col(f"q1_{f}") - F.col("n1") * mean * mean, F.col("n1") - 1), F.lit(0.0)))
        out = out.withColumn(f"z_{f}", F.when((F.col("n1") < 2) | (sd <= 1e-9) | sd.isNull(), F.lit(0.0)).otherwise((F.col(f) - F.col(f"c_{f}") - mean) / sd))
    return out.select(*rows.columns, *[f"z_{f}" for f in features])


def exponential_average(rows: DataFrame, key: str, order: list[str], features: list[str], alpha: float, chunk_s: int = 86_400, slot=None) -> DataFrame:
    """rows with ema_<feature>: s = alpha x + (1 - alpha) s, from s = 0. alpha outside (0, 1] leaves the feature as it is.

    slot (get, put): the averages after the rows of earlier calls, on streams.
    """
    if not 0 < alpha <= 1:
        return rows.withColumns({f"ema_{f}": F.col(f).cast("double") for f in features})
    keep = 1.0 - alpha
    chunked = rows.withColumn("chunk", F.floor(F.col(order[0]) / chunk_s))
    w = Window.partitionBy(key, "chunk").orderBy(*order)
    # Older rows than this weigh less than a double can tell.
    import math

    back = 0 if keep == 0 else math.ceil(math.log(1e-18) / math.log(keep))
    # Averages start anew in every part of a chunk; what stands before is carried in by the parts' ends.
    size = min(max(back, 1), 512)
    in_part = Window.partitionBy(key, "chunk", "__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
    fold = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: alpha * x + keep * s)
    numbered = chunked.withColumn("__row", F.row_number().over(w)).withColumns({"__part": F.floor((F.col("__row") - 1) / size), "pos": (F.col("__row") - 1) % size + 1})
    parts = numbered.withColumns({f"e_{f}": fold(F.collect_list(F.col(f).cast("double")).over(in_part)) for f in features})
    part_ends = parts.groupBy(key, "chunk", "__part").agg(F.max("pos").alias("n"), *[F.max_by(f"e_{f}", "pos").alias(f"e_{f}") for f in features])
    earlier = Window.partitionBy(key, "chunk").orderBy("__part").rowsBetween(-(back // size) - 2, -1)
    before_part = lambda f: F.aggregate(F.collect_list(F.struct(F.col(f"e_{f}").alias("e"), F.col("n").alias("n"))).over(earlier), F.lit(0.0), lambda s, x: x["e"] + F.pow(F.lit(keep), x["n"].cast("double")) * s)
    joined = parts.join(part_ends.select(key, "chunk", "__part", *[before_part(f).alias(f"b_{f}") for f in features]), [key, "chunk", "__part"])
    local = joined.withColumns({f"e_{f}": F.col(f"e_{f}") + F.pow(F.lit(keep), F.col("pos").cast("double")) * F.col(f"b_{f}") for f in features}).withColumn("pos", F.col("__row"))
    ends = local.groupBy(key, "chunk").agg(F.max("pos").alias("n"), *[F.max_by(f"e_{f}", "pos").alias(f"e_{f}") for f in features])
    if slot is not None:
        before = slot.get()
        ends = ends if before is None else ends.unionByName(before)
        so_far = lambda f: F.aggregate(F.array_sort(F.collect_list(F.struct("chunk", F.col(f"e_{f}").alias("e"), "n"))), F.lit(0.0), lambda s, x: x["e"] + F.pow(F.lit(keep), x["n"].cast("double")) * s)
        slot.put(ends.groupBy(key).agg(F.lit(_BEFORE).alias("chunk"), F.sum("n").cast(ends.schema["n"].dataType).alias("n"), *[so_far(f).alias(f"e_{f}") for f in features]).where(F.col(key).isNotNull()))
    prior = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = lambda f: F.aggregate(F.collect_list(F.struct(F.col(f"e_{f}").alias("e"), F.col("n").alias("n"))).over(prior), F.lit(0.0), lambda s, x: x["e"] + F.pow(F.lit(keep), x["n"].cast("double")) * s)
    carried = ends.select(key, "chunk", *[carry(f).alias(f"k_{f}") for f in features])
    out = local.join(carried, [key, "chunk"])
    return out.select(*rows.columns, *[(F.col(f"e_{f}") + F.pow(F.lit(keep), F.col("pos").cast("double")) * F.col(f"k_{f}")).alias(f"ema_{f}") for f in features])
