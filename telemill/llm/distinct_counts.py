"""Distinct counts of huge identifier sets by multiresolution bitmaps.

An identifier's hash picks a geometric level (level i gets a share of
2^-(i+1)) and a bit of that level's bitmap. A sketch is kept sparse, as rows
(group, level, word, bits): partial results merge by OR, which Spark combines on
the map side, and a group with few identifiers has few rows. The estimate adds
linear counts of the levels from the first unsaturated one and scales them up.
With 16,384 bits a level and saturation at 75 % the relative standard error is
at most 1 % at any scale (STANDARD_ERROR); far below 16,384 identifiers it is
smaller, at most 0.72 % from collisions alone; a set of a few users is off by
whole users where two of them collide, which happens to one group in thousands.

Scale: identifiers are OR-ed into words before the first shuffle, so a hot
identifier or group is one row per partition. Words are then placed by
(period, level, word): all group combinations of a word are formed and merged
inside that partition without moving the expanded rows; only bit counts are
shuffled afterwards.

Defined results: null identifiers count nowhere; a null grouping value belongs
only to combinations that leave its column out; an empty input gives an empty
result; repeated rows change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 16_384
LEVELS = 24
SATURATED = int(0.75 * BITS)
STANDARD_ERROR = 0.01


def sketch(rows: DataFrame, groups: list[str], identifier: str) -> DataFrame:
    """groups, level, word, bits of the identifiers in rows."""
    h = F.xxhash64(identifier)
    low = h.bitwiseAND(F.lit(0x7FFFFFFF))
    level = F.least(F.bit_count(F.bitwise_not(low).bitwiseAND(low - 1)), F.lit(LEVELS - 1))
    position = F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(BITS - 1))
    return (
        rows.where(F.col(identifier).isNotNull())
        .select(*groups, level.alias("level"), F.shiftright(position, 6).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), position.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
        .groupBy(*groups, "level", "word")
        .agg(F.bit_or("bit").alias("bits"))
    )


def merge(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """The union of partial sketches."""
    return sketches.groupBy(*groups, "level", "word").agg(F.bit_or("bits").alias("bits"))


def combinations(sketches: DataFrame, period: str, dims: list[str]) -> DataFrame:
    """Sketches of every combination of dims: column combo has bit i set where dims[i] is kept, else it is null."""
    n = len(dims)
    kept = [i for i in range(2**n)]
    usable = F.array(*[F.when(F.lit(True) if not i else _all([F.col(d).isNotNull() for b, d in enumerate(dims) if i >> b & 1]), F.lit(i)) for i in kept])
    placed = sketches.repartition(period, "level", "word").withColumn("combo", F.explode(F.array_compact(usable)))
    chosen = {d: F.when(F.col("combo").bitwiseAND(F.lit(1 << b)) != 0, F.col(d)) for b, d in enumerate(dims)}
    return merge(placed.withColumns(chosen), [period, "combo", *dims])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def estimate(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """groups, users (estimated distinct identifiers), rel_error (its standard error), at_least, at_most (six of these; of collisions in small sets)."""
    ones = sketches.groupBy(*groups).agg(*[F.sum(F.when(F.col("level") == i, F.bit_count("bits")).otherwise(0)).alias(f"o{i}") for i in range(LEVELS)])
    o = [F.col(f"o{i}") for i in range(LEVELS)]
    base = F.greatest(*[F.when(o[i] > SATURATED, F.lit(i + 1)).otherwise(F.lit(0)) for i in range(LEVELS)])
    # Each step is a projection of its own: Spark copies no computed column that is used more than once, whereas as one Column
    # the first level would be copied into every use of every later figure, a plan of a megabyte and more for the driver.
    steps = ones.withColumn("o_base", F.least(base, F.lit(LEVELS - 1)))
    base, users, error, mean, spread = (F.col(c) for c in ("o_base", "users", "rel_error", "o_mean", "o_spread"))
    linear = [-BITS * F.log1p(-F.least(c, F.lit(BITS - 1)) / BITS) for c in o]
    total = sum((F.when(base <= i, x).otherwise(0.0) for i, x in enumerate(linear)), F.lit(0.0))
    # Without saturation only the collisions of the first levels err: sqrt(e^p - p - 1) / (p sqrt(bits)) at load p, here its bound for p <= 1.4.
    steps = steps.withColumn("users", total * F.pow(F.lit(2.0), base)).withColumn("rel_error", F.when(base == 0, F.lit(0.0072)).otherwise(F.lit(STANDARD_ERROR)))
    # Small sets are off by whole users only: their estimate misses the mean of the collisions less those that were.
    # Without collisions it is too large by that mean, with j of them too small by j less the mean; j is Poisson.
    steps = steps.withColumn("o_mean", users * users / (6.0 * BITS))
    steps = steps.withColumn("o_spread", F.when(base == 0, F.least(6.0 * error * users, 6.0 * F.sqrt(mean))).otherwise(6.0 * error * users))
    # The mean follows from how the identifiers fell to the levels: six standard deviations of that, and its next term.
    fall = 6.0 * F.pow(users, 1.5) / (4.0 * BITS) + F.pow(users, 3.0) / (21.0 * BITS * BITS)
    below = F.when(base == 0, F.least(spread + 0.01, mean + fall + 0.01)).otherwise(spread)
    # So many collisions come at most with a probability of 0.9999, where they are too few for a normal distribution.
    rare = F.when(mean < 0.014, 1.0).when(mean < 0.08, 2.0).when(mean < 0.2, 3.0)
    above = F.when(base == 0, F.coalesce(rare, spread + 1.0)).otherwise(spread)
    return steps.select(*groups, users, error, (users - below).alias("at_least"), (users + above).alias("at_most"))
