"""Exact interpolated quantiles per group without gathering a group.

``percentile`` keeps every distinct value of a group in one buffer. Here the distinct values of all
groups are counted once, dealt by value, and the wanted ranks are found by splitting the range of
values again and again:

1. monotone buckets, ``BUCKETS_PER_OCTAVE`` per power of two, tell which bucket holds each wanted rank;
2. such a bucket is split into ``PARTS`` equal parts between its least and its greatest value, which
   tell the part;
3. the values of that part are ranked. A bucket spans at most 2^44 neighbouring doubles, so a part has
   at most some 2^23 different values whatever the data.

So every window has a bounded number of rows. All of it is one plan: nothing runs before an action,
and the three steps read the same shuffled counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS_PER_OCTAVE = 1 << 8
PARTS = 1 << 21
_OFFSET = 1100 * BUCKETS_PER_OCTAVE  # above |log2| of every double, so buckets keep their sign


def bucket_of(v: Column) -> Column:
    """A bucket number that never decreases when the value increases."""
    octave = F.when(F.abs(v) == float("inf"), F.lit(1025.0)).otherwise(F.log2(F.abs(v)))
    magnitude = F.lit(_OFFSET) + F.floor(octave * F.lit(float(BUCKETS_PER_OCTAVE)))
    return F.when(v == 0, F.lit(0)).when(v > 0, magnitude).otherwise(-magnitude).cast("int")


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on keys that may be null, keeping the left copy of the keys."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def exact_quantiles(
    df: DataFrame, by: Sequence[str], quantiles: dict[str, tuple[str, float]]
) -> DataFrame:
    """One row per group with linearly interpolated quantiles.

    ``quantiles`` maps an output column to (value column, probability). Nulls and NaN are
    ignored; a group without any other value has no row.
    """
    by = list(by)
    value_columns = sorted({column for column, _ in quantiles.values()})
    wanted = [(out, value_columns.index(column), p) for out, (column, p) in quantiles.items()]
    # long form: one row per (group, measure, value), so several measures share the passes
    long = df.select(
        *by,
        F.explode(
            F.array(*[
                F.struct(F.lit(i).alias("__m"), F.col(c).cast("double").alias("__v"))
                for i, c in enumerate(value_columns)
            ])
        ).alias("__mv"),
    ).select(*by, F.col("__mv.__m").alias("__m"), (F.col("__mv.__v") + F.lit(0.0)).alias("__v"))
    keys = [*by, "__m"]
    counts = long.where(F.col("__v").isNotNull() & ~F.isnan("__v")).groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))

    def holds_wanted(start: Column, end: Column) -> Column:
        hit = F.lit(False)
        for _, m, p in wanted:
            low, high = _ranks(F.col("__n"), p)
            hit = hit | ((F.col("__m") == m) & (_holds(low, start, end) | _holds(high, start, end)))
        return hit

    whole = Window.partitionBy(*keys)
    buckets = (
        counts.groupBy(*keys, bucket_of(F.col("__v")).alias("__b"))
        .agg(F.sum("__c").alias("__c"), F.min("__v").alias("__least"), F.max("__v").alias("__most"))
        .withColumn("__n", F.sum("__c").over(whole))
        .withColumn("__end", F.sum("__c").over(whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("__start", F.col("__end") - F.col("__c"))
        .where(holds_wanted(F.col("__start"), F.col("__end")))
        .select(*keys, "__b", "__start", "__n", "__least", "__most")
    )
    span = F.col("__most") - F.col("__least")
    part = F.when(F.col("__most") > F.col("__least"), F.floor((F.col("__v") - F.col("__least")) / span * F.lit(float(PARTS)))).otherwise(F.lit(0)).cast("int")
    bucket = Window.partitionBy(*keys, "__b")
    parts = (
        join_on(counts.withColumn("__b", bucket_of(F.col("__v"))), buckets, [*keys, "__b"], "inner")
        .groupBy(*keys, "__b", "__start", "__n", part.alias("__p"))
        .agg(F.sum("__c").alias("__c"), F.collect_list(F.struct("__v", "__c")).alias("__values"))
        .withColumn("__end", F.col("__start") + F.sum("__c").over(bucket.orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("__start", F.col("__end") - F.col("__c"))
        .where(holds_wanted(F.col("__start"), F.col("__end")))
    )
    inside = Window.partitionBy(*keys, "__b", "__p").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        parts.select(*keys, "__b", "__p", "__start", "__n", F.inline("__values"))
        .withColumn("__to", F.col("__start") + F.sum("__c").over(inside))
        .withColumn("__from", F.col("__to") - F.col("__c"))
    )
    picks = []
    for out, m, p in wanted:
        low, high = _ranks(F.col("__n"), p)
        mine = F.col("__m") == m
        at = (F.col("__n") - 1).cast("double") * F.lit(p)
        picks += [
            F.max(F.when(mine & _holds(low, F.col("__from"), F.col("__to")), F.col("__v"))).alias(f"__lo_{out}"),
            F.max(F.when(mine & _holds(high, F.col("__from"), F.col("__to")), F.col("__v"))).alias(f"__hi_{out}"),
            F.max(F.when(mine, at - F.floor(at))).alias(f"__f_{out}"),
        ]
    grouped = ranked.groupBy(*by).agg(*picks)
    return grouped.select(
        *by,
        *[
            _between(F.col(f"__lo_{out}"), F.col(f"__hi_{out}"), F.col(f"__f_{out}"), p).alias(out)
            for out, _, p in wanted
        ],
    )


def approx_quantiles(
    df: DataFrame, by: Sequence[str], quantiles: dict[str, tuple[str, float]], accuracy: int = 10_000
) -> DataFrame:
    """One pass with bounded sketches, for when the exact value is not needed."""
    return df.groupBy(*by).agg(
        *[F.percentile_approx(c, p, accuracy).cast("double").alias(out) for out, (c, p) in quantiles.items()]
    )


def _ranks(n: Column, p: float) -> tuple[Column, Column]:
    at = (n - 1).cast("double") * F.lit(p)
    return F.floor(at), F.ceil(at)


def _between(low: Column, high: Column, fraction: Column, p: float) -> Column:
    """Linear interpolation; the median is the mean of the two middle values."""
    if p == 0.5:
        return F.when(fraction == 0, low).otherwise((low + high) / 2.0)
    step = high - low
    same = F.when(low == high, low)  # infinities have no step
    return F.when(same.isNotNull(), same).when(fraction >= 0.5, high - step * (1.0 - fraction)).otherwise(low + step * fraction)


def _holds(rank: Column, start: Column, end: Column) -> Column:
    return (rank >= start) & (rank < end)
