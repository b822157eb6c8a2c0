"""Exact medians and ranks that no single task has to hold.

``median`` and ``percentile`` keep every distinct value of a group in one
reducer, and a rank window puts a whole group in one task.  Groups here are as
coarse as one observation offset, so both are replaced by a two-step count:
values fall into monotone buckets, bucket totals (a bounded number of rows) give
each bucket's starting rank, and only values of one bucket are ordered together.
Bucket bounds are quantiles a mergeable sketch estimates, so values that lie close
together are parted as well as others; an estimate shifts bounds, never a result.

A value finds its bucket in a two-level index: first among every sixteenth bound, then
among the fifteen between two of those, thirty compiled comparisons in all.  Keys are
few (an offset, a half or a cell, times a handful of columns), so bounds and bucket
totals, BUCKETS rows a key, are broadcast and the values stay where they are.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a key; a task orders about this part of a key's distinct values.
BUCKETS = 256
#: Bounds between two of the coarse level.
STEP = 16


def _bucketed(values: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Append ``_bucket``, a number that never decreases as the value grows within a key."""
    shares = F.array(*[F.lit(k / BUCKETS) for k in range(1, BUCKETS)])
    bounds = values.groupBy(*keys).agg(F.percentile_approx(column, shares, 20 * BUCKETS).alias("_bounds"))

    def above(index) -> Column:
        return F.when(F.get("_bounds", index) < F.col(column), 1).otherwise(0)

    coarse = sum(above(F.lit(k - 1)) for k in range(STEP, BUCKETS, STEP))
    fine = sum(above(F.col("_coarse") * STEP + k) for k in range(STEP - 1))
    return (values.join(F.broadcast(bounds), keys).withColumn("_coarse", coarse)
            .withColumn("_bucket", F.col("_coarse") * STEP + fine).drop("_bounds", "_coarse"))


def _bucket_totals(values: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("_bucket")
    whole = Window.partitionBy(*keys)
    return (
        values.groupBy(*keys, "_bucket").agg(F.sum(weight).alias("_in_bucket"))
        .withColumn("_through", F.sum("_in_bucket").over(order))
        .withColumn("n", F.sum("_in_bucket").over(whole))
        .withColumn("_before", F.col("_through") - F.col("_in_bucket"))
    )


def middle_values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key: ``n``, the order statistics around the middle, and the median.

    With ``k = n div 2`` the columns ``below``, ``middle`` and ``above`` hold the
    values at ranks ``k``, ``k+1`` and ``k+2`` (null outside 1..n).  They are all a
    leave-one-out median needs.
    """
    values = _bucketed(df.where(F.col(value).isNotNull())
                       .select(*keys, F.col(value).cast("double").alias("_v")), keys, "_v")
    k = F.floor(F.col("n") / 2)
    wanted = (
        _bucket_totals(values, keys, F.lit(1))
        .where((F.col("_through") >= F.greatest(k, F.lit(1)))
               & (F.col("_before") < F.least(k + 2, F.col("n"))))
        .select(*keys, "_bucket", "n", "_before")
    )
    counted = (
        values.join(F.broadcast(wanted), [*keys, "_bucket"])
        .groupBy(*keys, "n", "_bucket", "_before", "_v").agg(F.count(F.lit(1)).alias("_c"))
    )
    in_bucket = Window.partitionBy(*keys, "_bucket").orderBy("_v")
    ranked = (counted
              .withColumn("_hi", F.col("_before") + F.sum("_c").over(in_bucket))
              .withColumn("_lo", F.col("_hi") - F.col("_c")))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_lo") < rank) & (rank <= F.col("_hi")), F.col("_v")))

    stats = ranked.groupBy(*keys, "n").agg(
        at(k).alias("below"), at(k + 1).alias("middle"), at(k + 2).alias("above"))
    return stats.withColumn(
        "median",
        F.when(F.col("n") % 2 == 1, F.col("middle"))
        .otherwise((F.col("below") + F.col("middle")) / 2))


def _middle_long(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """``middle_values`` of several columns in one pass, keyed by output name."""
    pairs = F.array(*[F.struct(F.lit(out).alias("_metric"),
                               F.col(src).cast("double").alias("_x"))
                      for src, out in columns.items()])
    long = df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p._metric", "_p._x")
    return middle_values(long, [*keys, "_metric"], "_x")


def middle_columns(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per key with ``{column}_n``, ``_below``, ``_middle``, ``_above`` and ``_median``."""
    middle = _middle_long(df, keys, {c: c for c in columns})
    return middle.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_metric") == c, F.col(part))).alias(f"{c}_{part}")
        for c in columns for part in ("n", "below", "middle", "above", "median")])


def medians(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """One row per key with the exact median of each column (``{source: output}``)."""
    middle = _middle_long(df, keys, columns)
    return middle.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_metric") == out, F.col("median"))).alias(out)
        for out in columns.values()])


def loo_median(n: Column, below: Column, middle: Column, above: Column, removed: Column) -> Column:
    """Median after removing one member, from the order statistics around the middle."""
    odd = (F.when(removed < middle, (middle + above) / 2)
           .when(removed > middle, (below + middle) / 2)
           .otherwise((below + above) / 2))
    even = F.when(removed <= below, middle).otherwise(below)
    return F.when(n <= 1, F.lit(None).cast("double")).when(n % 2 == 1, odd).otherwise(even)


def average_ranks(df: DataFrame, keys: list[str], value: str, output: str) -> DataFrame:
    """Append the 1-based rank within the key, ties sharing their mean rank."""
    counted = _bucketed(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")), keys, value)
    totals = _bucket_totals(counted, keys, F.col("_c")).select(*keys, "_bucket", "_before")
    in_bucket = Window.partitionBy(*keys, "_bucket").orderBy(value)
    ranks = (counted.join(F.broadcast(totals), [*keys, "_bucket"])
             .withColumn("_hi", F.col("_before") + F.sum("_c").over(in_bucket))
             .select(*keys, value, (F.col("_hi") - (F.col("_c") - 1) / 2).alias(output)))
    return df.join(ranks, [*keys, value])
