"""Exact statistics that do not gather a group in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_median(
    counts: DataFrame, keys: Sequence[str], value: str, weight: str, width: int
) -> DataFrame:
    """One row per key: `median` (DOUBLE) of a non-negative BIGINT value, and its weight `n`.

    `counts` holds one row per (keys, value) with a weight. Values are first counted in bins of
    `width`; only the one or two bins that hold the middle ranks are then read value by value, so
    a window never sees more rows of a key than there are bins, or values in a bin.
    """
    keys = list(keys) or ["_all"]
    if keys == ["_all"]:
        counts = counts.withColumn("_all", F.lit(0))
    binned = counts.select(
        *keys, value, weight, F.expr(f"cast({value} div {int(width)} as bigint)").alias("_bin")
    )
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = (
        binned.groupBy(*keys, "_bin")
        .agg(F.sum(weight).alias("_w"))
        .withColumn("n", F.sum("_w").over(whole))
        .withColumn("_before", F.sum("_w").over(upto) - F.col("_w"))
        .withColumn("_lo", F.expr("(n - 1) div 2"))
        .withColumn("_hi", F.expr("n div 2"))
    )
    middle = bins.filter(_holds("_lo", "_before", "_w") | _holds("_hi", "_before", "_w")).drop("_w")
    inside = (
        Window.partitionBy(*keys, "_bin")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = binned.join(middle, [*keys, "_bin"]).withColumn(
        "_start", F.col("_before") + F.sum(weight).over(inside) - F.col(weight)
    )
    low = F.max(F.when(_holds("_lo", "_start", weight), F.col(value)))
    high = F.max(F.when(_holds("_hi", "_start", weight), F.col(value)))
    result = ranked.groupBy(*keys).agg(
        ((low.cast("double") + high.cast("double")) / F.lit(2.0)).alias("median"),
        F.max("n").alias("n"),
    )
    return result.drop("_all")


def _holds(rank: str, start: str, weight: str) -> Column:
    return (F.col(start) <= F.col(rank)) & (F.col(rank) < F.col(start) + F.col(weight))


def pearson(x: str, y: str) -> Column:
    """Pearson r of two DOUBLE columns, NULL when either does not vary."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.round(F.covar_pop(x, y) / F.when(spread != 0, spread), 12)


def largest(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows. Spark knows the limit, and chooses the join by the size it proves."""
    return df.orderBy(*order).limit(n)


def share(part: Column, whole: Column) -> Column:
    """part / whole as DOUBLE, NULL when the whole is zero."""
    whole = whole.cast("double")
    return part.cast("double") / F.when(whole != 0, whole)
