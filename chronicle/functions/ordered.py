"""Order-dependent values that stay spread over tasks when one key holds most rows.

A window over a key sorts all rows of that key in one task. These helpers cut each key into
consecutive segments (an hour, a file block), work inside a segment, and carry one row per
segment across the boundaries. `segment` must ascend with `order`; keys and segments are not NULL,
so the join back uses the partitioning that the window already made.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def previous_values(
    df: DataFrame, keys: Sequence[str], segment: str, order: Sequence[str], values: dict[str, str]
) -> DataFrame:
    """Add `values[column]` = the column's value on the previous row of the key, or NULL."""
    columns = list(values)
    inside = Window.partitionBy(*keys, segment).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(segment)
    last = F.max_by(F.struct(*columns), F.struct(*order))
    carry = (
        df.groupBy(*keys, segment)
        .agg(last.alias("_last"))
        .select(*keys, segment, F.lag("_last").over(across).alias("_carry"))
    )
    rows = df.withColumn("_row", F.row_number().over(inside))
    for column in columns:
        rows = rows.withColumn("_in_" + column, F.lag(column).over(inside))
    # The rows lie by key and segment already; a plan that broadcasts them instead, by a guess at their size, is ruled out.
    rows = rows.join(carry.hint("merge"), [*keys, segment])
    for column, name in values.items():
        rows = rows.withColumn(
            name,
            F.when(F.col("_row") == 1, F.col("_carry")[column]).otherwise(F.col("_in_" + column)),
        )
    return rows.drop("_row", "_carry", *("_in_" + column for column in columns))


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    segment: str,
    order: Sequence[str],
    increment: Column,
    name: str,
) -> DataFrame:
    """Add `name` = the sum of `increment` over the key's rows up to and including this one."""
    return running_totals(df, keys, segment, order, {name: increment})


def running_totals(
    df: DataFrame, keys: Sequence[str], segment: str, order: Sequence[str], increments: dict[str, Column]
) -> DataFrame:
    """The running total of each increment under its name, all from one pass."""
    inside = (
        Window.partitionBy(*keys, segment)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    earlier = (
        Window.partitionBy(*keys).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = df.withColumns({f"_inc_{name}": increment.cast("bigint") for name, increment in increments.items()})
    offsets = (
        rows.groupBy(*keys, segment)
        .agg(*(F.sum(f"_inc_{name}").alias(f"_inc_{name}") for name in increments))
        .select(
            *keys,
            segment,
            *(
                F.coalesce(F.sum(f"_inc_{name}").over(earlier), F.lit(0).cast("bigint")).alias(f"_offset_{name}")
                for name in increments
            ),
        )
    )
    rows = rows.withColumns({f"_inside_{name}": F.sum(f"_inc_{name}").over(inside) for name in increments})
    rows = rows.join(offsets.hint("merge"), [*keys, segment])
    rows = rows.withColumns({name: F.col(f"_inside_{name}") + F.col(f"_offset_{name}") for name in increments})
    return rows.drop(*(f"_{part}_{name}" for part in ("inc", "inside", "offset") for name in increments))
