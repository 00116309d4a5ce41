"""Joins with one row per file, where one file may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronicle.session import staged

SALTS = 64
FEW = 1000  # facts that may all be repeated
LARGE = 100_000  # rows of a key that one task may get


def join_facts(rows: DataFrame, facts: DataFrame, on: str, how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """Join `facts` (one row per key) to rows that have a `block`.

    A plain join would bring all rows of a key to one task, and windows by (key, block) behind it
    would keep them there. So facts are repeated under 64 salts, and the blocks of a key are spread
    over the salts. Where there are many keys, only those with many rows are; `counted` is a cheaper frame with
    as many rows of each key, if there is one. Facts are written first: Spark knows their size in files and
    broadcasts them by its own limit instead of shuffling the rows.
    """
    spread, repeated = salted(rows, staged(facts), on, rows if counted is None else counted)
    return spread.join(repeated, [on, "_salt"], how).drop("_salt")


def salted(rows: DataFrame, facts: DataFrame, on: str, counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the salt of their block, and facts repeated under the salts of their key."""
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    salt = F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int")
    if facts.limit(FEW + 1).count() <= FEW:
        return rows.withColumn("_salt", salt), facts.withColumn("_salt", F.explode(every))
    # One row for 100,000 rows at most.
    large = staged(counted.groupBy(on).count().filter(F.col("count") > LARGE).select(on, F.lit(True).alias("_large")))
    is_large = F.coalesce("_large", F.lit(False))
    spread = rows.join(F.broadcast(large), on, "left").withColumn("_salt", F.when(is_large, salt).otherwise(0))
    repeated = facts.join(F.broadcast(large), on, "left").withColumn(
        "_salt", F.explode(F.when(is_large, every).otherwise(F.array(F.lit(0))))
    )
    return spread.drop("_large"), repeated.drop("_large")
