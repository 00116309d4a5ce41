"""Profiles, bounded reads and exports of tables."""

from __future__ import annotations

import re
import threading
import time
from dataclasses import dataclass
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    DataType,
    DoubleType,
    FloatType,
    MapType,
    StringType,
    StructType,
)


ROW_LIMIT, TIME_LIMIT = 10_000, 10.0
PREVIEW_ROWS, CELL = 200, 500
# Expressions that run code or show what lies outside the registered views, as the analysed plan names them.
_REFUSED = re.compile(r'"class":"[\w.]*\.(CallMethodViaReflection|TryReflect|InputFile\w+|PythonUDF|ScalaUDF)"')


# ---- profile ----------------------------------------------------------------------------------


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and time span of every table; one aggregate per table."""
    parts = []
    for name, df in tables.items():
        ts = F.col("ts") if "ts" in df.columns else F.lit(None).cast("timestamp")
        parts.append(
            df.agg(F.count("*").alias("rows"), F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"))
            .select(F.lit(name).alias("table"), "rows", "min_ts", "max_ts")
        )
    return reduce(DataFrame.unionByName, parts)


def column_profile(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, type, nullable, comment) from the schemas alone."""
    rows = [
        (name, field.name, field.dataType.simpleString(), field.nullable, field.metadata.get("comment"))
        for name, df in tables.items()
        for field in df.schema
    ]
    return spark.createDataFrame(
        rows, "table string, column string, type string, nullable boolean, comment string"
    )


# ---- bounded reads ----------------------------------------------------------------------------


class QueryRefused(ValueError):
    """The text is not one read over the registered views."""


class QueryTimeout(RuntimeError):
    """The query ran past its time limit."""


@dataclass(frozen=True)
class Bounded:
    rows: list
    columns: list[str]
    truncated: bool
    elapsed: float


def read_only(sql: str) -> str:
    """The statement as a subquery: anything but one read fails to parse inside it.

    A guard against mistakes; it does not contain hostile SQL.
    """
    text = sql.strip().rstrip(";").strip()
    if not text:
        raise QueryRefused("the query is empty")
    return f"SELECT * FROM (\n{text}\n) AS bounded"


def bounded_query(
    spark: SparkSession, sql: str, limit: int = ROW_LIMIT, seconds: float = TIME_LIMIT
) -> Bounded:
    """At most `limit` rows of one read-only statement, stopped after `seconds`."""
    text = read_only(sql)
    # A session of its own with the caller's views: its settings are nobody else's.
    session = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    try:
        df = session.sql(f"{text} LIMIT {limit + 1}")
        plan = df._jdf.queryExecution().analyzed()
    except Exception as error:
        raise QueryRefused(f"the query is not one valid read: {str(error)[:300]}") from None
    # However a function is spelled, the analysed plan holds its class.
    if _REFUSED.search(plan.toJSON()):
        raise QueryRefused("the query calls a function that is not allowed")
    context, tag = spark.sparkContext, "bounded-" + uuid4().hex
    expired = threading.Event()

    def stop() -> None:
        expired.set()
        context.cancelJobsWithTag(tag)

    timer, started = threading.Timer(seconds, stop), time.monotonic()
    context.addJobTag(tag)
    timer.start()
    try:
        rows = df.collect()  # at most limit + 1 rows
    except Exception:
        if expired.is_set():
            raise QueryTimeout(f"the query took longer than {seconds:g} s and was stopped") from None
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)
    return Bounded(rows[:limit], df.columns, len(rows) > limit, time.monotonic() - started)


def _shown(column: Column, kind: DataType) -> Column:
    """A value as a preview shows it: no NaN or infinity, and at most 500 characters."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(_finite(column), column)
    if isinstance(kind, BinaryType):
        column, kind = F.base64(column), StringType()
    elif isinstance(kind, (ArrayType, MapType, StructType)):
        column, kind = F.to_json(column), StringType()
    if isinstance(kind, StringType):
        cut = F.concat(F.substring(column, 1, CELL - 1), F.lit("…"))
        return F.when(F.length(column) > CELL, cut).otherwise(column)
    return column


def _finite(column: Column) -> Column:
    return ~F.isnan(column) & (F.abs(column) != F.lit(float("inf")))


def bounded_preview(df: DataFrame, limit: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows with short cells, the row count of the whole result and what was cut.

    The count is an aggregate of its own, not a window: the result is never in one partition.
    """
    total = df.agg(F.count("*").alias("row_count"))
    numbers = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]
    odd = [F.when(~_finite(F.col(f"`{name}`")), 1).otherwise(0) for name in numbers]
    texts = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    long = [F.coalesce(F.length(F.col(f"`{name}`")) > CELL, F.lit(False)) for name in texts]
    shown = [_shown(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema]
    rows = df.limit(limit).select(
        *shown,
        reduce(lambda a, b: a + b, odd, F.lit(0)).cast("bigint").alias("non_finite"),
        reduce(lambda a, b: a | b, long, F.lit(False)).alias("cut"),
    )
    return rows.crossJoin(F.broadcast(total)).withColumn(
        "truncated", F.col("cut") | (F.col("row_count") > limit)
    )


# ---- export -----------------------------------------------------------------------------------


def export_table(df: DataFrame, path: str, fmt: str = "parquet", force: bool = False) -> int:
    """Write all rows as Parquet (zstd) or CSV with a header; refuse to replace unless forced."""
    mode = "overwrite" if force else "errorifexists"
    written = Observation()
    if fmt == "parquet":
        counted = df.observe(written, F.count("*").alias("rows"))
        counted.write.mode(mode).option("compression", "zstd").parquet(path)
        return written.get["rows"]
    if fmt != "csv":
        raise ValueError("fmt must be parquet or csv")
    nested = (ArrayType, MapType, StructType)
    flat = df.select(
        *(
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
            for f in df.schema
        )
    )
    counted = flat.observe(written, F.count("*").alias("rows"))
    counted.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    return written.get["rows"]
