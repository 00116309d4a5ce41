"""Small helpers of the operators: text columns as bytes, batches and tables of Python workers, shared folders."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronicle.session import checkpoint_folder

BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}

_RESIDENT: dict = {}


def resident(name, make: Callable):
    """The one large table that a Python worker keeps between tasks; making another, or None, drops it."""
    if name not in _RESIDENT:
        _RESIDENT.clear()
        if name is not None:
            _RESIDENT[name] = make()
    return _RESIDENT.get(name)


def released() -> None:
    """Drops what tasks of other operators left in this Python worker."""
    resident(None, lambda: None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a text column."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return column.cast(pa.large_binary() if large else pa.binary()).to_pylist()


def small_batches(spark: SparkSession) -> None:
    """Fewer rows, and at most so many bytes, go to a Python worker at a time: the default of 10,000 whole texts is large."""
    for name, value in BATCHES.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)


def keyed(df: DataFrame, key: str, *values: str, **named: str) -> DataFrame:
    """Only the key and the columns an operator reads, under its own names: other columns cannot clash."""
    small_batches(df.sparkSession)
    return df.select(F.col(key).alias("_key"), *values, *(F.col(c).alias(n) for n, c in named.items()))


def folder(spark: SparkSession, what: str) -> str:
    """A new folder that all executors share."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{what}-{uuid4().hex}"


def kept(df: DataFrame, what: str = "stage", compression: str = "zstd") -> tuple[DataFrame, str]:
    """`df` written once to a shared folder and read back, and that folder."""
    path = folder(df.sparkSession, what)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Removes a folder made by `kept` or `folder` that no later plan reads."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
