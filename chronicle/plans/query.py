"""Registered queries: a DataFrame, and the same question in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronicle.params import Params
from chronicle.session import prepare

Run = Callable[[SparkSession, str], DataFrame]
ZONE = "Europe/Bucharest"


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None = None


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), places) for c in columns})


def local(tz: str = "UTC", column: str = "ts") -> str:
    return column if tz == "UTC" else f"timezone('{tz}', timezone('UTC', {column}))"


def in_dates(params: Params, column: str = "local_ts") -> str:
    parts = ["true"]
    if params.date_from:
        parts.append(f"{column}::DATE >= DATE '{params.date_from}'")
    if params.date_to:
        parts.append(f"{column}::DATE <= DATE '{params.date_to}'")
    return " AND ".join(parts)


QUERIES: dict[str, Query] = {}


def register(name: str, run: Run, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name!r} is registered twice")

    def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(prepare(spark), sf_dir)

    QUERIES[name] = Query(prepared, sql)
