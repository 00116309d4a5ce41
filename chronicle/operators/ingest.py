"""Idempotent appends to fact tables, and the ledger of imports."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from chronicle import schema
from chronicle.functions.hashing import row_id
from chronicle.session import staged

LEDGER = (
    "id string, connector string, connector_version string, path_hash string, tz string, "
    "started_at timestamp, finished_at timestamp, rows_seen bigint, rows_inserted bigint, "
    "status string, written_at timestamp"
)


@dataclass(frozen=True)
class Stored:
    """Counts of one import."""

    seen: int
    inserted: int
    refused: int = 0


def first_rows(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """One row per id: the first in input order. Copies are dropped before the shuffle."""
    columns = rows.columns
    return (
        rows.groupBy("id")
        .agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_first"))
        .select("_first.*")
    )


def unseen(rows: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Rows whose id is not stored yet, in any month: an id names one row, whatever its timestamp.

    Only the id column of the stored rows is read.
    """
    if stored is None:
        return rows
    return rows.join(stored.select("id"), "id", "left_anti")


def keyed(rows: DataFrame) -> DataFrame:
    """Add the row id and the storage month."""
    return rows.withColumns(
        {
            "id": row_id(F.col("source"), F.col("source_row_id")),
            "month": F.date_format(F.trunc(F.col("ts").cast("date"), "month"), "yyyy-MM"),
        }
    )


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored table, or None before the first import; a table that cannot be read is an error."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def append_new(
    rows: DataFrame, table: str, path: str, import_id: str, order: tuple[str, ...] = ("path", "block", "pos")
) -> Stored:
    """Validate, key and append rows that are not stored yet; nothing stored is changed.

    The parsed batch is written to the checkpoint folder first: it is counted, compared and
    appended without parsing again, and a lost executor does not start the parsing over.
    """
    spark = rows.sparkSession
    place = [c for c in order if c in rows.columns] or ["source_row_id"]
    ordered_rows = rows.withColumn("_order", F.struct(*place))
    batch = staged(ordered_rows.withColumn("_reason", schema.reject_reason(rows, table)))
    counts = batch.agg(F.count("*").alias("seen"), F.count("_reason").alias("refused")).first()
    good = schema.conform(batch.filter(F.col("_reason").isNull()), table, keep=("_order",))
    new = unseen(first_rows(keyed(good), ("_order",)), read_table(spark, path))
    new = new.withColumns({"import_id": F.lit(import_id), "imported_at": F.current_timestamp()})
    names = [field.name for field in schema.fact_schema(table)]
    new = new.select(*(F.col(c) if c in new.columns else F.lit(None).cast("string").alias(c) for c in names), "month")
    # Rebalancing splits a month that holds most rows into several files.
    written = Observation()
    spread = new.hint("rebalance", "month").observe(written, F.count("*").alias("inserted"))
    spread.write.mode("append").partitionBy("month").parquet(path)
    return Stored(counts["seen"] - counts["refused"], written.get["inserted"], counts["refused"])


# ---- ledger -----------------------------------------------------------------------------------


def ledger_entry(
    spark: SparkSession,
    path: str,
    import_id: str,
    connector: str,
    version: str,
    path_hash: str,
    tz: str,
    started_at: datetime,
    status: str,
    stored: Stored | None = None,
) -> None:
    """Append one state of an import; the latest state of an id counts."""
    now = datetime.now(timezone.utc)
    row = (
        import_id, connector, version, path_hash, tz, started_at,
        None if status == "running" else now,
        stored.seen if stored else 0, stored.inserted if stored else 0, status, now,
    )
    spark.createDataFrame([row], LEDGER).coalesce(1).write.mode("append").parquet(path)


def imports(ledger: DataFrame) -> DataFrame:
    """One row per import: its latest state."""
    columns = [c for c in ledger.columns if c != "written_at"]
    latest = F.max_by(F.struct(*columns), "written_at").alias("latest")
    return ledger.groupBy("id").agg(latest).select("latest.*")


def latest_per_connector(runs: DataFrame) -> DataFrame:
    """The last successful import of each connector, with how many there were."""
    order = Window.partitionBy("connector").orderBy(
        F.desc_nulls_last("finished_at"), F.desc("started_at")
    )
    done = runs.filter("status = 'succeeded'")
    totals = done.groupBy("connector").agg(F.count("*").alias("imports"))
    return (
        done.withColumn("_rank", F.row_number().over(order))
        .filter("_rank = 1")
        .drop("_rank")
        .join(totals, "connector")
    )


def previous_zone(runs: DataFrame, connector: str) -> DataFrame:
    """The zone of the connector's last successful import, as at most one row."""
    return (
        runs.filter((F.col("connector") == connector) & (F.col("status") == "succeeded"))
        .orderBy(F.desc("started_at"))
        .limit(1)
        .select("tz")
    )


def run_import(
    rows: DataFrame,
    table: str,
    warehouse: str,
    connector: str,
    tz: str = "UTC",
    path_hash: str = "",
    version: str = "1",
    import_id: str | None = None,
) -> Stored:
    """Append a parsed export to its fact table and record the run."""
    spark = rows.sparkSession
    import_id = import_id or uuid4().hex
    started = datetime.now(timezone.utc)
    ledger = f"{warehouse}/imports"
    entry = (spark, ledger, import_id, connector, version, path_hash, tz, started)
    ledger_entry(*entry, "running")
    try:
        stored = append_new(rows, table, f"{warehouse}/{table}", import_id)
    except BaseException:
        ledger_entry(*entry, "failed")
        raise
    ledger_entry(*entry, "succeeded", stored)
    return stored
