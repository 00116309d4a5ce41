"""A folder of exports imported in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronicle.operators.ingest import Stored, run_import
from chronicle.session import staged
from chronicle.sources.classify import export_fingerprint, ranked, read_heads
from chronicle.sources.connectors import Connector, Files, Options, connectors, ratings

IMPORTED = "connector string, table string, files bigint, rows_seen bigint, rows_inserted bigint, rows_refused bigint"


def import_folder(
    spark: SparkSession, root: str, warehouse: str, options: Options = Options(), extra: tuple[Connector, ...] = ()
) -> DataFrame:
    """Classify the files below `root`, parse each with its best connector, and append what is new.

    One row per connector that found files. Files that no connector knows are left alone. Importing the
    same folder again inserts nothing. Each connector's import is a run in the ledger of the warehouse.
    """
    known = connectors(extra)
    heads = staged(read_heads(spark, root))
    rated = ranked(heads, ratings(known, F.col("path"), F.col("text")))
    best = staged(rated.filter("rank = 1 AND confidence > 0").join(heads, "path").select("path", "format", "text"))
    found = dict(best.groupBy("format").count().collect())  # at most one row per connector
    mark = export_fingerprint(spark, root).first()["fingerprint"]
    done: list[tuple] = []
    for name in sorted(found):
        connector = known[name]
        files = Files(spark, root, best.filter(F.col("format") == name))
        rows = connector.parse(files, options)
        stored: Stored = run_import(
            rows, connector.table, warehouse, name, options.tz, path_hash=mark, version=connector.version
        )
        done.append((name, connector.table, found[name], stored.seen, stored.inserted, stored.refused))
    return spark.createDataFrame(done, IMPORTED)
