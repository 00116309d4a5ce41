"""Shell history as `events` rows."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from chronicle.functions import ordered
from chronicle.functions.hashing import content_hash
from chronicle.functions.joins import join_facts
from chronicle.functions.text import redact
from chronicle.session import staged
from chronicle.sources.lines import ORDER, occurrences, stitch

# Record heads of the two text formats.
ZSH = r"^: (\d+):(\d+);(.*)$"
BASH = r"^#(\d+)$"


def shell_formats(lines: DataFrame) -> DataFrame:
    """(path, shell): zsh when any line looks like it, else bash, else absent."""
    shell = F.when(F.max("_zsh"), "zsh").when(F.max("_bash"), "bash")
    return lines.groupBy("path").agg(shell.alias("shell")).filter("shell IS NOT NULL")


@F.pandas_udf(StringType())
def _unmetafy(lines: pd.Series) -> pd.Series:
    return lines.map(
        lambda line: None
        if line is None
        else re.sub(rb"\x83(.)", lambda m: bytes([m[1][0] ^ 0x20]), line, flags=re.S).decode(
            "utf-8", "replace"
        )
    )


def unmetafy(line: Column) -> Column:
    """Undo zsh's escape byte in the lines that hold it."""
    raw = line.cast("binary")
    escaped = F.contains(raw, F.lit(bytearray(b"\x83")))
    return F.when(escaped, _unmetafy(F.when(escaped, raw))).otherwise(line)


def zsh_records(lines: DataFrame) -> DataFrame:
    """(path, block, pos, epoch, duration_ms, command): a head, and lines while each ends in \\.

    Lines are first joined into chains whose lines all but the last end in a backslash. The
    record of a chain begins at its first head; what comes before is no history.
    """
    rows = lines.withColumn("line", unmetafy(F.col("line")))
    rows = rows.withColumn("_open", F.endswith("line", F.lit("\\")))
    rows = ordered.previous_values(rows, ["path"], "block", ORDER, {"_open": "_joined"})
    starts = ~F.coalesce("_joined", F.lit(False))
    chains = stitch(rows, starts, F.col("line"), F.col("line"), "\n")
    head = r"(?s)(?:^|\n): (\d+):(\d+);(.*)$"
    return chains.filter(F.col("text").rlike(head)).select(
        "path",
        "block",
        "pos",
        F.regexp_extract("text", head, 1).try_cast("bigint").alias("epoch"),
        (F.regexp_extract("text", head, 2).try_cast("bigint") * 1000).alias("duration_ms"),
        F.regexp_extract("text", head, 3).alias("command"),
    )


def bash_records(lines: DataFrame) -> DataFrame:
    """The lines after each #epoch line, as one command."""
    records = stitch(lines, F.col("_bash"), F.col("line"), F.col("line"), "\n")
    split = r"(?s)^#(\d+)\n(.*)$"
    return records.filter(F.col("text").rlike(split)).select(
        "path",
        "block",
        "pos",
        F.regexp_extract("text", split, 1).try_cast("bigint").alias("epoch"),
        F.lit(None).cast("bigint").alias("duration_ms"),
        F.regexp_extract("text", split, 2).alias("command"),
    )


def _events(records: DataFrame, shell: Column, source: str) -> tuple[DataFrame, DataFrame]:
    ts = F.timestamp_seconds("epoch")
    in_range = F.col("epoch").between(0, 253402300799)
    good = F.coalesce(in_range, F.lit(False)) & F.col("command").rlike(r"(?U)\S")
    refused = records.filter(~good)
    rows = records.filter(good).withColumn("shell", shell)
    fields = (F.col("shell"), F.col("epoch"), F.col("command"))
    rows = occurrences(rows, "epoch", *fields)
    safe = redact(F.col("command"))
    rows = rows.withColumn("_safe", safe).select(
        "path",
        "block",
        "pos",
        F.lit(source).alias("source"),
        F.col("path").alias("source_file"),
        content_hash(*fields, F.col("occurrence")).alias("source_row_id"),
        ts.alias("ts"),
        F.lit("shell.command").alias("kind"),
        F.col("_safe.text").alias("title"),
        F.to_json(
            F.struct("shell", "duration_ms", F.lit(None).cast("int").alias("exit")),
            {"ignoreNullFields": "false"},
        ).alias("meta"),
        F.col("_safe.count").alias("redactions"),
    )
    return rows, refused


def shell_events(lines: DataFrame, source: str = "shell_history") -> tuple[DataFrame, DataFrame]:
    """(events, refused records) from lines of both formats."""
    # The lines are read once; their marks tell the formats of the files.
    marked = staged(lines.withColumns({"_zsh": F.col("line").rlike(ZSH), "_bash": F.col("line").rlike(BASH)}))
    tagged = join_facts(marked, shell_formats(marked), "path")
    zsh = zsh_records(tagged.filter("shell = 'zsh'")).withColumn("shell", F.lit("zsh"))
    bash = bash_records(tagged.filter("shell = 'bash'")).withColumn("shell", F.lit("bash"))
    return _events(zsh.unionByName(bash), F.col("shell"), source)
