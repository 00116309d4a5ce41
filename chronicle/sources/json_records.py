"""Objects of large JSON arrays, read by many tasks.

Files are cut at every `}`. A running count of quotes tells which cuts lie inside a string, and a
running depth tells which cuts end an object of the array; the pieces of an object are then joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronicle.functions import ordered
from chronicle.functions.joins import join_facts
from chronicle.session import staged
from chronicle.sources.lines import ORDER, read_lines


def read_json_records(
    spark: SparkSession,
    paths: str | Sequence[str],
    member: str | None = None,
    glob: str = "*.json",
) -> DataFrame:
    """(path, block, pos, record): objects of a top-level array, or of the array `member` holds."""
    return json_records(read_lines(spark, paths, separator="}", glob=glob), member)


def _occurrences(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def json_records(pieces: DataFrame, member: str | None = None) -> DataFrame:
    """Objects from pieces cut at `}`; the objects of an array keep their order."""
    depth = 1 if member else 0
    plain = F.regexp_replace("line", r"(?s)\\.", "")
    strings = r'"[^"]*"?'
    outside = F.regexp_replace(plain, strings, "")
    inside = F.regexp_replace(F.regexp_replace(plain, r'^[^"]*"?', ""), strings, "")
    upto = (
        Window.partitionBy("path", "block")
        .orderBy("pos")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # Whether a block begins inside a string is known only from the blocks before it, so the
    # depth inside a block is worked out for both cases.
    rows = pieces.withColumns(
        {
            "_quotes": _occurrences(plain, '"'),
            "_outside": _occurrences(outside, "{"),
            "_inside": _occurrences(inside, "{"),
        }
    )
    rows = rows.withColumn("_seen", F.sum("_quotes").over(upto))
    for start in (0, 1):
        begins = (F.col("_seen") - F.col("_quotes") + start) % 2 == 1
        opened = F.when(begins, F.col("_inside")).otherwise(F.col("_outside"))
        closed = F.when((F.col("_seen") + start) % 2 == 1, 0).otherwise(1)
        rows = rows.withColumn(f"_change{start}", opened - closed)
    for start in (0, 1):
        rows = rows.withColumn(f"_depth{start}", F.sum(f"_change{start}").over(upto))
    rows = staged(rows.select("path", "block", "pos", "line", "_seen", "_depth0", "_depth1"))

    by_block = Window.partitionBy("path").orderBy("block")
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("path", "block").agg(
        *(F.max_by(name, "pos").alias(name) for name in ("_seen", "_depth0", "_depth1"))
    )
    blocks = blocks.withColumn("_start", F.coalesce(F.sum("_seen").over(earlier), F.lit(0)) % 2)
    change = F.when(F.col("_start") == 1, F.col("_depth1")).otherwise(F.col("_depth0"))
    blocks = blocks.withColumn("_change", change)
    blocks = blocks.withColumn("_base", F.coalesce(F.sum("_change").over(earlier), F.lit(0)))
    # Written first: one row per block, joined by its size without moving the pieces.
    rows = rows.join(staged(blocks.select("path", "block", "_start", "_base")), ["path", "block"])
    inner = F.when(F.col("_start") == 1, F.col("_depth1")).otherwise(F.col("_depth0"))
    closes = (F.col("_seen") + F.col("_start")) % 2 == 0
    ends = closes & (F.col("_base") + inner == depth)
    rows = rows.select("path", "block", "pos", "line", ends.cast("int").alias("_ends"))
    rows = ordered.running_total(rows, ["path"], "block", ORDER, F.col("_ends"), "_record")
    rows = rows.withColumn("_record", F.col("_record") - F.col("_ends"))
    parts = F.array_sort(F.collect_list(F.struct("block", "pos", "line")))
    records = (
        rows.groupBy("path", "_record")
        .agg(
            F.min(F.struct("block", "pos")).alias("_at"),
            F.max("_ends").alias("_whole"),
            parts.alias("_parts"),
        )
        .filter(F.col("_whole") == 1)
        .select(
            "path",
            "_at.block",
            "_at.pos",
            F.concat(F.array_join(F.transform("_parts", lambda p: p["line"]), "}"), F.lit("}")).alias(
                "_text"
            ),
        )
    )
    if member is None:
        return records.select(
            "path", "block", "pos", F.regexp_replace("_text", r"^[^{]*", "").alias("record")
        )
    return _of_member(records, member)


def _of_member(records: DataFrame, member: str) -> DataFrame:
    """Keep objects of one array: each array's first object still carries the array's name."""
    # The file's own brace, other members without objects, then the name of this array.
    opening = (
        r'^(?:\s*\{)?(?:[^{"]|"(?:[^"\\]|\\.)*+")*?"((?:[^"\\]|\\.)*+)"\s*:\s*\[\s*\{'
    )
    named = staged(
        records.withColumns(
            {
                "_name": F.regexp_extract("_text", opening, 1),
                "_opens": F.col("_text").rlike(opening).cast("int"),
            }
        )
    )
    named = ordered.running_total(named, ["path"], "block", ORDER, F.col("_opens"), "_array")
    wanted = named.filter((F.col("_opens") == 1) & (F.col("_name") == member)).select("path", "_array")
    # Few arrays have the wanted name: one per file. Rows are spread by block, not by file.
    named = named.withColumn("_key", F.concat_ws("\x1f", "path", "_array"))
    wanted = wanted.select(F.concat_ws("\x1f", "path", "_array").alias("_key"))
    return (
        join_facts(named, wanted, "_key", "left_semi")
        .withColumn("_text", F.when(F.col("_opens") == 1, F.regexp_replace("_text", opening, "{")).otherwise(F.col("_text")))
        .select("path", "block", "pos", F.regexp_replace("_text", r"^[^{]*", "").alias("record"))
    )
