"""Which format a file has, from its name and its first 64 KiB."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronicle.session import staged
from chronicle.sources import bank, chat, plays, shell
from chronicle.sources.lines import ORDER, base_name, hidden_splits, open_archive, open_file, relative_path

SAMPLE = 65_536


def first_lines(samples: DataFrame) -> DataFrame:
    """The lines that begin in the first 64 KiB of each file, cut to that length.

    Blocks are byte offsets or are numbered through; either way, where one begins follows from the sizes of
    those before it, and only blocks that begin in the first 64 KiB are looked at.
    """
    size = F.octet_length("line") + F.octet_length("separator")
    rows = samples.filter(F.col("block") < SAMPLE).withColumn("_size", size.cast("bigint"))
    rows = rows.withColumn("line", F.substring("line", 1, SAMPLE))
    # One row per block, and at most 65,536 blocks per file.
    by_block = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        rows.groupBy("path", "block")
        .agg(F.sum("_size").alias("_bytes"))
        .select("path", "block", F.coalesce(F.sum("_bytes").over(by_block), F.lit(0)).alias("_begin"))
        .filter(F.col("_begin") < SAMPLE)
    )
    # Written first: Spark knows the size and joins without a shuffle of the lines while it is small.
    rows = rows.join(staged(blocks), ["path", "block"])
    before = (
        Window.partitionBy("path", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = rows.withColumn("_at", F.col("_begin") + F.coalesce(F.sum("_size").over(before), F.lit(0)))
    return rows.filter(F.col("_at") < SAMPLE)


def heads(samples: DataFrame) -> DataFrame:
    """(path, text): the first 64 KiB of each file."""
    # At most 64 KiB and one piece per file.
    pieces = F.array_sort(F.collect_list(F.struct(*ORDER, F.concat("line", "separator").alias("text"))))
    text = F.array_join(F.transform("p", lambda x: x["text"]), "")
    return (
        first_lines(samples)
        .groupBy("path")
        .agg(pieces.alias("p"))
        .select("path", F.substring(text, 1, SAMPLE).alias("text"))
    )


def _any_line(text: Column, pattern: str) -> Column:
    return F.exists(F.split(text, "\r\n|\r|\n"), lambda line: line.rlike(pattern))


def _has(text: Column, *fields: str) -> Column:
    return reduce(lambda a, b: a & b, (text.contains(f'"{field}"') for field in fields))


def scores(path: Column, text: Column, mappings=bank.MAPPINGS) -> dict[str, Column]:
    """Confidence 0..1 per format."""
    name = base_name(path)
    ending = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    named = (name == "_chat.txt") | name.startswith(chat.ANDROID_NAME)
    first = F.regexp_replace(text, r"(?s)^[\s\x{FEFF}]+", "")
    array = first.startswith("[")
    marked = "^(?:\\x{FEFF}|" + chat.MARKS + ")*"
    is_chat = (ending == "txt") & (
        _any_line(chat.clean(text), chat.ANDROID) | _any_line(chat.clean(text), chat.IOS)
    )
    is_plays = name.rlike(plays.FILE_NAME) & array
    known = _has(text, "ts", "ms_played") | _has(text, "endTime", "msPlayed")
    keyed = [text.rlike(f'"{key}"\\s*:') for key in ("header", "title", "time", "products")]
    is_activity = ending.isin("json", "html") & (
        (text.contains("outer-cell") & text.contains("content-cell"))
        | text.rlike(r'"Browser History"\s*:')
        | (array & reduce(lambda a, b: a & b, keyed))
    )
    lines = F.split(F.regexp_replace(text, marked, ""), "\r\n|\r|\n")
    is_bank = F.lit(False)
    for mapping in mappings:
        header = F.transform(
            bank.split_csv(F.coalesce(F.get(lines, F.lit(mapping.skip_rows)), F.lit("")), mapping.delimiter),
            lambda f: F.lower(F.trim(f)),
        )
        wanted = F.array(*(F.lit(h.lower()) for h in mapping.required_headers))
        is_bank = is_bank | (F.size(F.array_except(wanted, header)) == 0)
    return {
        "bank_csv": F.when((ending == "csv") & is_bank, 0.95),
        "google_takeout": F.when(is_activity, 0.95),
        "shell_history": F.when(_any_line(text, shell.ZSH), 1.0).when(_any_line(text, shell.BASH), 0.95),
        "spotify": F.when(is_plays & known, 0.99).when(is_plays, 0.6),
        "whatsapp": F.when(is_chat & named, 0.98).when(is_chat, 0.8),
    }


def classify(samples: DataFrame) -> DataFrame:
    """(path, format, confidence, rank) of all formats, best first, ties by name."""
    return ranked(heads(samples), scores(F.col("path"), F.col("text")))


def ranked(files: DataFrame, found: dict[str, Column]) -> DataFrame:
    """(path, format, confidence, rank) of (path, text), from a score for each format."""
    entries = F.array(
        *(
            F.struct(F.lit(name).alias("format"), F.coalesce(score, F.lit(0.0)).alias("confidence"))
            for name, score in found.items()
        )
    )
    order = Window.partitionBy("path").orderBy(F.desc("confidence"), "format")
    return (
        files.select("path", F.explode(entries).alias("e"))
        .select("path", "e.format", "e.confidence")
        .withColumn("rank", F.row_number().over(order).cast("bigint"))
    )


def classify_exports(spark: SparkSession, paths: str) -> DataFrame:
    return ranked(read_heads(spark, paths), scores(F.col("path"), F.col("text")))


def read_heads(spark: SparkSession, root: str) -> DataFrame:
    """(path, text): the first 64 KiB of each file below `root` and of each member of a ZIP archive.

    Files are listed by Spark, hidden ones by name; tasks then open each and read no further.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    hidden = sorted({path for path, _, _ in hidden_splits(spark, [root], None, None)})
    if hidden:
        listed = listed.unionByName(spark.createDataFrame([(p,) for p in hidden], "path string"))

    def read(batches):
        for batch in batches:
            for path in batch["path"]:
                if path.lower().endswith(".zip"):
                    with open_archive(path) as archive:
                        for name in sorted(n for n in archive.namelist() if not n.endswith("/")):
                            with archive.open(name) as stream:
                                yield _head(f"{path}/{name}", stream)
                else:
                    with open_file(path) as stream:
                        yield _head(path, stream)

    found = listed.mapInPandas(read, "path string, text string")
    return found.withColumn("path", relative_path(F.col("path"), root))


def _head(path: str, stream) -> pd.DataFrame:
    return pd.DataFrame({"path": [path], "text": [stream.read(SAMPLE).decode("utf-8", "ignore")]})


def export_fingerprint(spark: SparkSession, root: str) -> DataFrame:
    """sha256 over the sorted (relative path, size) list of the files below `root`."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    )
    return fingerprint(files.select("path", "length"), root)


def fingerprint(files: DataFrame, root: str) -> DataFrame:
    """The hash of one ordered text: sorted names stream through one task, which holds the state of the hash and no list of them."""
    entries = files.select(relative_path(F.col("path"), root).alias("name"), F.col("length").cast("string").alias("size"))
    ordered = entries.repartition(1).sortWithinPartitions("name", F.col("size").cast("long"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, count = hashlib.sha256(), 0
        for batch in batches:
            count += batch.num_rows
            for name, size in zip(*(c.to_pylist() for c in batch.columns)):
                digest.update(f"{name}\x1f{size}\x1e".encode())
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()]), pa.array([count], pa.int64())], ["fingerprint", "files"])

    return ordered.mapInArrow(hashed, "fingerprint: string, files: bigint")
