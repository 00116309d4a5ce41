"""Ordered pieces of text files.

A piece is (path, block, pos, line): `block` ascends with the byte a file split starts at and `pos` ascends
inside it, so (block, pos) is the order of the file although many tasks read it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from contextlib import contextmanager
from fnmatch import fnmatch
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from chronicle.functions import ordered
from chronicle.functions.hashing import content_hash
from chronicle.session import staged

ORDER = ("block", "pos")
BLOCK_LINES = 1 << 14
BOM = "\ufeff"


def blocks(pieces: DataFrame) -> DataFrame:
    """Pieces whose `block` is the byte a split starts at, in blocks of at most 16,384 lines.

    What is done inside a block is done in one task, and a split has millions of short lines. `pos` counts the
    lines of a task in its low 33 bits. A task reads no more lines than a split may have bytes, so the blocks of a
    split stay below the start of the next one and (block, pos) remains the order of the file.
    """
    low = F.col("pos").bitwiseAND(F.lit((1 << 33) - 1))
    return pieces.withColumn("block", F.col("block") + F.floor(low / BLOCK_LINES).cast("bigint"))


def relative_path(path: Column, root: str | None) -> Column:
    """A file URI as a plain path, below `root` if that is given."""
    plain = F.url_decode(F.regexp_replace(F.regexp_replace(path, r"^file:/+", "/"), r"\+", "%2B"))
    if root is None:
        return plain
    base = "/" + root.removeprefix("file:").strip("/") if root.startswith(("/", "file:")) else root.rstrip("/")
    inside = plain.startswith(base + "/")
    return F.when(inside, plain.substr(F.lit(len(base) + 2), F.length(plain))).otherwise(
        F.when(plain == base, F.substring_index(plain, "/", -1)).otherwise(plain)
    )


def read_lines(
    spark: SparkSession,
    paths: str | Sequence[str],
    separator: str | None = None,
    glob: str | None = None,
    exclude: str | None = None,
    encoding: str = "UTF-8",
    hidden: bool = False,
) -> DataFrame:
    """Pieces of all files below `paths`, cut at newlines or at `separator`.

    `glob` and the pattern `exclude` choose files by name before any is opened. Spark leaves out
    names that begin with a dot or an underscore; `hidden` reads those too.
    """
    root = paths if isinstance(paths, str) else None
    reader = spark.read.option("recursiveFileLookup", "true")
    if separator:
        reader = reader.option("lineSep", separator)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    texts = reader.text(paths)
    if exclude:
        texts = texts.filter(~F.col("_metadata.file_name").rlike(exclude))
    rows = texts.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        F.col("value").alias("line"),
    )
    rows = blocks(rows)
    if hidden:
        rows = rows.unionByName(_read_hidden(spark, [paths] if root else list(paths), glob, exclude, separator))
    rows = rows.withColumn("path", relative_path(F.col("path"), root))
    line = F.col("line")
    if (text := decoded(line, encoding)) is not line:
        return rows.withColumn("line", text)
    # Looking at bytes keeps lines that are not valid UTF-8 as they are.
    return rows.withColumn("line", F.when(line.startswith(BOM), line.substr(F.lit(2), F.length(line))).otherwise(line))


_SPLIT = 64 << 20
_LINE = "path string, block bigint, pos bigint, line string"


def hidden_splits(spark: SparkSession, roots: list[str], glob: str | None, exclude: str | None):
    """(path, start, end) of 64 MiB ranges of hidden files; names only, as Spark lists them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for root in roots:
        base = jvm.org.apache.hadoop.fs.Path(root)
        found = base.getFileSystem(conf).listFiles(base, True)
        while found.hasNext():
            status = found.next()
            path, size = status.getPath(), status.getLen()
            name = path.getName()
            if not name.startswith((".", "_")) or (glob and not fnmatch(name, glob)):
                continue
            if name in ("_SUCCESS",) or name.endswith(".crc") or (exclude and re.search(exclude, name)):
                continue
            for start in range(0, max(size, 1), _SPLIT):
                yield path.toUri().toString(), start, min(start + _SPLIT, size)


def _read_hidden(spark, roots, glob, exclude, separator) -> DataFrame:
    """Lines of byte ranges; a line belongs to the range it starts in."""
    splits = list(hidden_splits(spark, roots, glob, exclude))
    frame = spark.createDataFrame(splits or [("", 0, 0)], "path string, start bigint, end bigint")
    frame = frame.repartition(max(len(splits), 1))
    cut = (separator or "\n").encode()

    def read(batches):
        from pyarrow import fs

        for batch in batches:
            for path, start, end in batch.itertuples(index=False):
                if not path:
                    continue
                uri = path if "://" in path else path.replace("file:", "file://")
                system, inner = fs.FileSystem.from_uri(uri)
                with system.open_input_file(inner) as stream:
                    for first, lines in _lines_of_range(stream, start, end, cut):
                        texts = [line.decode("utf-8", "replace").removesuffix("\r") for line in lines]
                        yield pd.DataFrame(
                            {"path": path, "block": start, "pos": range(first, first + len(texts)), "line": texts}
                        )

    return blocks(frame.mapInPandas(read, _LINE))


def _lines_of_range(stream, start: int, end: int, cut: bytes, chunk: int = 1 << 20):
    """Yield (index of the first line, lines) for the lines that start in [start, end)."""
    back = len(cut) if start else 0
    stream.seek(start - back)
    rest, at, count = b"", start - back, 0
    skipping = bool(start)
    while at < end or skipping:
        data = stream.read(chunk)
        last = not data
        pieces = (rest + data).split(cut)
        rest = b"" if last else pieces.pop()
        if last and pieces and not pieces[-1]:
            pieces.pop()
        if skipping and pieces:
            at += len(pieces.pop(0)) + len(cut)
            skipping = False
        lines = []
        for piece in pieces:
            if at >= end:
                break
            lines.append(piece)
            at += len(piece) + len(cut)
        if lines:
            yield count, lines
            count += len(lines)
        if last:
            return


_JVM_CHARSETS = {"utf8": "UTF-8", "utf8sig": "UTF-8", "ascii": "US-ASCII", "usascii": "US-ASCII", "latin1": "ISO-8859-1", "iso88591": "ISO-8859-1"}


def decoded(line: Column, encoding: str) -> Column:
    """A line of raw bytes as text: in the JVM for the common encodings, else with a Python codec."""
    plain = re.sub(r"[-_ ]", "", encoding.lower())
    if _JVM_CHARSETS.get(plain) == "UTF-8":
        return line
    if plain in _JVM_CHARSETS:
        return F.decode(line.cast("binary"), _JVM_CHARSETS[plain])
    return _decoder(encoding)(line.cast("binary"))


def _decoder(encoding: str):
    """The text source hands over raw bytes; decode them with a Python codec."""

    @F.pandas_udf(StringType())
    def decode(lines: pd.Series) -> pd.Series:
        return lines.map(lambda line: None if line is None else line.decode(encoding))

    return decode


def number_lines(lines: DataFrame) -> DataFrame:
    """Add `line_no`, from 0, per file."""
    numbered = ordered.running_total(lines, ["path"], "block", ORDER, F.lit(1), "line_no")
    return numbered.withColumn("line_no", F.col("line_no") - 1)


def stitch(lines: DataFrame, starts: Column, first: Column, rest: Column, by: str) -> DataFrame:
    """Join each line that `starts` a record with the lines up to the next one.

    Result: path, block, pos and text of every record. Lines before the first record are dropped.
    """
    rows = lines.withColumn("_starts", starts)
    # Only the piece travels, once, whatever it is made of.
    piece = F.when(F.col("_starts"), first).otherwise(rest).alias("_piece")
    rows = rows.select("path", *ORDER, F.col("_starts").cast("int").alias("_starts"), piece)
    rows = ordered.running_total(rows, ["path"], "block", ORDER, F.col("_starts"), "_record")
    return join_pieces(rows, by)


def join_pieces(rows: DataFrame, by: str) -> DataFrame:
    """One row per (path, _record): where it begins, and its `_piece`s in order."""
    # A group is one record: the size of a single value in the result.
    pieces = F.array_sort(F.collect_list(F.struct("block", "pos", "_piece")))
    return (
        rows.filter(F.col("_record") > 0)
        .groupBy("path", "_record")
        .agg(F.min(F.struct("block", "pos")).alias("_at"), pieces.alias("_pieces"))
        .select(
            "path",
            "_at.block",
            "_at.pos",
            F.array_join(F.transform("_pieces", lambda p: p["_piece"]), by).alias("text"),
        )
    )


def occurrences(rows: DataFrame, ts: str, *fields: Column) -> DataFrame:
    """Add `occurrence`: how many identical records came before in the same run of one timestamp.

    Records are identical when their fields are; the count starts again whenever the timestamp
    changes in file order. Rows are numbered inside their block. Only a run that goes on in the
    next block needs the counts of the blocks before, and these are joined by (block, identity).
    """
    in_block = Window.partitionBy("path", "block").orderBy("pos")
    upto = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    changed = ~F.col(ts).eqNullSafe(F.lag(ts).over(in_block))
    first = F.row_number().over(in_block) == 1
    runs = rows.withColumn("_identity", content_hash(*fields))
    runs = runs.withColumn("_changed", (changed & ~first).cast("int"))
    runs = runs.withColumn("_run", F.sum("_changed").over(upto)).drop("_changed")
    same = Window.partitionBy("path", "block", "_run", "_identity").orderBy("pos")
    runs = staged(runs.withColumn("_in_block", F.row_number().over(same).cast("bigint") - 1))

    # One row per block: does its first run continue the last run of the block before?
    blocks = runs.groupBy("path", "block").agg(
        F.min_by(ts, "pos").alias("_first_ts"), F.max_by(ts, "pos").alias("_last_ts"), F.max("_run").alias("_last_run")
    )
    by_block = Window.partitionBy("path").orderBy("block")
    continues = F.col("_first_ts").eqNullSafe(F.lag("_last_ts").over(by_block)) & (
        F.row_number().over(by_block) > 1
    )
    blocks = blocks.withColumn("_continues", continues).withColumn(
        # A chain of blocks grows while a block is one run and continues the block before.
        "_next_continues", F.coalesce(F.lead("_continues").over(by_block), F.lit(False))
    )
    starts = ~F.col("_continues") | (F.col("_last_run") > 0)
    blocks = blocks.withColumn("_chain", F.sum(starts.cast("int")).over(by_block))
    blocks = blocks.withColumn("_joined", F.col("_chain") - (F.col("_continues") & (F.col("_last_run") > 0)).cast("int"))
    # Written first, as are the counts below: they are few, and Spark joins by their size without moving the rows.
    edges = staged(blocks.filter("_continues OR _next_continues").select(
        "path", "block", "_last_run", "_chain", "_joined", "_continues", "_next_continues"
    ))
    counted = (
        runs.join(edges, ["path", "block"])
        .filter("(_run = 0 AND _continues) OR (_run = _last_run AND _next_continues)")
        .withColumn("_chain", F.when(F.col("_run") == F.col("_last_run"), F.col("_chain")).otherwise(F.col("_joined")))
        .groupBy("path", "_chain", "_identity", "block", "_run")
        .agg(F.count("*").alias("_copies"))
    )
    earlier = (
        Window.partitionBy("path", "_chain", "_identity")
        .orderBy("block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = staged(
        counted.withColumn("_carried", F.sum("_copies").over(earlier))
        .filter("_carried > 0")
        .select("path", "block", "_run", "_identity", "_carried")
    )
    keys = ["path", "block", "_run", "_identity"]
    return (
        runs.join(carried, keys, "left")
        .withColumn("occurrence", F.col("_in_block") + F.coalesce("_carried", F.lit(0)))
        .drop("_run", "_identity", "_in_block", "_carried")
    )


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def read_zip_lines(
    spark: SparkSession, paths: str | Sequence[str], pattern: str, separator: str = "\n"
) -> DataFrame:
    """Pieces of the members of ZIP archives whose name matches `pattern`, without extraction.

    Members are listed first and dealt to tasks. A member cannot be split; it streams through its task
    in chunks, from the archive's place in the file system, so neither it nor the archive is held.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.zip")
        .load(paths)
        .select("path")
    )

    def listed(batches):
        for batch in batches:
            for path in batch["path"]:
                with open_archive(path) as archive:
                    names = sorted(n for n in archive.namelist() if fnmatch(n.rsplit("/", 1)[-1], pattern))
                yield pd.DataFrame({"path": path, "member": names}, dtype="object")

    def members(batches):
        for batch in batches:
            for path, member in zip(batch["path"], batch["member"]):
                with open_archive(path) as archive, archive.open(member) as stream:
                    yield from _pieces(path + "/" + member, stream, separator)

    root = paths if isinstance(paths, str) else None
    found = files.mapInPandas(listed, "path string, member string").repartition("path", "member")
    return found.mapInPandas(members, _LINE).withColumn("path", relative_path(F.col("path"), root))


def open_file(path: str):
    """A file opened where it lies, at any place in it."""
    from pyarrow import fs

    uri = quote(re.sub(r"^file:/+", "file:///", path), safe="%/:@")
    system, inner = fs.FileSystem.from_uri(uri)
    return system.open_input_file(inner)


@contextmanager
def open_archive(path: str):
    import zipfile

    with open_file(path) as file, zipfile.ZipFile(file) as archive:
        yield archive


def _pieces(path, stream, separator, size=20_000):
    """Frames of at most `size` lines; each frame is one block."""
    import codecs

    decoder = codecs.getincrementaldecoder("utf-8-sig")(errors="replace")
    rest, rows, block = "", [], 0
    while chunk := stream.read(1 << 20):
        parts = (rest + decoder.decode(chunk)).split(separator)
        rest = parts.pop()
        rows.extend(parts)
        while len(rows) >= size:
            yield _frame(path, block, rows[:size])
            rows, block = rows[size:], block + 1
    rest += decoder.decode(b"", final=True)
    yield _frame(path, block, rows + ([rest] if rest else []))


def _frame(path, block, rows):
    return pd.DataFrame(
        {"path": path, "block": block, "pos": range(len(rows)), "line": [r.rstrip("\r") for r in rows]}
    )
