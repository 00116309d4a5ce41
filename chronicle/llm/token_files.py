"""Token files: ids of all texts in ascending order of keys, range asymmetric numeral system in independent blocks.

Writing: rows are dealt by ranges of the key and sorted, tokenised once into blocks of whole documents and written to the shared
folder; counts of all ids make one table of frequencies; then blocks are encoded by it. A folder holds `blocks` (rows with the number of
their range and of their block there, the ids before it in the range, keys, lengths, and the block's bytes as in `rans`), `ranges` (ids before each
range) and `table` (frequencies). Blocks are rows of Parquet, so any file system that Spark reaches can hold them and a task that is
lost writes its rows again. Reading decodes every block by itself.

Bounds: the driver sees one count for each id of the vocabulary and one for each range. A block holds about `BLOCK` ids,
or one longer document.

Defined results: null and empty texts have the end id alone; null keys come first; rows with equal keys are ordered by a hash of their
text and stay rows of their own; an empty table makes empty files. Only key and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronicle.llm import rans
from chronicle.llm import tokens as T
from chronicle.llm.frames import as_bytes, dropped, folder, keyed, kept

BLOCK = 1 << 16
TOGETHER = 1 << 20  # ids encoded or decoded together
END = 2
_PLAIN = "range: int, block: int, start: bigint, n: bigint"


def _blocks(docs: DataFrame, path: str, end: int) -> DataFrame:
    """Plain blocks of the sorted documents; `data` holds ids of 16 or 32 bits."""
    kind = docs.schema["_key"].dataType.simpleString()
    names = ["range", "block", "start", "n", "keys", "lengths", "data"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, number, block, start = T.tokens(path), TaskContext.get().partitionId(), 0, 0
        keys: list[pa.Array] = []
        lengths: list[int] = []
        parts: list[np.ndarray] = []
        size = 0

        def made() -> pa.RecordBatch:
            data = np.concatenate(parts).tobytes()
            values = pa.concat_arrays(keys)
            row = [pa.array([x], t) for x, t in zip((number, block), (pa.int32(), pa.int32()))]
            row += [pa.array([start], pa.int64()), pa.array([size], pa.int64())]
            row.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
            row.append(pa.array([lengths], pa.list_(pa.int64())))
            row.append(pa.array([data], pa.binary()))
            return pa.RecordBatch.from_arrays(row, names)

        for batch in batches:
            texts = [t or b"" for t in as_bytes(batch.column(1))]
            for a, b in T.batches(texts):
                ids, at = table.encode(texts[a:b])
                ends = at[1:]
                own = np.insert(ids, ends, np.array(end, ids.dtype))  # the end id after each text
                at = at + np.arange(len(at))
                first = 0
                for i in range(b - a):
                    length = int(at[i + 1] - at[i])
                    lengths.append(length)
                    size += length
                    if size >= BLOCK or i == b - a - 1:
                        parts.append(own[at[first] : at[i + 1]])
                        keys.append(batch.column(0).slice(a + first, i + 1 - first))
                        first = i + 1
                    if size >= BLOCK:
                        yield made()
                        block, start = block + 1, start + size
                        keys, lengths, parts, size = [], [], [], 0
        if size:
            yield made()

    return docs.mapInArrow(cut, f"{_PLAIN}, keys: array<{kind}>, lengths: array<bigint>, data: binary")


def _counts(plain: DataFrame, width: str) -> np.ndarray:
    """How often each id occurs in all blocks."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for data in batch.column(0):
                found = np.bincount(np.frombuffer(data.as_buffer(), width))
                if len(found) > len(total):
                    total = np.pad(total, (0, len(found) - len(total)))
                total[: len(found)] += found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    rows = plain.select("data").mapInArrow(counted, "id: bigint, n: bigint").groupBy("id").agg(F.sum("n")).collect()
    out = np.zeros(max((r[0] for r in rows), default=-1) + 1, np.int64)
    for i, n in rows:
        out[i] = n
    return out


def _stretches(sizes: list[int]) -> Iterator[tuple[int, int]]:
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > TOGETHER:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


@lru_cache(maxsize=2)
def _table(frequencies: bytes) -> rans.Table:
    return rans.Table(np.frombuffer(frequencies, np.int64))


def write(docs: DataFrame, to: str, path: str | None = None, end: int = END, key: str = "doc_id", text: str = "text") -> None:
    """Writes the token files of `docs` into the new folder `to`."""
    spark, path = docs.sparkSession, path or T.default_path()
    source = keyed(docs, key, _text=text)
    ordered = source.repartitionByRange("_key", F.xxhash64("_text")).sortWithinPartitions("_key", F.xxhash64("_text"))
    width = T.tokens(path).pool.dtype.str
    plain, stage = kept(_blocks(ordered, path, end), "plain")
    spark.sparkContext._jvm.System.gc()  # lets Spark drop the shuffled texts, which the blocks have replaced
    frequencies = rans.scaled(_counts(plain, width))
    shared = spark.sparkContext.broadcast(frequencies.tobytes())

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(shared.value)
        for batch in batches:
            sizes, data = batch.column(3).to_pylist(), batch.column(6)
            for a, b in _stretches(sizes):
                made = rans.encode([np.frombuffer(data[i].as_buffer(), width) for i in range(a, b)], table)
                columns = [batch.column(i).slice(a, b - a) for i in range(6)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(made, pa.binary())], batch.schema.names)

    plain.mapInArrow(encoded, plain.schema).write.option("compression", "uncompressed").parquet(f"{to}/blocks")
    dropped(spark, stage)
    totals = spark.read.parquet(f"{to}/blocks").groupBy("range").agg(F.sum("n").alias("n"))
    # One row for each range: few, whatever the number of documents.
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = totals.coalesce(1).select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ids_before"))
    ranges.write.parquet(f"{to}/ranges")
    rows = [(int(i), int(f)) for i, f in enumerate(frequencies) if f]
    spark.createDataFrame(rows, "id: bigint, frequency: bigint").coalesce(1).write.parquet(f"{to}/table")


def read(spark: SparkSession, place: str, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids_crc32[, ids]) of each document, decoded from the files in `place`."""
    rows = spark.read.parquet(f"{place}/table").collect()  # at most one row for each id of the vocabulary
    frequencies = np.zeros(max((r[0] for r in rows), default=-1) + 1, np.int64)
    for i, f in rows:
        frequencies[i] = f
    shared = spark.sparkContext.broadcast(frequencies.tobytes())
    blocks = spark.read.parquet(f"{place}/blocks")
    ranges = spark.read.parquet(f"{place}/ranges")  # one row for each range
    placed = blocks.join(F.broadcast(ranges), "range").select(
        (F.col("ids_before") + F.col("start")).alias("start"), "n", "keys", "lengths", "data"
    )
    names = ["_key", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(shared.value)
        for batch in batches:
            starts, sizes, lengths = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for a, b in _stretches(sizes):
                found = rans.decode([batch.column(4)[i].as_py() for i in range(a, b)], table)
                for i, ids in zip(range(a, b), found):
                    ids = ids.astype("<u4")
                    ends = np.cumsum(lengths[i])
                    begins = ends - lengths[i]
                    crcs = [zlib.crc32(ids[x:y].data) for x, y in zip(begins.tolist(), ends.tolist())]
                    columns = [batch.column(2)[i].values, pa.array(begins + starts[i]), pa.array(lengths[i], pa.int64())]
                    columns.append(pa.array(crcs, pa.int64()))
                    if with_ids:
                        offsets = pa.array(np.append(begins, ends[-1]), pa.int32())
                        columns.append(pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(columns, names)

    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    schema = f"_key: {kind}, start: bigint, n_tokens: bigint, ids_crc32: bigint" + ", ids: array<bigint>" * with_ids
    return placed.mapInArrow(decoded, schema).withColumnRenamed("_key", key)


def digest(docs: DataFrame) -> DataFrame:
    """Writes the token files of `docs` to a new shared folder and reads them back."""
    place = folder(docs.sparkSession, "tokens")
    write(docs, place)
    return read(docs.sparkSession, place)
