"""Best-fit packing: pieces of documents, longest first, go to the open sequence with the least room that still takes them.

Texts are tokenised, one end id follows each, and what is longer than a sequence is cut into full pieces after a shorter first
one. Full pieces fill a sequence alone. The others are dealt by hash into groups of about `GROUP` pieces; each group is packed
by itself, best fit decreasing, with a segment tree over the remaining capacities that finds the tightest open sequence in
logarithmic time. A group leaves about one sequence partly filled, whatever the size of the corpus, so groups cost less than one
sequence in several thousand, and no task holds more than a group.

Defined results: null and empty texts are a piece of the end id alone; rows with equal keys are packed as documents of their
own; an empty table packs nothing. Only key and text are read, so other columns cannot clash. Sequence ids are any distinct
numbers; places in a sequence are gapless from 0.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronicle.llm import tokens as T
from chronicle.llm.frames import as_bytes, keyed, kept

LENGTH = 2048
GROUP = 40_000  # pieces packed together
END = 0


class Capacities:
    """Segment tree over capacities 0..top: how many open sequences have exactly this much room."""

    def __init__(self, top: int):
        self.leaves = 1 << (top + 1).bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(top + 1)]

    def add(self, room: int, sequence: int) -> None:
        heapq.heappush(self.open[room], sequence)
        node = self.leaves + room
        while node:
            self.counts[node] += 1
            node >>= 1

    def tightest(self, size: int) -> tuple[int, int] | None:
        """(room, sequence) with the least room of at least `size`, taken out."""
        node, counts = self.leaves + size, self.counts
        while not counts[node]:
            # Climb to the first ancestor with a right neighbour, and step to that.
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
            if node & (node - 1) == 0:  # stepped over the right edge
                return None
        while node < self.leaves:
            node <<= 1
            if not counts[node]:
                node += 1
        room = node - self.leaves
        sequence = heapq.heappop(self.open[room])
        while node:
            counts[node] -= 1
            node >>= 1
        return room, sequence


def best_fit(sizes: list[int], top: int) -> tuple[list[int], list[int]]:
    """(sequence, offset) of each size, the sizes in descending order; sequences are numbered from 0."""
    tree, sequences, offsets, made = Capacities(top), [], [], 0
    for size in sizes:
        found = tree.tightest(size)
        if found is None:
            found, made = (top, made), made + 1
        room, sequence = found
        sequences.append(sequence)
        offsets.append(top - room)
        if room > size:
            tree.add(room - size, sequence)
    return sequences, offsets


_PIECES = "piece: int, start: bigint, length: bigint, ids_crc32: bigint"


def pieces(
    docs: DataFrame, path: str, length: int = LENGTH, end: int = END, key: str = "doc_id", text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of each piece of each document."""
    source = keyed(docs, key, _text=text)
    names = ["_key", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = T.tokens(path)
        tail = np.array([end], "<u4")
        for batch in batches:
            texts = [t or b"" for t in as_bytes(batch.column(1))]
            for a, b in T.batches(texts):
                ids, at = table.encode(texts[a:b])
                ids = ids.astype("<u4")
                rows: list[list] = [[] for _ in names]
                for i in range(b - a):
                    own = np.concatenate([ids[at[i] : at[i + 1]], tail])
                    first = len(own) % length or min(length, len(own))
                    for number, start in enumerate([0, *range(first, len(own), length)]):
                        part = own[start : start + (length if number else first)]
                        found = (a + i, number, start, len(part), zlib.crc32(part.data), part.astype(np.int64))
                        for column, value in zip(rows, found):
                            column.append(value)
                columns = [batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32())]
                columns += [pa.array(r, pa.int64()) for r in rows[2:5]]
                columns += [pa.array(r, pa.list_(pa.int64())) for r in rows[5:]]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = source.schema["_key"].dataType.simpleString()
    return source.mapInArrow(cut, f"_key: {kind}, {_PIECES}" + ", ids: array<bigint>" * with_ids)


def packed(parts: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """`parts` with sequence_id and offset. Full pieces stand alone; the rest is packed in groups of similar size.

    `parts` is read twice, so give a written table. The number of groups follows the number of pieces, and the group of a piece its
    content, so that a task that runs again packs the same way.
    """
    short = parts.filter(F.col("length") < length)
    groups = max(1, round(short.count() / group))
    full = parts.filter(F.col("length") >= length).select(
        "*", F.shiftleft(F.monotonically_increasing_id(), 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    # The key, the piece and the checksum tell pieces apart; equal ones are interchangeable.
    dealt = short.withColumn("_group", F.pmod(F.xxhash64("_key", "piece", "ids_crc32"), F.lit(groups)).cast("int"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group_now = [], None
        for batch in batches:
            numbers = batch.column("_group").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if held and numbers[a] != group_now:
                    yield place(held, group_now)
                    held = []
                held.append(batch.slice(a, b - a))
                group_now = int(numbers[a])
        if held:
            yield place(held, group_now)

    def place(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        sequences, offsets = best_fit(rows.column("length").to_pylist(), length)
        ids = (np.array(sequences, np.int64) << 24 | number) << 1 | 1
        columns = [c for n, c in zip(rows.schema.names, rows.columns) if n != "_group"]
        names = [n for n in rows.schema.names if n != "_group"] + ["sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([*columns, pa.array(ids), pa.array(offsets, pa.int64())], names)

    together = dealt.repartition("_group").sortWithinPartitions("_group", F.desc("length"), "_key", "piece", "ids_crc32")
    return together.mapInArrow(fit, full.schema).unionByName(full)


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END, key: str = "doc_id",
         text: str = "text", group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids], sequence_id, offset) of each piece. Tokenises once, into the shared folder."""
    parts, _ = kept(pieces(docs, path or T.default_path(), length, end, key, text, with_ids), "pieces")
    return packed(parts, length, group).withColumnRenamed("_key", key)
