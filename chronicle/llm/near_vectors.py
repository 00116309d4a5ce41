"""Embedding near-duplicates: an exact metric range join over pivot cells.

Vectors are compared by cosine in double precision. On the unit sphere a cosine of at least `cosine` is a distance of at most `r`.
Sampled pivots partition the vectors: each is at home in the cell of its nearest pivot. A vector `v` with home `h` can only have a partner
at home in cell `j` if its distance to the border between the two, (|v - j|^2 - |v - h|^2) / (2 |j - h|), is at most `r` (the
triangle inequality, sharpened for Euclidean space), so it is replicated there as a guest if `j` comes before `h`. Cells then
join independently: all pairs at home, and home with guest, each pair once. Large cells are dealt into chunks. Blocks are multiplied in
single precision, and what lies within rounding of the threshold is decided in double precision.

Equal vectors are one class with a count, so copies are never paired. A block of a cell emits sums of links and a spanning forest of what it
links, never its pairs. A task holds one chunk of `CHUNK` vectors and streams the guests. The driver sees the pivots and one count
for each cell. Where vectors fill the sphere evenly, borders are near everything and the join compares nearly all pairs; it
prunes what is clustered.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, have no links and are kept; vectors of
different lengths are compared as if the shorter one went on with zeros; rows with equal keys are members of their own; a component
with null keys alone is null; an empty table gives an empty table. Labels and other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronicle.llm.frames import keyed, kept
from chronicle.operators.entities import components

COSINE = 0.95
CELL, CHUNK, PIVOTS = 4096, 4096, 512  # vectors at home in a cell, on average; in a chunk; pivots at most
BLOCK = 1024
_SLACK = 1e-5  # of single precision
_JOINED = "a: string, b: string, links: bigint"


def parsed(source: DataFrame) -> DataFrame:
    """(_key, vector): components as doubles in bytes; null for vectors that link with nothing."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = []
            for value in batch.column(1):
                row = value.values
                good = row is not None and len(row) and not row.null_count
                row = np.asarray(row.cast(pa.float64())) if good else None
                # Zeros at the end change no cosine, and without them equal vectors have equal bytes.
                good = good and np.isfinite(row).all() and row.any()
                vectors.append((np.trim_zeros(row, "b") + 0.0).astype("<f8").tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.binary())], ["_key", "vector"])

    return source.mapInArrow(read, f"_key: {source.schema['_key'].dataType.simpleString()}, vector: binary")


def matrix(vectors: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, vector in enumerate(vectors):
        row = np.frombuffer(vector, "<f8")
        out[i, : len(row)] = row
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares of large components would overflow
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


class Cells:
    """Pivots, and how far a vector is from the borders of other cells."""

    def __init__(self, pivots: np.ndarray, radius: float):
        self.pivots, self.radius = pivots, radius
        # From differences: 2 - 2 cos cancels where pivots have nearly one direction.
        self.apart = np.stack([np.sqrt(((pivots - p) ** 2).sum(axis=1)) for p in pivots])

    def homes(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(home of each row, (row, cell): whether the row is a guest there)."""
        near = rows @ self.pivots.T
        home = near.argmax(axis=1)
        best = near[np.arange(len(rows)), home]
        # |v - j|^2 - |v - h|^2 = 2 (v.h - v.j) for unit vectors.
        guest = best[:, None] - near <= (self.radius + 1e-9) * self.apart[home] + 1e-12
        guest &= np.arange(near.shape[1])[None, :] < home[:, None]
        return home, guest


def spanning(pairs: np.ndarray, count: int) -> np.ndarray:
    """The least node that each of `count` nodes is connected to."""
    label = np.arange(count)
    while True:
        low = np.minimum(label[pairs[:, 0]], label[pairs[:, 1]])
        after = label.copy()
        np.minimum.at(after, pairs[:, 0], low)
        np.minimum.at(after, pairs[:, 1], low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def linked(left: np.ndarray, right: np.ndarray, cosine: float, left32=None, right32=None) -> np.ndarray:
    """(row of left, row of right) with at least this cosine; both hold unit rows."""
    left32 = left.astype(np.float32) if left32 is None else left32
    right32 = right.astype(np.float32) if right32 is None else right32
    product = left32 @ right32.T
    a, b = np.nonzero(product >= np.float32(cosine - _SLACK))
    close = np.flatnonzero(product[a, b] < cosine + _SLACK)
    keep = np.ones(len(a), bool)
    for first in range(0, len(close), 65536):
        some = close[first : first + 65536]
        keep[some] = np.einsum("ij,ij->i", left[a[some]], right[b[some]]) >= cosine
    return np.stack([a[keep], b[keep]], axis=1)


class Chunk:
    """The vectors at home in a chunk of a cell, and what they are linked to."""

    def __init__(self, ids: list[str], counts: np.ndarray, rows: np.ndarray, cosine: float):
        self.ids, self.counts, self.rows, self.cosine = ids, counts, rows, cosine
        self.single = rows.astype(np.float32)
        self.links = np.zeros(len(ids), np.int64)
        self.out: list[tuple[str, str, int]] = []
        for i in range(0, len(ids), BLOCK):
            for j in range(i, len(ids), BLOCK):
                here, there = slice(i, i + BLOCK), slice(j, j + BLOCK)
                pairs = linked(rows[here], rows[there], cosine, self.single[here], self.single[there])
                pairs += [i, j]
                pairs = pairs[pairs[:, 0] < pairs[:, 1]]
                if len(pairs):
                    np.add.at(self.links, pairs[:, 0], counts[pairs[:, 1]])
                    np.add.at(self.links, pairs[:, 1], counts[pairs[:, 0]])
                    self._join(pairs, ids)

    def _join(self, pairs: np.ndarray, names: list[str]) -> None:
        nodes, flat = np.unique(pairs, return_inverse=True)
        label = spanning(flat.reshape(pairs.shape), len(nodes))
        self.out += [
            (names[nodes[i]], names[nodes[r]], 0) for i, r in enumerate(label.tolist()) if i != r
        ]

    def guests(self, ids: list[str], counts: np.ndarray, rows: np.ndarray) -> None:
        single = rows.astype(np.float32)
        for j in range(0, len(ids), BLOCK):
            there = slice(j, j + BLOCK)
            found = [
                linked(self.rows[i : i + BLOCK], rows[there], self.cosine, self.single[i : i + BLOCK], single[there]) + [i, j]
                for i in range(0, len(self.ids), BLOCK)
            ]
            pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            if len(pairs):
                np.add.at(self.links, pairs[:, 0], counts[pairs[:, 1]])
                own = np.zeros(len(ids), np.int64)
                np.add.at(own, pairs[:, 1], self.counts[pairs[:, 0]])
                self.out += [(ids[i], ids[i], int(own[i])) for i in np.flatnonzero(own).tolist()]
                self._join(pairs + [0, len(self.ids)], self.ids + ids)

    def rest(self) -> list[tuple[str, str, int]]:
        return self.out + [(self.ids[i], self.ids[i], int(self.links[i])) for i in np.flatnonzero(self.links).tolist()]


def _as_batch(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, ["a", "b", "links"])


def joined(classes: DataFrame, cosine: float, cell: int = CELL, chunk: int = CHUNK) -> DataFrame:
    """(a, b, links): links of class a (where b = a), or an edge of a spanning forest. `classes`: (class, vector, n)."""
    spark = classes.sparkSession
    total, width = classes.agg(F.count("*"), F.max(F.octet_length("vector") / 8)).first()
    if not total:
        return spark.createDataFrame([], _JOINED)
    width = int(width)
    pivots = min(PIVOTS, math.ceil(total / cell))
    # The order of the classes' hashes is a random one: a bounded sample for pivots.
    sample = [r[0] for r in classes.orderBy("class").limit(pivots).select("vector").collect()]
    radius = math.sqrt(2 - 2 * cosine)
    shared = spark.sparkContext.broadcast(unit(matrix(sample, width)))

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(shared.value, radius)
        for batch in batches:
            home, _ = cells.homes(unit(matrix(batch.column(0).to_pylist(), width)))
            cell_ids, counts = np.unique(home, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell_ids), pa.array(counts)], ["cell", "n"])

    sizes = classes.select("vector").mapInArrow(at_home, "cell: bigint, n: bigint").groupBy("cell").agg(F.sum("n"))
    chunks = {c: math.ceil(n / chunk) for c, n in sizes.collect()}  # at most one row for each pivot

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(shared.value, radius)
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                part = batch.slice(first, BLOCK)
                home, guest = cells.homes(unit(matrix(part.column(1).to_pylist(), width)))
                rows = []  # (row, cell, chunk, guest)
                for i, (name, c) in enumerate(zip(part.column(0).to_pylist(), home.tolist())):
                    own = int(name[:8], 16) % chunks[c]
                    rows += [(i, c, k, k != own) for k in range(own + 1)]
                    rows += [(i, j, k, True) for j in np.flatnonzero(guest[i]).tolist() for k in range(chunks.get(j, 0))]
                which = pa.array([r[0] for r in rows], pa.int64())
                columns = [pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.bool_()))]
                columns += [part.column(k).take(which) for k in range(3)]
                yield pa.RecordBatch.from_arrays(columns, ["cell", "chunk", "guest", "class", "vector", "n"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, counts, rows, found = None, [], [], [], None

        def closed() -> Chunk:
            return Chunk(ids, np.array(counts, np.int64), np.concatenate(rows), cosine)

        for batch in batches:
            places = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)], axis=1)
            edges = np.flatnonzero((places[1:] != places[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(places)]):
                if a == b:
                    continue
                c, k, visiting = places[a].tolist()
                if (c, k) != now:
                    if now is not None and (found or ids):
                        yield _as_batch((found or closed()).rest())
                    now, ids, counts, rows, found = (c, k), [], [], [], None
                part = batch.slice(a, b - a)
                own = part.column(3).to_pylist(), part.column(5).to_numpy(), unit(matrix(part.column(4).to_pylist(), width))
                if not visiting:
                    ids += own[0]
                    counts += own[1].tolist()
                    rows.append(own[2])
                elif ids:  # guests come after all that are at home
                    found = found or closed()
                    found.guests(*own)
        if now is not None and (found or ids):
            yield _as_batch((found or closed()).rest())

    places = "cell: bigint, chunk: bigint, guest: boolean, class: string, vector: binary, n: bigint"
    spread = classes.select("class", "vector", "n").mapInArrow(dealt, places)
    together = spread.repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "guest")
    return together.mapInArrow(met, _JOINED)


def grouped(
    vectors: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding",
    cell: int = CELL, chunk: int = CHUNK,
) -> DataFrame:
    """(key, n_links, component_id, kept) of each vector."""
    rows, _ = kept(parsed(keyed(vectors, key, _vector=vector)).withColumn("class", F.md5("vector")), "vectors")
    classes, _ = kept(
        rows.filter("vector IS NOT NULL")
        .groupBy("class")
        .agg(F.min("_key").alias("least"), F.count("*").alias("n"), F.min("vector").alias("vector")),
        "classes",
    )
    met, _ = kept(joined(classes, cosine, cell, chunk), "links")
    links = met.filter("a = b").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    edges = met.filter("a <> b").select("a", "b").distinct()
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = components(ends, edges).withColumnRenamed("node", "class")
    named = (
        classes.select("class", "least", "n")
        .join(labels, "class", "left")
        .join(links, "class", "left")
        .withColumn("component", F.coalesce("component", "class"))
    )
    least = named.groupBy("component").agg(F.min("least").alias("lowest"))
    facts = named.join(least, "component").select(
        "class", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "lowest"
    )
    own = F.when(F.col("vector").isNull(), F.col("_key")).otherwise(F.col("lowest"))
    return (
        rows.join(facts, "class", "left")
        .select(F.col("_key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
    )
