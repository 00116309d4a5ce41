"""Exact top-k search by inner product: columnar branch and bound.

Components become whole numbers, floor(scale * x). Candidates stand in vertical layout, one row for each dimension, in blocks of `BLOCK` vectors. For a
chunk of queries, scores are accumulated `STEP` dimensions at a time; after each step a pair can still gain at most the product of the
norms of what is left of both vectors (Cauchy-Schwarz), and pairs that cannot reach the query's k-th score so far are compacted away.
While many pairs survive, a step is one matrix product over the block, later it runs over the list of surviving pairs. Dimensions
with most mass among the queries come first. Sums are exact: they are made in doubles where all partial sums stay
below 2^53, else in Python's whole numbers.

The queries, a stated share of the rows, are sent to the tasks in groups of about `GROUP` rows; each group is one pass over the candidates without a
shuffle, whose lists (k rows for each query and task) are written before the next begins. A task holds one block, one chunk of scores and its lists.

Defined results: vectors that are null or hold null or non-finite components take no part; an empty vector scores 0 with all; of two
lengths the shorter vector goes on with zeros; rows with the query's key are its own and no candidates; rows that repeat a query's key and vector are
one query, with another vector they are queries of their own; equal scores go to the smaller key, null keys last; a null key is no query; scores beyond
64 bits are ranked exactly and shown as the nearest 64-bit number; an empty table gives an empty table. Keys are whole numbers. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronicle.llm.frames import keyed, kept

TOP, SCALE = 10, 1024
BLOCK, STEP = 2048, 16  # candidates in a block; dimensions in a step
CHUNK, GROUP = 512, 16384  # queries compared with a block at a time; queries sent to the tasks at a time
DENSE = 0.25  # share of surviving pairs up to which a step runs over the list of pairs
_EXACT, _TAME = float(1 << 53), float(1 << 26)  # doubles hold whole numbers below; norms whose products stay below that
_LONG = (1 << 63) - 1


def whole(value: pa.Scalar, scale: int) -> np.ndarray | None:
    """floor(scale * x) of each component; doubles, or Python numbers where doubles are not exact."""
    row = value.values
    if row is None or row.null_count:
        return None
    row = np.asarray(row.cast(pa.float64()), np.float64)
    if not np.isfinite(row).all():
        return None
    with np.errstate(over="ignore"):
        scaled = np.floor(row * scale)
    if np.abs(scaled).max(initial=0.0) < _EXACT:
        return scaled + 0.0
    return np.array([int(x.as_integer_ratio()[0] * scale // x.as_integer_ratio()[1]) for x in row.tolist()], object)


class Queries:
    """Queries as rows, dimensions in falling order of mass, and the norms of what follows each step."""

    def __init__(self, keys: list[int], vectors: list[np.ndarray]):
        self.keys = np.array(keys, np.int64)
        self.vectors = vectors
        self.width = max((len(v) for v in vectors), default=0)
        self.plain = np.array([v.dtype != object for v in vectors], bool)
        self.rows = np.zeros((len(vectors), self.width))
        for i, vector in enumerate(vectors):
            if vector.dtype != object:
                self.rows[i, : len(vector)] = vector
        with np.errstate(over="ignore"):
            mass = (self.rows * self.rows).sum(axis=0)
        self.order = np.argsort(-mass, kind="stable")
        self.rows = self.rows[:, self.order]
        self.left = remaining(self.rows)


def remaining(rows: np.ndarray) -> np.ndarray:
    """(row, step): the norm of the dimensions after that many steps."""
    steps = -(-rows.shape[1] // STEP)
    out = np.zeros((len(rows), steps + 1))
    for step in range(steps - 1, -1, -1):
        part = rows[:, step * STEP : (step + 1) * STEP]
        with np.errstate(over="ignore"):
            out[:, step] = out[:, step + 1] + (part * part).sum(axis=1)
    return np.sqrt(out)


def _near(score) -> float:
    return float(max(-(10**300), min(10**300, int(score))))


class Lists:
    """The k best (score, key) rows of each query of a chunk; `floor` is a score that a further row must reach."""

    def __init__(self, count: int, top: int):
        self.top = top
        self.query, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.key, self.null = np.zeros(0, np.int64), np.zeros(0, bool)
        self.floor = np.full(count, -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, key: np.ndarray, null: np.ndarray) -> None:
        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        key, null = np.concatenate([self.key, key]), np.concatenate([self.null, null])
        falling = -(np.unique(score, return_inverse=True)[1] if score.dtype == object else score)
        by = np.lexsort((key, null, falling, query))
        query = query[by]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        last = rank == self.top - 1
        self.floor[query[last]] = [_near(x) for x in score[by[last]]]
        keep = by[rank < self.top]
        self.query, self.score, self.key, self.null = query[rank < self.top], score[keep], key[keep], null[keep]


class Search:
    """Lists of one task, for chunks of queries."""

    def __init__(self, queries: Queries, top: int):
        self.queries = queries
        firsts = range(0, len(queries.keys), CHUNK)
        self.chunks = [np.arange(first, min(first + CHUNK, len(queries.keys))) for first in firsts]
        self.lists = [Lists(len(some), top) for some in self.chunks]
        self.tame = queries.plain & (queries.left[:, 0] < _TAME)
        self.compared = 0  # products of a pair's dimensions that were computed

    def block(self, keys: np.ndarray, null: np.ndarray, vectors: list[np.ndarray]) -> None:
        width = self.queries.width
        columns = np.zeros((width, len(vectors)))  # vertical layout
        tame = np.array([v.dtype != object for v in vectors], bool)
        for i, vector in enumerate(vectors):
            if tame[i]:
                size = min(len(vector), width)
                columns[:size, i] = vector[:size]
        columns = columns[self.queries.order]
        left = remaining(columns.T).T
        tame &= left[0] < _TAME
        fast, slow = np.flatnonzero(tame), np.flatnonzero(~tame)
        for some, lists in zip(self.chunks, self.lists):
            plain = self.tame[some]
            if plain.any() and len(fast):
                self._chunk(np.flatnonzero(plain), some[plain], fast, columns, left, keys, null, lists)
            for place, q in enumerate(some.tolist()):
                self._exactly(place, q, slow if plain[place] else np.arange(len(vectors)), vectors, keys, null, lists)

    def _exactly(self, place: int, q: int, which: np.ndarray, vectors, keys, null, lists: Lists) -> None:
        which = which[null[which] | (keys[which] != self.queries.keys[q])]
        if not len(which):
            return
        mine, scores = [int(x) for x in self.queries.vectors[q]], np.empty(len(which), object)
        for i, c in enumerate(which.tolist()):
            scores[i] = sum(x * int(y) for x, y in zip(mine, vectors[c]))
        lists.add(np.full(len(which), place), scores, keys[which], null[which])

    def _chunk(self, places: np.ndarray, some: np.ndarray, fast: np.ndarray, columns, left, keys, null, lists: Lists) -> None:
        rows, mine, floor = self.queries.rows[some], self.queries.left[some], lists.floor[places]
        here, rest, keys, null = columns[:, fast], left[:, fast], keys[fast], null[fast]
        own = (keys[None, :] == self.queries.keys[some][:, None]) & ~null[None, :]
        scores, alive, pairs, sums = np.zeros(own.shape), ~own, None, None
        for step in range(mine.shape[1] - 1):
            part = range(step * STEP, min((step + 1) * STEP, rows.shape[1]))
            if pairs is None:
                self.compared += scores.size * len(part)
                scores += rows[:, part.start : part.stop] @ here[part.start : part.stop]
                reach = scores + mine[:, step + 1, None] * rest[step + 1] * (1 + 1e-9)
                alive &= reach >= floor[:, None]
                if alive.mean() < DENSE:
                    pairs = np.nonzero(alive)
                    sums = scores[pairs]
            else:
                a, b = pairs
                self.compared += len(a) * len(part)
                for x in part:
                    sums += rows[a, x] * here[x, b]
                keep = sums + mine[a, step + 1] * rest[step + 1, b] * (1 + 1e-9) >= floor[a]
                pairs, sums = (a[keep], b[keep]), sums[keep]
        if pairs is None:
            # Of the pairs that are left, those below a query's k-th score in this block cannot enter its list.
            shown = np.where(alive, scores, -np.inf)
            if shown.shape[1] > lists.top:
                alive &= shown >= -np.partition(-shown, lists.top - 1, axis=1)[:, lists.top - 1, None]
            pairs = np.nonzero(alive)
            sums = scores[pairs]
        a, b = pairs
        if len(a):
            lists.add(places[a], sums.astype(np.int64), keys[b], null[b])


def _search(candidates: DataFrame, queries: DataFrame, top: int, scale: int) -> DataFrame:
    """(query_id, vec_id, score): the best rows of each task for each query of one group."""
    shared = candidates.sparkSession.sparkContext.broadcast([tuple(r) for r in queries.collect()])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict = {}
        for key, vector in shared.value:
            made = None if vector is None else whole(pa.scalar(vector, pa.list_(pa.float64())), scale)
            if made is not None:
                asked.setdefault((key, tuple(made.tolist())), made)
        search = Search(Queries([k for k, _ in asked], list(asked.values())), top)
        keys, null, held = [], [], []

        def flush() -> None:
            if held:
                order = np.array([0 if n else k for k, n in zip(keys, null)], np.int64)
                search.block(order, np.array(null, bool), held)

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                vector = whole(value, scale)
                if vector is None:
                    continue
                keys.append(key)
                null.append(key is None)
                held.append(vector)
                if len(held) == BLOCK:
                    flush()
                    keys, null, held = [], [], []
        flush()
        for some, lists in zip(search.chunks, search.lists):
            scores = [int(x) for x in lists.score]
            shown = [max(-_LONG - 1, min(_LONG, x)) for x in scores]
            exact = [str(x) if abs(x) > _LONG else None for x in scores]  # as text, beyond 64 bits
            number = some[lists.query]
            columns = [pa.array(number, pa.int64()), pa.array(search.queries.keys[number], pa.int64())]
            columns += [pa.array(lists.key, pa.int64(), mask=lists.null), pa.array(shown, pa.int64()), pa.array(exact, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["_number", "query_id", "vec_id", "score", "_exact"])

    return candidates.mapInArrow(searched, "_number: bigint, query_id: bigint, vec_id: bigint, score: bigint, _exact: string")


def top_k(
    vectors: DataFrame, asked: Column, top: int = TOP, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding", group: int = GROUP
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the `top` highest inner products of each row that `asked` selects by its key, `_key`."""
    source = keyed(vectors, key, _vector=vector).select(F.col("_key").cast("long").alias("_key"), "_vector")
    queries = source.filter(asked)
    groups = max(1, -(-queries.count() // group))
    number = F.pmod(F.xxhash64("_key"), F.lit(groups))
    found = None
    for i in range(groups):
        part, _ = kept(_search(source, queries.filter(number == i), top, scale), "nearest")
        found = part if found is None else found.unionByName(part)
    # Whole numbers as text: a sign, a length and the digits order them.
    digits = F.regexp_replace("_exact", "^-", "")
    beyond = F.when(F.col("_exact").isNull(), F.lit(0)).otherwise(F.length(digits) * F.when(F.col("score") < 0, -1).otherwise(1))
    order = [F.desc("score"), F.desc("_beyond"), F.desc("_digits"), F.col("vec_id").asc_nulls_last()]
    flipped = F.when(F.col("score") < 0, F.translate(digits, "0123456789", "9876543210")).otherwise(digits)
    ranked = found.withColumn("_beyond", beyond).withColumn("_digits", flipped).withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id", "_number").orderBy(*order))
    )
    return ranked.filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
