"""Ranked lexical search by presence masks: every item of a query set against all documents.

One pass over the documents writes an index in blocks: the keys and lengths of up to `BLOCK` documents in ascending order of keys, and for each
term of the query set its documents in the block and how often it occurs there. The corpus counts (documents with terms, terms, documents
of each query term) are sums over the blocks. A second pass reads the blocks alone. In a block, an item's terms set bits in one mask for each
document, and documents with equal masks are one group. The greatest impact of a term in the block bounds the score of every mask; masks
are evaluated by descending bound until the bound falls below the k-th score the task has found for the item, since nothing later can
enter its list. Tasks pass on k rows for each item; these lists are merged under salts first, so no task reads all lists of an item.

Scores are whole numbers: a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), a document's m is 75 + (25 n N) div L, and the score sums
weight * ((10^9 tf) div (1000 tf + 12 m)) over an item's terms, repeats included.

Bounds: the query set is sent to the tasks in groups of about `GROUP` bytes of text, one index each. A block holds at most `BLOCK` documents and about
`POSTINGS` postings; a task holds one block, one item's mask for each of its documents and k rows for each item.

Defined results: null texts and texts without a term are not counted and never found; items without a term, or with a null text, find
nothing; equal scores go to the smaller key, null keys last; repeated rows are documents (or items) of their own; empty tables give an
empty table. Only keys and texts are read. Keys may have any type that Spark orders.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, StructField, StructType

from chronicle.llm.frames import as_bytes, keyed, kept

TOP = 20
BLOCK, POSTINGS = 8192, 1 << 20  # documents in a block; postings after which a block is closed
GROUP = 16 << 20  # bytes of item texts that are sent to the tasks at a time
SALTS = 64
_WORD = 64  # bits of a mask word
# Which bytes belong to a term (digits, letters, all beyond ASCII), with A-Z lower-cased; the rest parts terms.
_TERM = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in order, repeats included."""
    return (text or b"").lower().translate(_TERM).split()


def weight(n_documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, lengths: np.ndarray, n_documents: int, n_terms: int) -> np.ndarray:
    """What each occurrence count adds for a weight of 1."""
    if 25 * int(lengths.max(initial=0)) * n_documents < 1 << 62:
        m = 75 + (25 * lengths * n_documents) // n_terms
    else:
        m = np.array([75 + 25 * n * n_documents // n_terms for n in lengths.tolist()], np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Block:
    """Documents and postings under construction."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.vocabulary = vocabulary
        self.lengths: list[int] = []
        self.rows: list[int] = []
        self.places: list[int] = []
        self.found: list[int] = []
        self.counts: list[int] = []

    def add(self, row: int, text: bytes | None) -> None:
        """`row` is the document's row in its batch."""
        words = terms(text)
        if not words:
            return
        get = self.vocabulary.get
        for word, count in Counter(words).items():
            if (term := get(word)) is not None:
                self.found.append(term)
                self.counts.append(count)
                self.places.append(len(self.rows))
        self.rows.append(row)
        self.lengths.append(len(words))

    def full(self) -> bool:
        return len(self.rows) >= BLOCK or len(self.found) >= POSTINGS

    def finished(self, keys: pa.Array) -> pa.RecordBatch:
        """One row; documents in ascending order of keys, postings by term and document."""
        keys = keys.take(pa.array(self.rows, pa.int64()))
        order = pc.sort_indices(keys, null_placement="at_end").to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        found, counts = np.array(self.found, np.int32), np.array(self.counts, np.int32)
        at = place[np.array(self.places, np.int64)] if len(found) else np.zeros(0, np.int64)
        by = np.lexsort((at, found))
        ids, sizes = np.unique(found, return_counts=True)
        lengths = np.array(self.lengths, np.int64)[order]
        values = [keys.take(pa.array(order)), lengths, ids, sizes.astype(np.int32), at[by].astype(np.int32), counts[by]]
        lists = [pa.ListArray.from_arrays([0, len(v)], v if isinstance(v, pa.Array) else pa.array(v)) for v in values]
        return pa.RecordBatch.from_arrays(lists, ["keys", "lengths", "terms", "sizes", "places", "counts"])


def index(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """The block index of the documents, restricted to the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    source = keyed(docs, key, _text=text)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, base = Block(shared.value), [], 0
        for batch in batches:
            held.append(batch.column(0))
            for i, value in enumerate(batch.column(1)):
                block.add(base + i, None if not value.is_valid else value.as_buffer().to_pybytes())
                if block.full():
                    yield block.finished(pa.concat_arrays(held))
                    block, held, base = Block(shared.value), [batch.column(0)], 0
            base = sum(len(x) for x in held)
        if block.rows:
            yield block.finished(pa.concat_arrays(held))

    kind = source.schema["_key"].dataType.simpleString()
    columns = f"keys: array<{kind}>, lengths: array<bigint>, terms: array<int>, sizes: array<int>, places: array<int>, counts: array<int>"
    return source.mapInArrow(blocks, columns)


class Item:
    """One item: its different terms and what an impact of 1 in each is worth."""

    def __init__(self, words: list[int], weights: dict[int, int]):
        count = Counter(w for w in words if weights.get(w, 0) > 0)
        self.terms = sorted(count)
        self.worth = [weights[t] * count[t] for t in self.terms]

    def masks(self, postings: dict[int, tuple[np.ndarray, np.ndarray]], size: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """(group of each document, one document of each group, terms present in the block); group -1 has no term."""
        present = [i for i, t in enumerate(self.terms) if t in postings]
        group, heads = np.full(size, -1, np.int64), np.zeros(0, np.int64)
        some = np.zeros(size, bool)
        for i in present:
            some[postings[self.terms[i]][0]] = True
        members = np.flatnonzero(some)
        number = np.zeros(len(members), np.int64)
        for first in range(0, len(present), _WORD):
            word = np.zeros(size, np.uint64)
            for bit, i in enumerate(present[first : first + _WORD]):
                word[postings[self.terms[i]][0]] |= np.uint64(1 << bit)
            _, part = np.unique(word[members], return_inverse=True)
            number = part if not first else number * (int(part.max(initial=0)) + 1) + part
            if first:
                _, number = np.unique(number, return_inverse=True)
        if len(members):
            _, heads, number = np.unique(number, return_index=True, return_inverse=True)
            group[members], heads = number, members[heads]
        return group, heads, present

    def best(
        self, postings: dict[int, tuple[np.ndarray, np.ndarray]], most: dict[int, int], size: int, top: int, floor: int
    ) -> tuple[list[tuple[int, int]], int]:
        """((score, place) of the best documents that reach `floor`, number of masks evaluated)."""
        group, heads, present = self.masks(postings, size)
        if not len(heads):
            return [], 0
        bound, seat = np.zeros(len(heads), np.int64), np.full(size, -1, np.int64)
        seat[heads] = np.arange(len(heads))
        for i in present:
            holders = seat[postings[self.terms[i]][0]]
            bound[holders[holders >= 0]] += self.worth[i] * most[self.terms[i]]
        order = np.argsort(-bound, kind="stable")
        sizes = np.bincount(group[group >= 0], minlength=len(heads))
        found_scores, found_places = np.zeros(0, np.int64), np.zeros(0, np.int64)
        done = 0
        while done < len(order) and bound[order[done]] >= max(floor, 1):
            # Masks of the next highest bounds, as many as have a few lists' worth of documents.
            last = done + 1 + int(np.searchsorted(np.cumsum(sizes[order[done:]]), max(4 * top, done)))
            chosen = np.zeros(len(heads) + 1, bool)
            chosen[order[done:last]] = bound[order[done:last]] >= floor
            wanted = chosen[group]
            scores = np.zeros(size, np.int64)
            for i in present:
                places, impact = postings[self.terms[i]]
                hit = wanted[places]
                scores[places[hit]] += self.worth[i] * impact[hit]
            places = np.flatnonzero(wanted)
            found_scores = np.concatenate([found_scores, scores[places]])
            found_places = np.concatenate([found_places, places])
            by = np.lexsort((found_places, -found_scores))[:top]
            found_scores, found_places = found_scores[by], found_places[by]
            if len(by) == top:
                floor = max(floor, int(found_scores[-1]))
            done = last
        keep = found_scores >= max(floor, 1)
        return list(zip(found_scores[keep].tolist(), found_places[keep].tolist())), min(done, len(order))


class _Worst:
    """Heap order of a list's rows: the row that leaves first is the least."""

    __slots__ = ("score", "key")

    def __init__(self, score: int, key):
        self.score, self.key = score, key

    def __lt__(self, other: "_Worst") -> bool:
        if self.score != other.score:
            return self.score < other.score
        if self.key is None or other.key is None:
            return self.key is None and other.key is not None
        return self.key > other.key


def ranked(
    blocks: DataFrame, items: list[tuple[object, list[int]]], weights: dict[int, int], counts: tuple[int, int], top: int
) -> DataFrame:
    """(_number, _key, score): the best rows of each task for each item."""
    shared = blocks.sparkSession.sparkContext.broadcast((items, weights))
    key_kind = blocks.schema["keys"].dataType.elementType.simpleString()

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, weights = shared.value
        wanted, lists = [Item(words, weights) for _, words in rows], [[] for _ in rows]
        key_type = None
        for batch in batches:
            key_type = batch.column(0).type.value_type
            for i in range(batch.num_rows):
                keys = batch.column(0)[i].values
                lengths, ids, sizes, places, tf = (batch.column(c)[i].values.to_numpy() for c in range(1, 6))
                impact = impacts(tf.astype(np.int64), lengths[places], *counts)
                ends = np.cumsum(sizes)
                postings = {
                    int(t): (places[b - s : b], impact[b - s : b]) for t, s, b in zip(ids, sizes.tolist(), ends.tolist())
                }
                most = {t: int(x.max()) for t, (_, x) in postings.items()}
                for item, held in zip(wanted, lists):
                    floor = held[0].score if len(held) == top else 1
                    for score, place in item.best(postings, most, len(lengths), top, floor)[0]:
                        row = _Worst(score, keys[place].as_py())
                        if len(held) < top:
                            heapq.heappush(held, row)
                        elif held[0] < row:
                            heapq.heapreplace(held, row)
        if key_type is None:
            return
        for number, held in enumerate(lists):
            if held:
                columns = [pa.array([number] * len(held), pa.int32())]
                columns += [pa.array([r.key for r in held], key_type), pa.array([r.score for r in held], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["_number", "_key", "score"])

    return blocks.mapInArrow(searched, f"_number: int, _key: {key_kind}, score: bigint")


def _merged(rows: DataFrame, top: int) -> DataFrame:
    order = (F.desc("score"), F.col("_key").asc_nulls_last())
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(SALTS)))
    first = F.row_number().over(Window.partitionBy("_number", "_salt").orderBy(*order))
    last = F.row_number().over(Window.partitionBy("_number").orderBy(*order))
    few = salted.withColumn("rank", first).filter(F.col("rank") <= top)
    return few.withColumn("rank", last).filter(F.col("rank") <= top).select("_number", "rank", "_key", "score")


def _numbered(kind: DataType) -> StructType:
    return StructType([StructField("_number", IntegerType()), StructField("_item", kind)])


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", group: int = GROUP,
) -> DataFrame:
    """(item key, rank, key, score) of each item's `top` highest-scoring documents with a score above 0."""
    spark = docs.sparkSession
    asked = keyed(items, item_key, _text=item_text)
    n_bytes = asked.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    groups = max(1, -(-n_bytes // group))
    place = F.pmod(F.xxhash64("_key", "_text"), F.lit(groups))
    item_type = asked.schema["_key"].dataType
    out = None
    for number in range(groups):
        rows = [(r["_key"], terms((r["_text"] or "").encode())) for r in asked.filter(place == number).collect()]
        names = {t: i for i, t in enumerate(sorted({t for _, words in rows for t in words}))}
        blocks, _ = kept(index(docs, names, key, text), "postings")
        size = blocks.agg(F.sum(F.size("lengths")), F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, b: a + b))).first()
        counts = (size[0] or 0, size[1] or 0)
        pairs = blocks.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).select("x.*")
        df = pairs.groupBy("terms").agg(F.sum("sizes")).collect()  # one row for each term of this group of items
        weights = {t: weight(counts[0], n) for t, n in df}
        made = ranked(blocks, [(k, [names[w] for w in words]) for k, words in rows], weights, counts, top)
        keys = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(rows)], _numbered(item_type))
        part = _merged(made, top).join(F.broadcast(keys), "_number")
        out = part if out is None else out.unionByName(part)
    doc_name = key if key != item_key else f"doc_{key}"
    return out.select(F.col("_item").alias(item_key), "rank", F.col("_key").alias(doc_name), "score")

