"""Documents of similar text: MinHash buckets, links checked by exact Jaccard.

Words are those of `near_copies`; a text's shingles are the set of its runs of five words (fewer words: the whole sequence), as 64-bit
hashes. Texts are linked if the Jaccard similarity of their sets is at least 0.8, and groups are what links connect.

Equal sets are one class. A class has `BANDS` bucket names, each made of `ROWS` least values under random orders of the hashes, and
classes that share a bucket are compared. Two sets of similarity s share one with probability 1 - (1 - s^5)^40: all but one
in 7 million at 0.8, and more above. Buckets of one class are dropped, and of buckets with the same classes one is kept, before any set is
moved; only the sets of the classes left are made again, from their texts. A large bucket is dealt by hash into chunks, and its other
members visit each chunk. A chunk compares a set with groups, not with all pairs: the first link to a group ends the search in it.

Defined results: null, empty and blank texts have the empty set and are one class; null keys name no group; an empty table gives an
empty table. Only key and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronicle.llm.frames import as_bytes, keyed, kept, released
from chronicle.operators.entities import components

WORDS, SIMILAR = 5, (4, 5)  # words in a shingle; least similarity, as a fraction
BANDS, ROWS = 40, 5
CHUNK, SHINGLES = 500, 1 << 20  # classes and shingles in a chunk, on average
_ORDERS = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = np.random.default_rng(43).integers(0, 1 << 63, WORDS + 1, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted hashes of the different shingles."""
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    words = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    size = min(WORDS, len(words))
    runs = np.full(len(words) - size + 1, size, np.uint64) * _PLACES[WORDS]
    for i in range(size):
        runs += words[i : len(words) - size + 1 + i] * _PLACES[i]
    return np.unique(_mixed(runs))


def buckets(hashes: np.ndarray) -> np.ndarray:
    """One name for each band, none for the empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for first in range(0, len(hashes), 2048):
        some = hashes[first : first + 2048]
        for i, (factor, term) in enumerate(_ORDERS.T):
            least[i] = min(least[i], (some * factor + term).min())
    rows = _mixed(least).reshape(BANDS, ROWS)
    names = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        names = _mixed(names * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return names.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity; decided in whole numbers."""
    top, bottom = SIMILAR
    if len(a) > len(b):
        a, b = b, a
    if len(a) * bottom < len(b) * top:
        return False
    at = np.searchsorted(b, a)
    both = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
    return both * bottom >= (len(a) + len(b) - both) * top


def prints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_key, class, digest, n, buckets): the name of the shingle set, of the text, the set's size and its bucket names."""
    source = keyed(docs, key, _text=text).withColumn("_digest", F.md5("_text"))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                sets = [shingles(t) for t in as_bytes(part.column(1))]
                columns = [
                    part.column(0),
                    pa.array([blake2b(s.tobytes(), digest_size=16).hexdigest() for s in sets]),
                    part.column(2),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([buckets(s) for s in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["_key", "class", "digest", "n", "buckets"])

    kind = source.schema["_key"].dataType.simpleString()
    return source.mapInArrow(marked, f"_key: {kind}, class: string, digest: string, n: bigint, buckets: array<bigint>")


class Chunk:
    """Groups of linked sets, and the links that made them."""

    def __init__(self):
        self.groups: list[list[tuple[str, np.ndarray]]] = []

    def add(self, name: str, hashes: np.ndarray, guest: bool) -> list[str]:
        """One linked member of each group that has one; those groups become one, with the new member unless it is a guest."""
        met, apart, linked = [], [], []
        for group in self.groups:
            other = next((n for n, h in group if similar(hashes, h)), None)
            (apart if other is None else met).append(group)
            if other is not None:
                linked.append(other)
        met.sort(key=len)
        joined = met.pop() if met else []
        for group in met:
            joined += group
        if not guest:
            joined.append((name, hashes))
        self.groups = apart + [joined] if joined else apart
        return linked


def links(docs: DataFrame, classes: DataFrame, text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(a, b): links that join whatever classes (class, digest, n, buckets) share a bucket and reach the similarity."""
    named = classes.select("class", "n", F.explode("buckets").alias("bucket"))
    one, two = F.bit_xor(F.xxhash64("class")), F.bit_xor(F.xxhash64("class", F.lit(1)))
    shared = (
        named.groupBy("bucket")
        .agg(F.count("*").alias("size"), F.sum("n").alias("weight"), one.alias("one"), two.alias("two"))
        .filter("size > 1")
        .groupBy("size", "weight", "one", "two")
        .agg(F.min("bucket").alias("bucket"))
    )
    chunks = F.greatest(F.ceil(F.col("size") / chunk), F.ceil(F.col("weight") / SHINGLES)).cast("int")
    members, _ = kept(
        named.join(shared.select("bucket", chunks.alias("chunks")), "bucket").select(
            "bucket", "class", F.pmod(F.xxhash64("class", F.lit(2)), F.col("chunks")).cast("int").alias("own")
        ),
        "members",
    )
    met = classes.select("class", "digest").join(members.select("class").distinct(), "class")
    texts = docs.select(F.col(text).alias("_text"), F.md5(text).alias("digest"))
    texts = texts.join(met, "digest").select("class", "_text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                sets = pa.array([shingles(t).tobytes() for t in as_bytes(part.column(1))], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), sets], ["class", "hashes"])

    # Copies of a text are read once for each class.
    sets = texts.groupBy("class").agg(F.min("_text").alias("_text")).mapInArrow(made, "class: string, hashes: binary")
    dealt = members.select("bucket", "class", "own", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("chunk"))
    together = (
        dealt.withColumn("guest", F.col("chunk") != F.col("own"))
        .join(sets, "class")
        .select("bucket", "chunk", "guest", "class", "hashes")
        .repartition("bucket", "chunk")
        .sortWithinPartitions("bucket", "chunk", "guest", "class")
    )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        now, found = None, Chunk()
        for batch in batches:
            a, b = [], []
            places = zip(*(batch.column(i).to_pylist() for i in range(4)))
            for i, (bucket, number, guest, name) in enumerate(places):
                if (bucket, number) != now:
                    now, found = (bucket, number), Chunk()
                linked = found.add(name, np.frombuffer(batch.column(4)[i].as_py(), np.uint64), guest)
                a += [name] * len(linked)
                b += linked
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])

    return together.mapInArrow(compared, "a: string, b: string")


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(key, component_id) of each row; component_id is the smallest key reachable over links."""
    marked, _ = kept(prints(docs, key, text), "shingles")
    classes, _ = kept(
        marked.groupBy("class").agg(
            F.min("_key").alias("least"), F.min("digest").alias("digest"), F.min("n").alias("n"), F.min("buckets").alias("buckets")
        ),
        "classes",
    )
    joined, _ = kept(links(docs, classes, text, chunk).distinct(), "links")
    ends = joined.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = components(ends, joined).withColumnRenamed("node", "class")
    named = classes.select("class", "least").join(labels, "class", "left")
    named = named.withColumn("component", F.coalesce("component", "class"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    names = named.join(least, "component").select("class", "component_id")
    return marked.select("_key", "class").join(names, "class").select(F.col("_key").alias(key), "component_id")
