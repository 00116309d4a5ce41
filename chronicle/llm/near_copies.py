"""SimHash near-duplicates with BK-trees.

A-Z are lower-cased, words are runs of other than ASCII white space, and a text's shingles are its runs of four words, repeats included,
joined by spaces (fewer words: the whole sequence). A bit of the fingerprint is on if it is on in over half of the shingles' XXH64
(seed 42); no words give zero. Fingerprints with at most `RADIUS` differing bits are linked.

Copies are one fingerprint, so only different fingerprints are compared. Their 64 bits are cut into six blocks; four differing bits
leave two blocks untouched, so linked fingerprints meet in one of the 15 shards named by two blocks and their values, some 21 bits, which keeps
shards small at any size. In each shard a BK-tree keys children by their integer distance to the parent, and a search follows only
edges within the radius. A shard that is too large for one tree, as a crowd of near copies makes it, is dealt by hash into several
trees, and the shard's other fingerprints search each of them. A shard emits a spanning forest, never all pairs. Components are found by
passing least labels over written tables.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any others; rows with a null key
are members without a name (the component of unnamed rows alone is null); rows with equal keys are one document, which stays or goes
as a whole; an empty table gives an empty table. Only key and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronicle.llm import similar
from chronicle.llm.frames import as_bytes, keyed, kept
from chronicle.operators.entities import components

WORDS, RADIUS, SEED = 4, 4, 42
TREE = 4000  # fingerprints in one tree at most
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))  # (first bit, bits); RADIUS + 2 of them


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    found = (text or b"").lower().split()
    if not found:
        return 0
    runs = max(1, len(found) - words + 1)
    hashed = np.fromiter(
        (xxhash.xxh64_intdigest(b" ".join(found[i : i + words]), SEED) for i in range(runs)), np.uint64, runs
    )
    bits = np.unpackbits(hashed.astype("<u8").view(np.uint8).reshape(runs, 8), axis=1, bitorder="little")
    on = 2 * np.add.reduce(bits, axis=0, dtype=np.int64) > runs
    return int(np.packbits(on, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(_key, print): the fingerprint as a signed 64-bit integer."""
    source = keyed(docs, key, _text=text)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t, words) for t in as_bytes(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], ["_key", "print"])

    return source.mapInArrow(marked, f"_key: {source.schema['_key'].dataType.simpleString()}, print: bigint")


class Tree:
    """BK-tree of 64-bit fingerprints under Hamming distance."""

    def __init__(self):
        self.prints: list[int] = []
        self.children: list[dict[int, int]] = []

    def insert(self, value: int) -> None:
        self.prints.append(value)
        self.children.append({})
        node = 0
        while node < len(self.prints) - 1:
            distance = (self.prints[node] ^ value).bit_count()
            if distance not in self.children[node]:
                self.children[node][distance] = len(self.prints) - 1
                return
            node = self.children[node][distance]

    def within(self, value: int, radius: int) -> Iterator[int]:
        todo = [0] if self.prints else []
        while todo:
            node = todo.pop()
            distance = (self.prints[node] ^ value).bit_count()
            if distance <= radius:
                yield self.prints[node]
            for edge, child in self.children[node].items():
                if -radius <= edge - distance <= radius:
                    todo.append(child)


class Forest:
    """Which members of a shard are already joined."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def top(self, value: int) -> int:
        above = self.above
        while (parent := above.get(value, value)) != value:
            above[value] = above.get(parent, parent)
            value = parent
        return value

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        if a == b:
            return False
        self.above[max(a, b)] = min(a, b)
        return True


def shard_keys(value: Column, blocks: tuple[tuple[int, int], ...] = BLOCKS) -> Column:
    """The shards of a fingerprint: one for each pair of blocks."""
    parts = [F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << width) - 1)) for low, width in blocks]
    return F.array(*[
        F.lit(n << 32).bitwiseOR(F.shiftleft(parts[i], 11)).bitwiseOR(parts[j])
        for n, (i, j) in enumerate(combinations(range(len(blocks)), 2))
    ])


def links(distinct: DataFrame, tree: int = TREE) -> DataFrame:
    """(a, b): links that join whatever fingerprints of `distinct` (print) are within the radius, directly or through others."""
    members = distinct.select("print", F.explode(shard_keys(F.col("print"))).alias("shard"))
    crowded = members.groupBy("shard").count().filter(F.col("count") > tree)
    trees = F.coalesce(F.ceil(F.col("count") / (tree / 2)), F.lit(1)).cast("int")
    # The tree a fingerprint belongs to, and the earlier trees that it only searches.
    own = F.pmod(F.xxhash64("print"), F.col("trees")).cast("int")
    dealt = (
        members.join(crowded, "shard", "left")
        .withColumn("trees", trees)
        .withColumn("own", own)
        .select("shard", "print", "own", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("tree"))
        .withColumn("guest", F.col("tree") != F.col("own"))
        .select("shard", "tree", "guest", "print")
    )

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found, forest = None, Tree(), Forest()
        for batch in batches:
            a, b = [], []
            columns = (batch.column(i).to_pylist() for i in range(4))
            for shard, tree, guest, value in zip(*columns):
                value &= (1 << 64) - 1
                if (shard, tree) != now:
                    now, found, forest = (shard, tree), Tree(), Forest()
                for other in found.within(value, RADIUS):
                    if forest.join(value, other):
                        a.append(value)
                        b.append(other)
                if not guest:
                    found.insert(value)
            pairs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)]
            yield pa.RecordBatch.from_arrays(pairs, ["a", "b"])

    together = dealt.repartition("shard", "tree").sortWithinPartitions("shard", "tree", "guest", "print")
    return together.mapInArrow(searched, "a: bigint, b: bigint")


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, tree: int = TREE) -> DataFrame:
    """(key, fingerprint, component_id) of each row; component_id is the smallest key reachable over links."""
    marked, _ = kept(fingerprints(docs, key, text, words), "prints")
    distinct, _ = kept(marked.groupBy("print").agg(F.min("_key").alias("least")), "prints")
    joined, _ = kept(links(distinct, tree).distinct(), "links")
    ends = joined.select(F.col("a").alias("node")).unionByName(joined.select(F.col("b").alias("node"))).distinct()
    labels = components(ends, joined)
    named = distinct.join(labels, distinct["print"] == labels["node"], "left").withColumn(
        "component", F.coalesce("component", "print")
    )
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    names = named.select("print", "component").join(least, "component").select("print", "component_id")
    return marked.join(names, "print").select(
        F.col("_key").alias(key), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def united(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, component_id) of each row: the groups of `grouped` and those of `similar.grouped`, joined where they share a text.

    component_id is the smallest key reachable over links of either kind. Both group digests of texts here, so rows that share a key
    but not the text join no groups. A group of either kind is a node, and a text links its two groups.
    """
    source = keyed(docs, key, _text=text).withColumn("_digest", F.md5(F.coalesce("_text", F.lit(""))))  # both kinds link null and empty
    by_print = grouped(source, "_digest", "_text").select("_digest", F.col("component_id").alias("a")).distinct()
    by_set = similar.grouped(source, "_digest", "_text").select("_digest", F.col("component_id").alias("b")).distinct()
    both, _ = kept(by_print.join(by_set, "_digest"), "both")
    joined, _ = kept(both.select("a", "b").filter("a != b").distinct(), "links")
    ends = joined.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = components(ends, joined).withColumnRenamed("node", "a")
    named, _ = kept(both.join(labels, "a", "left").select("_digest", F.coalesce("component", "a").alias("component")), "named")
    # Written, since Spark splits a join's frequent key only where no aggregate shares the join's shuffle.
    rows, _ = kept(source.select("_key", "_digest").join(named, "_digest").select("_key", "component"), "rows")
    least, _ = kept(rows.groupBy("component").agg(F.min("_key").alias("component_id")), "least")
    return rows.join(least, "component").select(F.col("_key").alias(key), "component_id")


def without_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each group of `united`, the one with the smallest key, with all its columns; rows with a null key stay.

    Fingerprints within `RADIUS` miss most copies with a similarity of five-word sets between 0.8 and some 0.95, and those sets miss copies below
    0.8 whose fingerprints are near; the corpus drops both.
    """
    members = united(docs)
    later = members.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_later")).distinct()
    return docs.join(later, docs["doc_id"] == later["_later"], "left_anti")
