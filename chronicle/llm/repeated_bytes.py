"""Suffix-array dedup: every byte covered by a `length`-byte string that also starts anywhere else is removed.

A string of `length` bytes is named by the least hash among its grams of `gram` bytes, which is the same wherever the string
stands. A text is cut into records: runs of starts whose strings have the same name from the same gram. Only strings of one name can be equal, so:

1. Records are found in each text (hashes from prefix polynomial hashes, least ones by sliding minima) and counted by name.
   Names that occur once are done; nothing but hashes and places has been shuffled.
2. Records with equal bytes (a digest, under one name) repeat as a whole; one of them stands for all of them.
3. What is left are different records of one name, as at the ends of shared passages. Their bytes are brought together by name and
   their suffixes are sorted: a merge sort that compares two suffixes by the length of their common extension, found by binary search over
   prefix hashes. Neighbours in that order with equal hashes over `length` bytes are verified byte by byte; they are repeats.

A name with more than `crowd` different records, as a passage in a great part of all documents makes it, is not sorted in one task:
its strings become rows, counted by a 128-bit digest before and after the shuffle, which is exact in the same way.

Shorter passages, which the rule leaves in place, are told in `n_shared`: how many named grams of `SHARED` bytes of a text stand anywhere else
too (by 64-bit hashes). The least gram in each `REACH` bytes names them, so a text that shares any string of `REACH` bytes has one.

Defined results: null and empty texts, and those shorter than `length`, lose nothing; matches never cross documents; a string may overlap its own
repeat; strings are judged on the input. Rows that repeat key and text are documents of their own and so repeat each other. An
empty table gives an empty table. Only key and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronicle.llm.frames import as_bytes, dropped, keyed, kept

LENGTH, GRAM = 400, 200
SHARED, REACH = 150, 250  # bytes of the grams that `n_shared` counts, and of the strings that surely hold one
CROWD = 4096  # different records of one name that are sorted together
FREQUENT, SALTS = 1000, 32  # records of one name beyond which their rows are salted, and by how much
POWERS = 1 << 18  # longest text for which a Python worker keeps the powers
TOGETHER = 400_000  # suffixes sorted at a time, or those of one name

_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(23).integers(1, 1 << 63, 256, dtype=np.uint64)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2^64, and of its inverse; kept up to `POWERS`."""
    return _made_powers(POWERS) if size <= POWERS else _made_powers.__wrapped__(size)


@lru_cache(maxsize=1)
def _made_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


class Hashes:
    """Prefix polynomial hashes of bytes: the hash of any substring in constant time."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * up[: len(data)], out=self.total[1:])

    def at(self, begin: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.total[begin + length] - self.total[begin]) * self.down[begin]

    def every(self, length: int) -> np.ndarray:
        count = max(0, len(self.total) - length)
        return (self.total[length:] - self.total[:count]) * self.down[:count]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values, from running minima of blocks in both directions."""
    count = len(values) - width + 1
    if count <= 0:
        return values[:0]
    blocks = np.concatenate([values, np.full(-len(values) % width, _TOP)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def records_of(text: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first start, last start) of each record of a text."""
    data = np.frombuffer(text, np.uint8)
    grams = _mixed(Hashes(data).every(gram))
    names = sliding_least(grams, length - gram + 1)
    # A record also ends where the gram of its name does not reach the next start, though another equal one may.
    turns = np.flatnonzero((names[1:] != names[:-1]) | (grams[: len(names) - 1] == names[:-1])) + 1
    first = np.concatenate([[0], turns])
    return names[first], first, np.concatenate([turns, [len(names)]]) - 1


def records(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(_key, _print, name, digest, first, last) of all records; _print is a hash of the text."""
    kind = docs.schema["_key"].dataType.simpleString()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                rows, names, digests, firsts, lasts = [], [], [], [], []
                for i, text in enumerate(as_bytes(batch.column(2).slice(begin, 512))):
                    if text is None or len(text) < length:
                        continue
                    name, first, last = records_of(text, length, gram)
                    view = memoryview(text)
                    digests += [
                        hashlib.blake2b(view[a : b + length], digest_size=8).digest()
                        for a, b in zip(first.tolist(), last.tolist())
                    ]
                    rows.append(np.full(len(name), begin + i))
                    names.append(name)
                    firsts.append(first)
                    lasts.append(last)
                if not rows:
                    continue
                which = pa.array(np.concatenate(rows))
                columns = [batch.column(0).take(which), batch.column(1).take(which)]
                columns.append(pa.array(np.concatenate(names).view(np.int64)))
                columns.append(pa.array(np.frombuffer(b"".join(digests), "<i8")))
                columns += [pa.array(np.concatenate(x).astype(np.int64)) for x in (firsts, lasts)]
                yield pa.RecordBatch.from_arrays(columns, ["_key", "_print", "name", "digest", "first", "last"])

    schema = f"_key: {kind}, _print: bigint, name: bigint, digest: bigint, first: bigint, last: bigint"
    return docs.mapInArrow(found, schema)


class Suffixes:
    """Merge sort of suffixes inside classes; each suffix has `length` bytes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length, self.hashes = data, length, Hashes(data)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of the suffixes at a and b, by binary search over hashes."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.length, np.int64)
        same = self.hashes.at(a, self.length) == self.hashes.at(b, self.length)
        low[same] = self.length
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_] + 1) >> 1
            equal = self.hashes.at(a[open_], middle) == self.hashes.at(b[open_], middle)
            low[open_] = np.where(equal, middle, low[open_])
            high[open_] = np.where(equal, high[open_], middle - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether the suffix at a comes before that at b; equal ones do where `ties`."""
        shared = self.common(a, b)
        equal = shared >= self.length
        at = np.minimum(shared, self.length - 1)
        return np.where(equal, ties, self.data[a + at] < self.data[b + at])

    def sort(self, starts: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and classes in the order of classes and, in each, of suffixes. Runs of all classes are merged at once."""
        order = np.argsort(classes, kind="stable")
        starts, classes = starts[order], classes[order]
        turns = np.flatnonzero(classes[1:] != classes[:-1]) + 1
        begin = np.concatenate([[0], turns])
        size = np.diff(np.concatenate([begin, [len(starts)]]))
        base, count = np.repeat(begin, size), np.repeat(size, size)
        own = np.arange(len(starts)) - base
        run = 1
        while run < (int(size.max()) if len(size) else 0):
            block = own // (2 * run) * (2 * run)
            right = own - block >= run
            other = np.where(right, block, block + run)  # first place of the run to merge with
            low = np.zeros(len(starts), np.int64)
            high = np.clip(count - other, 0, run)
            # How many of the other run come before: binary search, one comparison of suffixes a step.
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) >> 1
                there = starts[base[open_] + other[open_] + middle]
                less = self.before(there, starts[open_], right[open_])
                low[open_] = np.where(less, middle + 1, low[open_])
                high[open_] = np.where(less, high[open_], middle)
            place = base + block + (own - block - np.where(right, run, 0)) + low
            merged = np.empty_like(starts)
            merged[place] = starts
            starts = merged
            run *= 2
        return starts, classes

    def repeated(self, starts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Starts whose string also stands at another start of their class, verified byte by byte."""
        starts, classes = self.sort(starts, classes)
        near = np.flatnonzero(
            (classes[1:] == classes[:-1])
            & (self.hashes.at(starts[1:], self.length) == self.hashes.at(starts[:-1], self.length))
        )
        mark = np.zeros(len(starts), bool)
        strings = np.lib.stride_tricks.sliding_window_view(self.data, self.length) if len(near) else None
        for first in range(0, len(near), 4096):
            some = near[first : first + 4096]
            same = (strings[starts[some]] == strings[starts[some + 1]]).all(axis=1)
            mark[some[same]] = mark[some[same] + 1] = True
            for i in some[~same].tolist():  # hashes collided: compare the whole class by its bytes
                own = np.flatnonzero(classes == classes[i])
                texts = [strings[s].tobytes() for s in starts[own].tolist()]
                mark[[j for j, t in zip(own.tolist(), texts) if texts.count(t) > 1]] = True
        return starts[mark]


def repeats_in(groups: list[tuple[int, list[bytes]]], length: int, gram: int) -> list[list[np.ndarray]]:
    """For each name, with the bytes of its different records: the starts in each record that repeat among them."""
    texts = [text for _, members in groups for text in members]
    names = np.repeat(np.array([name for name, _ in groups], np.int64), [len(m) for _, m in groups])
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    offset = np.cumsum(sizes) - sizes
    sorter = Suffixes(data, length)
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(texts)), counts)
    starts = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + offset[owner]
    # Equal strings have the gram of their name at the same distance, so starts are classed by name and distance.
    grams = _mixed(sorter.hashes.every(gram)).view(np.int64)
    record = np.searchsorted(offset, np.arange(len(grams)), side="right") - 1
    holds = np.flatnonzero(grams == names[record])
    distance = holds[np.searchsorted(holds, starts)] - starts
    group = np.repeat(np.arange(len(groups)), [len(m) for _, m in groups])
    found = sorter.repeated(starts, group[owner] * (length + 1) + distance)
    found.sort()
    own = np.searchsorted(offset, found, side="right") - 1
    split = np.split(found - offset[own], np.searchsorted(own, np.arange(1, len(texts))))
    out, at = [], 0
    for _, members in groups:
        out.append(split[at : at + len(members)])
        at += len(members)
    return out


def spans_of(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by strings at ascending starts."""
    if not len(starts):
        return []
    gap = np.flatnonzero(starts[1:] > starts[:-1] + length)
    return list(zip(starts[np.concatenate([[0], gap + 1])].tolist(), (starts[np.append(gap, len(starts) - 1)] + length).tolist()))


def _with_bytes(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(name, _key, _print, first, bytes) of the wanted records, cut from their texts."""
    lists = wanted.groupBy("_key", "_print").agg(F.collect_list(F.struct("name", "first", "last")).alias("_wanted"))
    lists = lists.withColumnsRenamed({"_key": "_of", "_print": "_of_print"})
    joined = docs.join(lists, _same(docs, lists), "inner").select("_key", "_print", "_text", "_wanted")
    kind = docs.schema["_key"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                rows, names, firsts, parts = [], [], [], []
                for i, (text, wanted) in enumerate(zip(as_bytes(part.column(2)), part.column(3).to_pylist())):
                    for record in wanted:
                        rows.append(i)
                        names.append(record["name"])
                        firsts.append(record["first"])
                        parts.append(text[record["first"] : record["last"] + length])
                which = pa.array(rows, pa.int64())
                columns = [pa.array(names, pa.int64()), part.column(0).take(which), part.column(1).take(which)]
                columns += [pa.array(firsts, pa.int64()), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["name", "_key", "_print", "first", "bytes"])

    return joined.mapInArrow(cut, f"name: bigint, _key: {kind}, _print: bigint, first: bigint, bytes: binary")


def _same(docs: DataFrame, other: DataFrame) -> Column:
    return docs["_key"].eqNullSafe(other["_of"]) & docs["_print"].eqNullSafe(other["_of_print"])


def _sorted_spans(parts: DataFrame, length: int, gram: int) -> DataFrame:
    """(_key, _print, begin, end): what suffix sorting finds among the records of each name."""
    kind = parts.schema["_key"].dataType.simpleString()
    names = ["_key", "_print", "begin", "end"]

    def solved(groups: list[tuple[int, list[tuple]]]) -> Iterator[pa.RecordBatch]:
        rows = []
        found = repeats_in([(name, [m[3] for m in members]) for name, members in groups], length, gram)
        for (_, members), starts in zip(groups, found):
            for (key, mark, first, _), own in zip(members, starts):
                rows += [(key, mark, first + a, first + b) for a, b in spans_of(own, length)]
        columns = [pa.array([r[i] for r in rows]) for i in range(4)]
        types = [key_type[0], pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types)], names)

    key_type: list = [None]

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[tuple[int, list[tuple]]] = []
        size = 0
        for batch in batches:
            key_type[0] = batch.column(1).type
            for name, *member in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if not groups or groups[-1][0] != name:
                    if size >= TOGETHER:
                        yield from solved(groups)
                        groups, size = [], 0
                    groups.append((name, []))
                groups[-1][1].append(tuple(member))
                size += len(member[3]) - length + 1
        if groups:
            yield from solved(groups)

    together = parts.repartition("name").sortWithinPartitions("name")
    return together.mapInArrow(sort, f"_key: {kind}, _print: bigint, begin: bigint, end: bigint")


def _counted_spans(parts: DataFrame, length: int) -> DataFrame:
    """The same for crowded names: strings are rows, counted by their digests."""
    kind = parts.schema["_key"].dataType.simpleString()

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                first, text = batch.column(3)[i].as_py(), batch.column(4)[i].as_py()
                view, count = memoryview(text), len(text) - length + 1
                made = [hashlib.blake2b(view[a : a + length], digest_size=16).digest() for a in range(count)]
                which = pa.array(np.full(count, i))
                columns = [batch.column(1).take(which), batch.column(2).take(which)]
                columns += [pa.array(np.arange(first, first + count)), pa.array(made, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["_key", "_print", "begin", "digest"])

    rows = parts.mapInArrow(strings, f"_key: {kind}, _print: bigint, begin: bigint, digest: binary")
    often = rows.groupBy("digest").count().filter(F.col("count") > 1).select("digest")
    return rows.join(often, "digest").select("_key", "_print", "begin", (F.col("begin") + length).alias("end"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(_key, _print, begin, end): spans of repeated bytes, which may overlap. `docs`: (_key, _print, _text)."""
    spark = docs.sparkSession
    every, stage = kept(records(docs, length, gram), "records")
    # Written, so that Spark measures it and may split what a frequent name brings to the join.
    often, _ = kept(every.groupBy("name").agg(F.count("*").alias("often")).filter("often > 1"), "names")
    shared, _ = kept(every.join(often, "name"), "records")
    dropped(spark, stage)
    spark.sparkContext._jvm.System.gc()  # lets Spark drop the shuffles that `shared` has replaced
    different = shared.groupBy("name", "digest").agg(
        F.count("*").alias("n"), F.first("often").alias("often"), F.min(F.struct("_key", "_print", "first", "last")).alias("one")
    )
    different, _ = kept(different, "different")
    kinds = different.groupBy("name").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    # A name of many copies is dealt to as many tasks, by salt.
    salts = F.when(F.col("often") > FREQUENT, F.lit(SALTS)).otherwise(F.lit(1))
    salted = different.filter("n > 1").select("name", "digest", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    dealt = shared.withColumn("salt", F.pmod(F.xxhash64("_key", "_print"), salts).cast("int"))
    whole = dealt.join(salted, ["name", "digest", "salt"]).select(
        "_key", "_print", F.col("first").alias("begin"), (F.col("last") + length).alias("end")
    )
    wanted, _ = kept(different.join(kinds, "name").select("name", "kinds", "one.*"), "wanted")
    crowded = wanted.filter(F.col("kinds") > crowd)
    parts, _ = kept(_with_bytes(docs, wanted.drop("kinds"), length), "parts")
    spark.sparkContext._jvm.System.gc()
    names = crowded.select("name").distinct()
    compared = _sorted_spans(parts.join(names, "name", "left_anti"), length, gram)
    counted = _counted_spans(parts.join(names, "name", "left_semi"), length)
    spans, _ = kept(compared.unionByName(counted).unionByName(whole), "spans")
    spark.sparkContext._jvm.System.gc()
    return spans


def shared_grams(docs: DataFrame, gram: int = SHARED, reach: int = REACH) -> DataFrame:
    """(_key, _print, n_shared) of the texts with named grams that stand anywhere else. `docs`: (_key, _print, _text)."""
    kind = docs.schema["_key"].dataType.simpleString()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                rows, names = [], []
                for i, text in enumerate(as_bytes(batch.column(2).slice(begin, 512))):
                    if text is not None and len(text) >= reach:
                        names.append(records_of(text, reach, gram)[0])
                        rows.append(np.full(len(names[-1]), begin + i))
                if rows:
                    which = pa.array(np.concatenate(rows))
                    found = pa.array(np.concatenate(names).view(np.int64))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), found], ["_key", "_print", "name"])

    grams, stage = kept(docs.mapInArrow(named, f"_key: {kind}, _print: bigint, name: bigint"), "grams")
    often, _ = kept(grams.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select("name"), "names")
    found, _ = kept(grams.join(often, "name").groupBy("_key", "_print").agg(F.count("*").alias("n_shared")), "shared")
    dropped(docs.sparkSession, stage)
    return found


def deduplicated(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, key: str = "doc_id", text: str = "text",
    with_kept: bool = False,
) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, n_shared[, spans, kept]); spans are byte places, kept the remaining bytes."""
    source = keyed(docs, key, _text=text).select("_key", F.xxhash64("_text").alias("_print"), "_text")
    shared = shared_grams(source)
    spans = repeated_spans(source, length, gram, crowd)
    span_of = F.struct("begin", "end")
    both = spans.select("_key", "_print", span_of.alias("span"), F.lit(0).cast("long").alias("n_shared")).unionByName(
        shared.withColumn("span", F.lit(None).cast("struct<begin: bigint, end: bigint>"))
    )
    lists = both.groupBy("_key", "_print").agg(F.collect_list("span").alias("_spans"), F.max("n_shared").alias("n_shared"))
    lists = lists.withColumnsRenamed({"_key": "_of", "_print": "_of_print"})
    joined = source.join(lists, _same(source, lists), "left").select("_key", "_text", "_spans", "n_shared")
    names = ["_key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared"] + ["spans", "kept"] * with_kept
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, found, n_shared in zip(as_bytes(batch.column(1)), *(batch.column(i).to_pylist() for i in (2, 3))):
                data, runs = data or b"", []
                for begin, end in sorted((s["begin"], s["end"]) for s in found or []):
                    if runs and begin <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], end)
                    else:
                        runs.append([begin, end])
                edges = [0, *(x for run in runs for x in run), len(data)]
                left = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])) if runs else data
                row = (len(data), len(data) - len(left), len(runs), hashlib.sha256(left).hexdigest(), n_shared or 0)
                rows.append(row + ([{"begin": a, "end": b} for a, b in runs], left) * with_kept)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()] + [pa.list_(span), pa.binary()] * with_kept
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    kind = source.schema["_key"].dataType.simpleString()
    schema = f"_key: {kind}, n_bytes: bigint, n_removed: bigint, n_spans: bigint, kept_sha256: string, n_shared: bigint"
    schema += ", spans: array<struct<begin: bigint, end: bigint>>, kept: binary" * with_kept
    return joined.mapInArrow(cut, schema).withColumnRenamed("_key", key)
