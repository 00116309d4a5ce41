"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items scans each text once.

A-Z are lower-cased and words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`: digits, a-z and everything beyond ASCII. A window
is `size` consecutive words of an item; an item of fewer words, but not none, is one window. Every word of a document inside
any occurrence of a window is hit. Texts are normalised byte by byte without changing their length, so that a word's place
in the normalised text is its place in the original one.

Defined results: a null or wordless text has no words and no hits; an item with null text or no words has no window; items
with a null id mark words but are neither listed nor counted; repeated items and repeated documents are judged like any
others; an empty benchmark hits nothing. Only the key and text columns are read, so other columns cannot clash.

The benchmark, not the corpus, is broadcast, and its size is checked: above `AUTOMATON_BYTES` of text it is dealt by hash
into parts that each fit, every part scans the texts in a pass of its own, and the hit runs of a document are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronicle.llm.frames import as_bytes, keyed

SIZE = 10
AUTOMATON_BYTES = 256 << 10  # of item text; the automaton takes some hundred times as much memory

_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)
_SCHEMA = "n_words long, runs array<struct<first: int, last: int, begin: int, end: int>>, item_ids array<string>"
_RUN = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("begin", pa.int32()), ("end", pa.int32())])


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def windows_of(text: bytes | None, size: int) -> set[bytes]:
    words = words_of(text)
    count = max(1, len(words) - size + 1) if words else 0
    return {b" ".join(words[i : i + size]) for i in range(count)}


def automaton(items: list[tuple[str | None, bytes | None]], size: int):
    """All windows of the items, each with its number of words and the ids that have it; None without windows."""
    owners: dict[bytes, set[str]] = {}
    for item, text in items:
        for window in windows_of(text, size):
            owners.setdefault(window, set()).update([] if item is None else [item])
    made = ahocorasick.Automaton()
    for window, ids in owners.items():
        spaced = f" {window.decode('latin-1')} "
        made.add_word(spaced, (len(spaced), window.count(b" ") + 1, tuple(ids)))
    if not owners:
        return None
    made.make_automaton()
    return made


def scan(text: bytes | None, found) -> tuple[int, list[dict], list[str]]:
    """(number of words, runs of hit words with their byte places in the text, ids of the items that occur)."""
    folded = (text or b"").translate(_FOLD)
    words = folded.split()
    if not words or found is None:
        return len(words), [], []
    plain = " " + b" ".join(words).decode("latin-1") + " "
    hits = list(found.iter(plain))
    if not hits:
        return len(words), [], []
    gaps = np.flatnonzero(np.frombuffer(plain.encode("latin-1"), np.uint8) == 0x20)
    edge = np.zeros(len(words) + 1, np.int64)
    ids: set[str] = set()
    for last, (length, count, owners) in hits:
        first = int(np.searchsorted(gaps, last - length + 1))
        edge[first] += 1
        edge[first + count] -= 1
        ids.update(owners)
    hit = np.concatenate([[0], (np.cumsum(edge)[:-1] > 0).astype(np.int8), [0]])
    turns = np.diff(hit)
    blank = np.concatenate([[True], np.frombuffer(folded, np.uint8) == 0x20, [True]])
    begins, ends = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
    runs = [
        {"first": int(a), "last": int(b), "begin": int(begins[a]), "end": int(ends[b])}
        for a, b in zip(np.flatnonzero(turns == 1), np.flatnonzero(turns == -1) - 1)
    ]
    return len(words), runs, sorted(ids)


def _pass(docs: DataFrame, items: list[tuple[str | None, bytes | None]], size: int) -> DataFrame:
    """One scan of all texts with the automaton of these items."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(shared.value, size)
        for batch in batches:
            rows = [scan(text, found) for text in as_bytes(batch.column(1))]
            columns = [
                batch.column(0),
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.list_(_RUN)),
                pa.array([r[2] for r in rows], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["_key", "n_words", "runs", "item_ids"])

    kind = docs.schema["_key"].dataType.simpleString()
    return docs.mapInArrow(scanned, f"_key {kind}, {_SCHEMA}")


def _merged(hits: DataFrame) -> DataFrame:
    """Rows of several passes, one for each document: its runs united, its items together."""
    runs = F.array_sort(F.flatten(F.collect_list("runs")))
    # Runs in the order of their starts: a run that begins inside or right after the last one lengthens it.
    united = F.aggregate(
        runs,
        F.array().cast("array<struct<first: int, last: int, begin: int, end: int>>"),
        lambda done, run: F.when(
            (F.size(done) > 0) & (run["first"] <= F.element_at(done, -1)["last"] + 1),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["first"].alias("first"),
                        F.greatest(F.element_at(done, -1)["last"], run["last"]).alias("last"),
                        F.element_at(done, -1)["begin"].alias("begin"),
                        F.greatest(F.element_at(done, -1)["end"], run["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(run))),
    )
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids"))))
    return hits.groupBy("_row").agg(
        F.first("_key").alias("_key"),
        F.first("n_words").alias("n_words"),
        united.alias("runs"),
        items.alias("item_ids"),
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    size: int = SIZE,
    automaton_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """(key, n_words, n_hit, runs, item_ids) for each document; runs hold word numbers and byte places of hit passages."""
    items = benchmark.select(F.col(item_key).cast("string").alias("item"), F.col(item_text).alias("words"))
    total = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    parts = max(1, math.ceil(total / automaton_bytes))
    source = keyed(docs, key, _text=text)

    def part(number: int) -> list[tuple[str | None, bytes | None]]:
        rows = items.filter(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == number) if parts > 1 else items
        return [(r[0], None if r[1] is None else r[1].encode()) for r in rows.collect()]

    if parts == 1:
        hits = _pass(source, part(0), size)
    else:
        # A row's own number keeps repeated keys apart; passes read the same rows.
        from chronicle.llm.frames import kept

        numbered, _ = kept(source.select(F.struct("_key", F.expr("uuid()").alias("_row")).alias("_key"), "_text"))
        passes = [_pass(numbered, part(i), size) for i in range(parts)]
        every = passes[0]
        for other in passes[1:]:
            every = every.unionByName(other)
        hits = _merged(every.withColumns({"_row": F.col("_key._row"), "_key": F.col("_key._key")})).drop("_row")
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, run: n + run["last"] - run["first"] + 1)
    return hits.select(F.col("_key").alias(key), "n_words", n_hit.alias("n_hit"), "runs", "item_ids")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The registered query's columns."""
    return contamination(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents no word of which lies in a benchmark window, with all their columns; rows with equal keys go together."""
    hit = contamination(docs, benchmark).filter("n_hit > 0").select(F.col("doc_id").alias("_hit")).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["_hit"]), "left_anti")
