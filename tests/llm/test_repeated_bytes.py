import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from chronicle.llm import repeated_bytes
from chronicle.llm.repeated_bytes import Suffixes, deduplicated, sliding_least


def brute(rows, length):
    count = Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = []
    for key, text in rows:
        gone = bytearray(len(text))
        for i in range(len(text) - length + 1):
            if count[text[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        left = bytes(b for b, g in zip(text, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((key, len(text), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def check(df, length, gram, **options):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in df.collect()]
    got = sorted((tuple(r)[:5] for r in deduplicated(df, length, gram, **options).collect()), key=repr)
    assert got == brute(rows, length)
    return got


@pytest.mark.parametrize("crowd", [4096, 2])
def test_matches_brute_force(spark, crowd):
    rng = random.Random(5)
    rows = [
        (i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) + "xyz" * rng.randint(0, 40) + "q" * rng.randint(0, 60))
        for i in range(60)
    ]
    rows += [(100, None), (101, ""), (102, rows[3][1]), (102, rows[3][1]), (None, rows[4][1]), (103, "é" * 40 + rows[5][1])]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_bytes int")
    assert any(r[2] for r in check(df, 12, 5, crowd=crowd))
    assert deduplicated(df.limit(0), 12, 5).count() == 0


def test_frequent_names_are_salted(spark, monkeypatch):
    monkeypatch.setattr(repeated_bytes, "FREQUENT", 2)
    rows = [(i, "common words before " + "abcdefgh" * 6 + str(i % 3)) for i in range(40)] + [(99, "nothing like it")]
    check(spark.createDataFrame(rows, "doc_id long, text string"), 12, 5)


def test_documents(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), 400, 200)


def test_kept_bytes_and_spans(spark):
    shared = "0123456789abcdefghij" * 30
    df = spark.createDataFrame([(1, "A" + shared + "B"), (2, "C" + shared + "D"), (3, "short")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in deduplicated(df, with_kept=True).collect()}
    assert rows[1]["kept"] == b"AB" and rows[2]["kept"] == b"CD" and rows[3]["kept"] == b"short"
    assert [tuple(s) for s in rows[1]["spans"]] == [(1, 601)] and rows[3]["spans"] == []


def test_shorter_passages_are_told(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    rng = random.Random(9)
    own = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = own(260)
    extra = [(9001, own(300) + passage + own(90)), (9002, passage + own(500)), (9003, own(900)), (9004, passage[:140] + own(400)), (9005, None), (9006, "")]
    texts |= {k: (t or "").encode() for k, t in extra}
    more = spark.createDataFrame(extra, "doc_id long, text string")
    found = {r["doc_id"]: r for r in deduplicated(docs.select("doc_id", "text").unionByName(more)).collect()}
    count = {n: Counter(h for t in texts.values() for i in range(len(t) - n + 1) for h in [t[i : i + n]]) for n in (150, 250)}
    sharing = {n: {k for k, t in texts.items() if any(c[t[i : i + n]] > 1 for i in range(len(t) - n + 1))} for n, c in count.items()}
    told = {k for k, r in found.items() if r["n_shared"] > 0}
    assert sharing[250] <= told <= sharing[150] and {9001, 9002} <= told and not {9003, 9004, 9005, 9006} & told


def test_merge_sort_orders_suffixes():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    starts = rng.permutation(2900)[:700]
    classes = starts % 5
    order, labels = Suffixes(data, 60).sort(starts, classes)
    want = sorted(zip(classes.tolist(), starts.tolist()), key=lambda p: (p[0], data[p[1] : p[1] + 60].tobytes()))
    assert labels.tolist() == [c for c, _ in want]
    assert [data[s : s + 60].tobytes() for s in order] == [data[s : s + 60].tobytes() for _, s in want]


def test_colliding_hashes_are_verified():
    data = np.frombuffer(b"abcdefgh" * 2 + b"ijklmnop", np.uint8)
    sorter = Suffixes(data, 8)
    sorter.hashes.at = lambda begin, length: np.zeros(len(begin), np.uint64)  # everything collides
    assert sorted(sorter.repeated(np.array([0, 8, 16]), np.zeros(3, np.int64)).tolist()) == [0, 8]


def test_sliding_least():
    values = np.random.default_rng(1).integers(0, 50, 200).astype(np.uint64)
    for width in (1, 7, 200, 201):
        assert sliding_least(values, width).tolist() == [min(values[i : i + width]) for i in range(len(values) - width + 1)]
