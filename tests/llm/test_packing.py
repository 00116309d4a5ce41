import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from chronicle.llm.packing import LENGTH, Capacities, best_fit, pack
from chronicle.llm.tokens import default_path


def plain_pieces(rows, length=LENGTH):
    tokenizer = Tokenizer.from_file(default_path())
    out = []
    for key, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % length or min(length, len(ids))
        cuts = [0, *range(first, len(ids), length), len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out.append((key, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return sorted(out, key=repr)


def check(df, length=LENGTH, **options):
    rows = df.select("doc_id", "text").collect()
    packed = pack(df, length=length, **options).collect()
    assert sorted((tuple(r)[:5] for r in packed), key=repr) == plain_pieces([tuple(r) for r in rows], length)
    bins = defaultdict(list)
    for r in packed:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return len(bins), sum(r["length"] for r in packed)


def test_documents(spark):
    bins, total = check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert bins <= 1.03 * total / LENGTH + 1


def test_odd_rows_and_many_groups(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "a b", 5), (3, "word " * 9000, 5), (3, "word " * 9000, 5), (4, "x" * 31, 5), (4, "<|endoftext|>  \n é", 5)]
    rows += [(10 + i, "tail " * (i % 40), 5) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    check(df, 32, group=30)
    check(df, 32)
    assert pack(df.limit(0)).count() == 0
    assert "ids" in pack(df, with_ids=True).columns


def test_tightest_open_sequence():
    rng = random.Random(7)
    tree, rooms = Capacities(50), {}
    for step in range(3000):
        size = rng.randint(1, 50)
        if rng.random() < 0.5:
            tree.add(size, step)
            rooms[step] = size
        else:
            fit = min((room for room in rooms.values() if room >= size), default=None)
            found = tree.tightest(size)
            assert (found is None) == (fit is None)
            if found:
                assert found[0] == fit == rooms.pop(found[1])


def test_best_fit_fills_exactly():
    sequences, offsets = best_fit([6, 5, 5, 4, 4, 3, 2, 1], 10)
    assert len(set(sequences)) == 3
    assert sorted(zip(sequences, offsets))[0] == (0, 0)
