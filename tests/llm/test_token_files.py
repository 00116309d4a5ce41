import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from chronicle.llm import rans, token_files, tokens
from chronicle.llm.frames import folder


def test_blocks_round_trip_and_are_checked():
    rng = np.random.default_rng(0)
    weights = rng.dirichlet(np.full(5000, 0.05))
    blocks = [rng.choice(5000, n, p=weights).astype(np.uint16) for n in (1, 63, 64, 65, 5000, 8192, 8193, 70_000)]
    table = rans.Table.of_counts(np.bincount(np.concatenate(blocks), minlength=5000))
    coded = rans.encode(blocks, table)
    assert all((a == b).all() for a, b in zip(rans.decode(coded, table), blocks))
    assert len(coded[-1]) < 2 * len(blocks[-1])
    broken = bytearray(coded[4])
    broken[300] ^= 1
    with pytest.raises(ValueError):
        rans.decode([bytes(broken)], table)
    assert rans.encode([], table) == [] and rans.decode([], table) == []


def test_frequencies_add_up():
    rng = np.random.default_rng(1)
    for counts in (np.array([0, 7]), rng.integers(0, 3, 60_000), np.array([10**12, *[1] * 50_000]), np.zeros(3, int)):
        scaled = rans.scaled(counts)
        assert scaled.sum() == (1 << rans.SCALE if counts.any() else 0) and ((scaled > 0) == (counts > 0)).all()


ODD = [
    "", "  a  b", "a \n b", "\n\n x\n", "don't stop's  'll", "x\x1cy \x1c z", "日本語 テキスト。 12 3a", "tab\t x \tb", " lead", "trail ",
    "<|endoftext|> a  <|endoftext|>b <|endoftext|>", "é è. ", "a\r\nb", "1.5 .5. ...a a... -- a_b", "²³ x² Ⅷ", "word.\n\nword",
    "a\u3000 b\n\u2028c", "\u200b x \u200b", "a\x85b \x85", "𝒳 𝒴.", "ʼs 's's", "a\u00a0\n b\u00a0 c",
]


def test_ids_equal_those_of_whole_texts():
    rng = random.Random(1)
    letters = list(" \n\t.,'ab1é\u00a0\x1cL²日—…") + ["'s"]
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    table = tokens.tokens(tokens.default_path())
    ids, at = table.encode([t.encode() for t in texts])
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == table.tokenizer.encode(text, add_special_tokens=False).ids


def brute(rows):
    tokenizer, start, out = Tokenizer.from_file(tokens.default_path()), 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_of_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    got = sorted(map(tuple, token_files.digest(df).collect()))
    assert got == brute([(r["doc_id"], r["text"]) for r in df.collect()])


def test_odd_rows_and_ids(spark):
    rows = [(i, t, 1) for i, t in enumerate(ODD)] + [(None, "unnamed", 2), (900, None, 2), (901, "word " * 200_000, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    place = folder(spark, "tokens")
    token_files.write(df, place)
    found = token_files.read(spark, place, with_ids=True).collect()
    assert sorted((tuple(r)[:4] for r in found), key=repr) == sorted(brute([r[:2] for r in rows]), key=repr)
    assert all(len(r["ids"]) == r["n_tokens"] and r["ids"][-1] == 2 for r in found)
    assert token_files.digest(df.limit(0)).count() == 0
    twice = token_files.digest(df.unionAll(df)).collect()
    assert len(twice) == 2 * len(rows) and len({r["start"] for r in twice}) == len(twice)
