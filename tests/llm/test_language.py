import random

import pytest
from pyspark.sql import functions as F

from chronicle.llm import language
from chronicle.llm.language import PIECE, UNKNOWN, Parser, identify, learned, sample_of


def greedy(text, sample):
    """Phrases of a text that is parsed by longest matches with the sample; an unknown letter ends one and leads the next."""
    phrases, start = 1 if text else 0, 0
    for i in range(len(text)):
        if text[start : i + 1] not in sample:
            phrases, start = phrases + 1, i if text[i] in sample else i + 1
    return phrases


def test_phrases_are_longest_matches(monkeypatch):
    rng = random.Random(3)
    sample = "".join(rng.choice("abc") for _ in range(300))
    others = "".join(rng.choice("abd") for _ in range(900))
    parser = Parser(learned((("x", (sample,)), ("y", (others,)))))
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, PIECE))) for _ in range(200)]
    # Far more than one piece: the parse goes on from piece to piece.
    texts += ["".join(rng.choice("abc") for _ in range(PIECE * 20 + 7)), others * 3, (sample * 5)[11:], "abcabd" * 2000, ""]
    symbols, at = parser.alphabet.normalised(texts)
    expected = [[greedy(t, sample), greedy(t, others)] for t in texts]
    assert parser.phrases(symbols, at).tolist() == expected
    monkeypatch.setattr(language, "BATCH", PIECE * 2 + 3)
    assert parser.phrases(symbols, at).tolist() == expected


def test_every_label_and_letter_is_learned():
    names = [f"l{i:03}" for i in range(90)]
    # Each language has letters of its own from a large script; the sample holds 2,700 letters.
    sample = tuple((n, (" ".join(chr(0x4E00 + 30 * i + (7 * j) % 30) + chr(0x4E00 + 30 * i + (11 * j) % 30) for j in range(60)),)) for i, n in enumerate(names))
    parser = Parser(learned(sample))
    assert [p for p, _ in parser.predict([texts[0] for _, texts in sample])] == names


def test_whole_texts_count(spark):
    parser = Parser(learned((("en", ("the cat sat on the mat " * 20,)), ("xx", ("zq wv kj pf " * 20,)))))
    late = "zq wv " * 5 + "the cat sat on the mat " * 4000
    assert parser.predict([late])[0][0] == "en"
    assert parser.predict(["THE CAT", "zq wv", None, "", " 12 ?!", "日本"])[:5] == [
        parser.predict(["the cat"])[0],
        parser.predict(["zq wv"])[0],
        (UNKNOWN, 0.0),
        (UNKNOWN, 0.0),
        (UNKNOWN, 0.0),
    ]
    assert parser.predict(["日本"])[0][0] in ("en", "xx")


def test_learns_only_from_labelled_rows_and_predicts_all(spark):
    rows = [(i, "the house and the garden are here", "en", "s", 1) for i in range(40)]
    rows += [(100 + i, "das Haus und der Garten sind hier", "de", "s", 1) for i in range(40)]
    rows += [(200, None, "en", None, None), (None, "der Garten", None, None, None), (201, "", "de", "s", 0), (3, "the", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score int")
    out = {(r["doc_id"], r["lang_pred"]) for r in language.digest(docs).collect()}
    assert (1, "en") in out and (101, "de") in out and (200, UNKNOWN) in out and (None, "de") in out and (201, UNKNOWN) in out
    assert language.digest(docs).count() == len(rows)
    assert all(0 <= r["score"] <= 1 for r in language.digest(docs).collect())
    kept = language.with_language(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 2
    empty = docs.limit(0)
    assert language.digest(empty).count() == 0 and language.with_language(empty).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.digest(unlabelled).collect()} == {UNKNOWN}


def test_rows_without_a_key_share_one_draw(spark):
    rows = [(None, f"der Garten Nummer {i}", "de") for i in range(900)] + [(i, "the house is here", "en") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = dict(sample_of(docs, rows=5))
    assert len(found["en"]) == 5 and len(found.get("de", ())) in (0, 5)


def test_sample_is_bounded(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("abc def "), 500).alias("text"), F.lit("en").alias("lang")
    )
    ((name, texts),) = sample_of(docs, rows=5, width=100)
    assert name == "en" and len(texts) == 5 and all(len(t) == 100 for t in texts)
    assert identify(docs.limit(2), sample_of(docs)).count() == 2


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = language.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
