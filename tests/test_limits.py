"""Nothing is cut or mixed up at a size: long words, many lines, many braces, other scripts."""

from pyspark.sql import functions as F

from chronicle.functions import stats, text
from chronicle.operators import money
from chronicle.params import Params
from chronicle.plans import exports
from chronicle.sources import chat

LONG = "q" * ((1 << 20) + 10)


def test_long_words_stay_whole(spark):
    df = spark.createDataFrame([(LONG,)], "s string")
    assert df.select(text.normalise_merchant(F.col("s"))).first()[0] == "Q" + LONG[1:]
    spent = spark.createDataFrame(
        [("a", "2024-01-05 10:00:00", "-5.00", "EUR", LONG + "_x", "card")], "id string, t string, a string, currency string, category string, kind string"
    ).select(
        "id", "currency", "category", "kind", F.to_timestamp("t").alias("ts"), F.col("a").cast("decimal(18,2)").alias("amount"),
        F.lit(None).cast("string").alias("merchant"), F.lit(None).cast("string").alias("merchant_raw"),
    )
    assert money.top_categories_with_other(spent, Params()).first()["category"] == "Q" + LONG[1:] + " x"


def test_positions_of_long_texts_do_not_overlap(spark):
    df = spark.createDataFrame([(n, "\n".join(f"{n}-{i}" for i in range(1500))) for n in range(5)], "n long, t string")
    lines = exports._lines(df, F.lit("f"), F.col("n"), F.col("t")).orderBy("block", "pos").collect()
    assert [r["line"] for r in lines] == [f"{n}-{i}" for n in range(5) for i in range(1500)]
    assert [r["pos"] for r in lines] == list(range(7500))
    objects = spark.createDataFrame([(n, '{"a": ' + "{}" * 40 + "}") for n in range(4)], "n long, t string")
    pieces = exports._objects(objects, F.lit("f"), F.col("n"), F.col("t"), "[").orderBy("pos").collect()
    assert len(pieces) == 4 * 41 and [r["pos"] for r in pieces] == list(range(4 * 41))


def test_urls_end_at_any_white_space(spark):
    df = spark.createDataFrame([("see https://x.y/a\u00a0hello WWW.z.q\u3000there",)], "s string")
    assert df.select(text.strip_urls(F.col("s"))).first()[0] == "see \u00a0hello \u3000there"


def test_notices_in_capitals(spark):
    df = spark.createDataFrame([("A ADĂUGAT pe cineva",), ("CREÓ EL GRUPO",), ("nimic",)], "s string")
    assert [r[0] for r in df.select(F.col("s").rlike(chat.GROUP_NOTICE)).collect()] == [True, True, False]


def test_first_rows_need_no_hint(spark):
    top = stats.largest(spark.range(50), 3, F.desc("id"))
    assert [r[0] for r in top.collect()] == [49, 48, 47]
