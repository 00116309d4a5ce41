"""Physical plans: what reaches the scan, and that no task gets a whole key or table."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from chronicle import Params
from chronicle.functions import ordered, stats
from chronicle.operators import messages, money, plays

RANGE = Params(date_from=date(2024, 1, 10), date_to=date(2024, 1, 20), tz="Europe/Bucharest")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A canonical messages table, stored by month; chat A holds a third of all rows."""
    rows = spark.range(3000).select(
        F.col("id").cast("string").alias("id"), F.lit("s").alias("source"),
        F.when(F.col("id") % 3 == 0, "A").otherwise(F.concat(F.lit("c"), (F.col("id") % 400).cast("string"))).alias("chat_id"),
        F.lit("direct").alias("chat_kind"), F.lit(None).cast("string").alias("contact_id"),
        (F.col("id") % 7 < 3).alias("is_from_me"), F.lit("text").alias("kind"), F.lit("some text").alias("text"),
        F.timestamp_seconds(F.lit(1703000000) + F.col("id") * 1777).alias("ts"),
    ).withColumn("chat_name", F.col("chat_id")).withColumn("month", F.date_format("ts", "yyyy-MM"))
    path = str(tmp_path_factory.mktemp("facts") / "messages")
    rows.write.partitionBy("month").parquet(path)
    return spark.read.parquet(path)


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "5000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_local_range_reaches_the_scan(stored):
    text = plan(messages.selection(stored, RANGE))
    pushed = re.search(r"PushedFilters: (.*?) ReadSchema|PushedFilters: (.*)", text).group(0)
    assert "GreaterThanOrEqual(ts,2024-01-09" in pushed and "LessThan(ts,2024-01-22" in pushed


def test_only_needed_columns_are_read(stored):
    schema = re.findall(r"ReadSchema: struct<(.*?)>", plan(messages.activity_heatmap(stored, RANGE)))[0]
    assert set(re.findall(r"(\w+):", schema)) == {"is_from_me", "ts", "kind"}


def test_top_n_is_pushed(stored):
    assert "TakeOrderedAndProject" in plan(messages.streaks_silences(stored, RANGE))
    assert "WindowGroupLimit" in plan(messages.top_contacts_by_year(stored, RANGE))


def test_no_window_over_a_whole_table(stored):
    for df in (messages.replies(stored, RANGE), messages.conversation_starters(stored, RANGE), messages.response_times(stored, RANGE)):
        assert "windowspecdefinition(unspecified" not in plan(df).lower()
        assert not re.search(r"Exchange SinglePartition[^\n]*\n[^\n]*Window", plan(df))


def test_lag_sorts_segments_and_not_whole_chats(stored):
    """The window over messages is partitioned by chat and hour; only one row per hour is per chat."""
    text = plan(messages.replies(stored, RANGE))
    assert re.search(r"Window \[.*?lag\(ts.*?\], \[source#\d+, chat_id#\d+, _hour#\d+\]", text)


def test_segmented_values_equal_plain_windows(spark, stored):
    rows = stored.withColumn("hour", F.date_trunc("hour", "ts"))
    stored.createOrReplaceTempView("stored")
    expected = {
        r["id"]: (r["p"], r["t"])
        for r in spark.sql(
            "SELECT id, lag(id) OVER w p, sum(cast(is_from_me as int)) OVER w t FROM stored WINDOW w AS (PARTITION BY chat_id ORDER BY ts, id)"
        ).collect()
    }
    before = ordered.previous_values(rows, ["chat_id"], "hour", ["ts", "id"], {"id": "p"})
    total = ordered.running_total(before, ["chat_id"], "hour", ["ts", "id"], F.col("is_from_me").cast("int"), "t")
    assert {r["id"]: (r["p"], r["t"]) for r in total.collect()} == expected


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_exact_median_equals_sorted_median(spark, width):
    import random
    from statistics import median

    rng = random.Random(3)
    data = {f"k{i}": [rng.randrange(300) for _ in range(n)] for i, n in enumerate([1, 2, 3, 10, 501])}
    rows = [(k, v, 1) for k, values in data.items() for v in values]
    counts = spark.createDataFrame(rows, "k string, v bigint, w bigint").groupBy("k", "v").agg(F.sum("w").alias("w"))
    found = {r["k"]: (r["median"], r["n"]) for r in stats.exact_median(counts, ["k"], "v", "w", width).collect()}
    assert found == {k: (float(median(v)), len(v)) for k, v in data.items()}
    whole = stats.exact_median(counts, [], "v", "w", width).first()
    every = [v for values in data.values() for v in values]
    assert (whole["median"], whole["n"]) == (float(median(every)), len(every))


def test_recurring_charges_order_days_not_rows(spark):
    df = spark.range(10).selectExpr(
        "cast(id as string) id", "'s' source", "timestamp_seconds(id * 2592000) ts", "cast(-5 as decimal(18,2)) amount",
        "'EUR' currency", "concat('M', id % 2) merchant", "'m' merchant_raw", "'c' category", "'card' kind")
    text = plan(money.day_gaps(money.charges(df, Params(currency="EUR"))))
    first = text.rindex("lag(day")
    assert "HashAggregate(keys=[merchant" in text[first:]


def test_plays_are_counted_before_the_join(spark):
    df = spark.range(10).selectExpr("timestamp_seconds(id) ts", "'track' media_kind", "'a' artist", "'t' track", "id ms_played", "true skipped")
    text = plan(plays.discovery_rate(df, Params()))
    join = text.index("Join")
    assert text[join:].count("HashAggregate") >= 4


@pytest.mark.parametrize("limit", ["10485760", "-1"])
def test_file_facts_do_not_gather_a_file(spark, limit):
    """One salted plan; Spark broadcasts the facts where its own limit allows. Rows of one file stay spread either way."""
    from chronicle.functions import joins

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    rows = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 7)).alias("path"),
        F.expr("id div 10").alias("block"), "id")
    facts = rows.select("path").distinct().withColumn("fact", F.concat(F.lit("f-"), "path"))
    joined = joins.join_facts(rows, facts, "path")
    assert joined.count() == 1000 and joined.filter("fact <> concat('f-', path)").isEmpty()
    assert joins.join_facts(rows, facts.filter("path = 'hot'"), "path", "left").filter("fact IS NULL").count() == 666
    assert joins.join_facts(rows, facts.filter("path = 'hot'").select("path"), "path", "left_semi").count() == 334
    text = plan(joined)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert "_salt" in text and ("BroadcastExchange" in text) == (limit != "-1")
