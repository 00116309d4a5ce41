"""Operators over several fact tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronicle.functions import calendar, stats
from chronicle.operators import money, plays
from chronicle.params import Params

STREAM_NAMES = {"media_plays": "plays"}
BUCKET_LENGTH = {
    "day": "INTERVAL '1' DAY",
    "week": "INTERVAL '7' DAY",
    "month": "INTERVAL '1' MONTH",
    "year": "INTERVAL '1' YEAR",
}


def daily_activity(facts: dict[str, DataFrame], params: Params) -> DataFrame:
    """(day, stream, activity): each table is counted per local day before the union."""
    parts = []
    for table, df in facts.items():
        if table == "events":
            stream = F.split_part("kind", F.lit("."), F.lit(1))
        else:
            stream = F.lit(STREAM_NAMES.get(table, table))
        rows = calendar.in_range(calendar.with_local(df, params), params)
        parts.append(
            rows.groupBy(F.col("local_ts").cast("date").alias("day"), stream.alias("stream")).agg(
                F.count("*").alias("activity")
            )
        )
    return reduce(DataFrame.unionByName, parts)


def life_timeline(facts: dict[str, DataFrame], params: Params) -> DataFrame:
    """Activity per bucket and stream, against the stream's own maximum, with the busiest day."""
    days = daily_activity(facts, params)
    busiest = (
        days.groupBy(F.col("day").alias("busiest_day"))
        .agg(F.sum("activity").alias("busiest_activity"))
        .orderBy(F.desc("busiest_activity"), "busiest_day")
        .limit(1)
    )
    bucket = F.col("day") if params.granularity == "day" else F.trunc("day", params.granularity)
    buckets = days.groupBy(bucket.alias("bucket"), "stream").agg(F.sum("activity").alias("activity"))
    by_stream = Window.partitionBy("stream")
    end = F.col("bucket") + F.expr(BUCKET_LENGTH[params.granularity])
    return (
        buckets.crossJoin(F.broadcast(busiest))
        .withColumns(
            {
                "activity_pct": F.lit(100.0) * F.col("activity") / F.max("activity").over(by_stream),
                "bucket_end": end.cast("date"),
            }
        )
        .orderBy("bucket", "stream")
    )


def weekly(df: DataFrame, value: Column, name: str) -> DataFrame:
    week = calendar.bucket(F.col("local_ts"), "week").alias("week")
    return df.groupBy(week).agg(value.cast("double").alias(name))


def weekly_correlation(x: DataFrame, y: DataFrame, x_name: str, y_name: str) -> DataFrame:
    """Pair two weekly series over all observed weeks; missing weeks are zero.

    Both sides have one row per week. The result is empty unless both have rows.
    """
    both = x.agg(F.count("*").alias("_x")).crossJoin(y.agg(F.count("*").alias("_y")))
    both = both.filter("_x > 0 AND _y > 0").select(F.lit(1).alias("_both"))
    paired = (
        x.join(y, "week", "full_outer")
        .crossJoin(F.broadcast(both))
        .select(
            "week",
            F.coalesce(x_name, F.lit(0.0)).alias(x_name),
            F.coalesce(y_name, F.lit(0.0)).alias(y_name),
        )
    )
    summary = paired.agg(stats.pearson(x_name, y_name).alias("r"), F.count("*").alias("n_weeks"))
    return paired.crossJoin(F.broadcast(summary)).orderBy("week")


def spend_vs_listening(
    transactions: DataFrame, media_plays: DataFrame, params: Params
) -> DataFrame:
    spending = weekly(money.selection(transactions, params), F.sum(money.spend()), "spend")
    listening = weekly(
        plays.selection(media_plays, params), plays.minutes(F.sum("ms_played")), "minutes"
    )
    return weekly_correlation(spending, listening, "spend", "minutes")


def messages_vs_watches(
    messages: DataFrame, events: DataFrame, params: Params, watch_kind: str = "youtube.watch"
) -> DataFrame:
    sent = messages.filter(F.col("is_from_me") & (F.col("kind") != "system"))
    watched = events.filter(F.col("kind") == watch_kind)
    return weekly_correlation(
        weekly(_local(sent, params), F.count("*"), "messages"),
        weekly(_local(watched, params), F.count("*"), "youtube_watches"),
        "messages",
        "youtube_watches",
    )


def _local(df: DataFrame, params: Params) -> DataFrame:
    return calendar.in_range(calendar.with_local(df, params), params)


# ---- calendar coverage ------------------------------------------------------------------------


def available_years(facts: dict[str, DataFrame], tz: str = "UTC") -> DataFrame:
    """Local years with any rows, newest first."""
    parts = [
        df.select(F.year(calendar.local_time(F.col("ts"), tz)).cast("bigint").alias("year")).distinct()
        for df in facts.values()
    ]
    return reduce(DataFrame.unionByName, parts).distinct().orderBy(F.desc("year"))


def coverage(facts: dict[str, DataFrame], tz: str = "UTC") -> DataFrame:
    """First and last local day over all facts, and the last year that is complete."""
    parts = [df.agg(F.min("ts").alias("first"), F.max("ts").alias("last")) for df in facts.values()]
    spans = reduce(DataFrame.unionByName, parts).agg(
        calendar.local_time(F.min("first"), tz).cast("date").alias("first_day"),
        calendar.local_time(F.max("last"), tz).cast("date").alias("last_day"),
    )
    full = (F.month("last_day") == 12) & (F.day("last_day") == 31)
    year = F.year("last_day") - F.when(full, 0).otherwise(1)
    return spans.filter("last_day IS NOT NULL").withColumn("last_full_year", year.cast("bigint"))
