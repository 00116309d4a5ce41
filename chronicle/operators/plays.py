"""Listening analytics over the `media_plays` fact table."""

from __future__ import annotations

from dataclasses import replace
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronicle.functions import calendar, stats
from chronicle.params import Params

SEASONS = {"winter": (12, 1, 2), "summer": (6, 7, 8)}
OBSESSION = 30


def minutes(ms: Column) -> Column:
    return ms.cast("double") / F.lit(60000.0)


def history(plays: DataFrame, params: Params) -> DataFrame:
    """Tracks and episodes of all time, with local time and labels."""
    rows = plays.filter(F.col("media_kind").isin("track", "episode"))
    return calendar.with_local(rows, params).withColumns(
        {
            "artist_label": F.coalesce("artist", F.lit("Unknown")),
            "track_label": F.coalesce("track", F.lit("Unknown")),
        }
    )


def selection(plays: DataFrame, params: Params) -> DataFrame:
    return calendar.in_range(history(plays, params), params)


def _bucket(params: Params | str) -> Column:
    granularity = params if isinstance(params, str) else params.granularity
    return calendar.bucket(F.col("local_ts"), granularity)


def listening_minutes(plays: DataFrame, params: Params) -> DataFrame:
    return (
        selection(plays, params)
        .groupBy(_bucket(params).alias("bucket"))
        .agg(minutes(F.sum("ms_played")).alias("minutes"))
        .orderBy("bucket")
    )


def listening_headline(plays: DataFrame, params: Params) -> DataFrame:
    total = selection(plays, params).agg(F.sum("ms_played").alias("ms")).filter("ms IS NOT NULL")
    return total.select(
        F.lit("Listening time").alias("label"),
        F.round(minutes(F.col("ms")) / 60, 1).alias("value"),
        F.lit("hours").alias("unit"),
    )


def top_artists_by_year(plays: DataFrame, params: Params) -> DataFrame:
    """The first min(top_n, 5) artists of each local year, with that year's first tracks.

    Tracks are counted once; artists are summed from those counts.
    """
    limit = min(params.top_n, 5)
    tracks = (
        selection(plays, params)
        .filter(F.col("media_kind") == "track")
        .groupBy(
            F.year("local_ts").cast("bigint").alias("year"),
            F.col("artist_label").alias("artist"),
            F.col("track_label").alias("track"),
        )
        .agg(F.sum("ms_played").alias("ms"))
    )
    artists = tracks.groupBy("year", "artist").agg(F.sum("ms").alias("ms"))
    ranked = _ranked(artists, limit, "artist")
    track = F.struct("artist", "track", minutes(F.col("ms")).alias("minutes"), "rank")
    top_tracks = (
        _ranked(tracks, limit, "artist", "track")
        .groupBy("year")
        # At most `limit` rows per year.
        .agg(F.array_sort(F.collect_list(F.struct("rank", track.alias("track")))).alias("tracks"))
        .select("year", F.transform("tracks", lambda t: t["track"]).alias("top_tracks"))
    )
    return (
        ranked.join(top_tracks, "year")
        .select("year", "artist", minutes(F.col("ms")).alias("minutes"), "rank", "top_tracks")
        .orderBy("year", "rank")
    )


def _ranked(totals: DataFrame, limit: int, *names: str) -> DataFrame:
    order = Window.partitionBy("year").orderBy(F.desc("ms"), *names)
    ranked = totals.withColumn("rank", F.row_number().over(order).cast("bigint"))
    return ranked.filter(F.col("rank") <= limit)


def discovery_rate(plays: DataFrame, params: Params) -> DataFrame:
    """Monthly share of plays from artists first heard that month, over the whole history.

    Plays are counted per artist and month first, so the join with first months is small and no
    artist's plays meet in one task.
    """
    first = (
        history(plays, params)
        .groupBy("artist_label")
        .agg(F.trunc(F.min("local_ts").cast("date"), "month").alias("first_month"))
    )
    counts = (
        selection(plays, params)
        .groupBy("artist_label", _bucket("month").alias("bucket"))
        .agg(F.count("*").alias("plays"))
    )
    new = F.when(F.col("first_month") == F.col("bucket"), F.col("plays")).otherwise(0)
    return (
        counts.join(first, "artist_label")
        .groupBy("bucket")
        .agg(F.sum("plays").alias("plays"), F.sum(new).alias("new_plays"))
        .withColumn("discovery_rate", stats.share(F.col("new_plays"), F.col("plays")))
        .orderBy("bucket")
    )


def discovery_headline(plays: DataFrame, params: Params) -> DataFrame:
    """Unweighted mean of the monthly rates, in percent."""
    mean = discovery_rate(plays, params).agg(F.avg("discovery_rate").alias("rate"))
    return mean.filter("rate IS NOT NULL").select(
        F.lit("Average monthly discovery").alias("label"),
        F.round(F.col("rate") * 100, 1).alias("value"),
        F.lit("%").alias("unit"),
    )


def seasonality(plays: DataFrame, params: Params) -> DataFrame:
    """Artist shares of listening in winter and summer, and in mornings and nights."""
    month, hour = F.month("local_ts"), F.hour("local_ts")
    season = F.when(month.isin(*SEASONS["winter"]), "winter").when(
        month.isin(*SEASONS["summer"]), "summer"
    )
    time = F.when(hour.between(5, 10), "morning").when((hour >= 22) | (hour <= 3), "night")
    tagged = selection(plays, params).select(
        F.col("artist_label").alias("artist"),
        "ms_played",
        F.explode(
            F.array(
                F.struct(F.lit("season").alias("comparison"), season.alias("period")),
                F.struct(F.lit("time").alias("comparison"), time.alias("period")),
            )
        ).alias("tag"),
    )
    totals = (
        tagged.filter(F.col("tag.period").isNotNull())
        .groupBy("tag.comparison", "tag.period", "artist")
        .agg(F.sum("ms_played").alias("ms"))
    )
    # Four periods exist: their totals are joined, not computed in four window partitions.
    whole = totals.groupBy("comparison", "period").agg(F.sum("ms").alias("whole"))
    return (
        totals.join(F.broadcast(whole), ["comparison", "period"])
        .select(
            "comparison",
            "period",
            "artist",
            minutes(F.col("ms")).alias("minutes"),
            stats.share(F.col("ms"), F.col("whole")).alias("share"),
        )
        .orderBy("comparison", "period", F.desc("minutes"), "artist")
    )


def seasonality_headline(plays: DataFrame, params: Params) -> DataFrame:
    """The artist whose share differs most between winter and summer."""
    signed = F.coalesce("share", F.lit(0.0)) * F.when(F.col("period") == "winter", 1).otherwise(-1)
    return (
        seasonality(plays, params)
        .filter(F.col("comparison") == "season")
        .groupBy("artist")
        .agg(F.round(F.sum(signed), 12).alias("difference"))
        .orderBy(F.desc(F.abs("difference")), "artist")
        .limit(1)
    )


def skip_rate(plays: DataFrame, params: Params) -> DataFrame:
    """Monthly skips among plays with a known flag."""
    return (
        selection(plays, params)
        .groupBy(_bucket("month").alias("bucket"))
        .agg(F.count("skipped").alias("known_plays"), F.count_if("skipped").alias("skips"))
        .withColumn("skip_rate", stats.share(F.col("skips"), F.col("known_plays")))
        .orderBy("bucket")
    )


def obsessions(plays: DataFrame, params: Params, over: int = OBSESSION) -> DataFrame:
    """Tracks played more than `over` times in one local ISO week, with the month they count in."""
    return (
        selection(plays, params)
        .filter(F.col("media_kind") == "track")
        .groupBy(
            F.col("artist_label").alias("artist"),
            F.col("track_label").alias("track"),
            _bucket("week").alias("week"),
        )
        .agg(
            F.count("*").alias("plays"),
            F.trunc(F.min("local_ts").cast("date"), "month").alias("bucket"),
        )
        .filter(F.col("plays") > over)
        .orderBy(F.desc("plays"), "week", "artist", "track")
    )


def skips_obsessions(plays: DataFrame, params: Params, over: int = OBSESSION) -> DataFrame:
    """Skip rates with the month's obsessions as an array.

    The array is part of the result row. `obsessions` gives the same data flat.
    """
    entry = F.struct("artist", "track", "week", "plays")
    sort_key = F.struct((-F.col("plays")).alias("k"), "week", "artist", "track")
    nested = (
        obsessions(plays, params, over)
        .groupBy("bucket")
        .agg(F.array_sort(F.collect_list(F.struct(sort_key.alias("k"), entry.alias("v")))).alias("o"))
        .select("bucket", F.transform("o", lambda x: x["v"]).alias("obsessions"))
    )
    empty = F.expr("cast(array() as array<struct<artist:string,track:string,week:date,plays:bigint>>)")
    return (
        skip_rate(plays, params)
        .join(nested, "bucket", "left")
        .withColumn("obsessions", F.coalesce("obsessions", empty))
        .orderBy("bucket")
    )


def obsession_headline(plays: DataFrame, params: Params, over: int = OBSESSION) -> DataFrame:
    return (
        obsessions(plays, params, over)
        .orderBy(F.desc("plays"), "week", "artist", "track")
        .limit(1)
        .select(
            F.concat("track", F.lit(" by "), "artist", F.lit(" · week of "), F.col("week").cast("string")).alias("label"),
            F.col("plays").cast("double").alias("value"),
            F.lit("plays").alias("unit"),
        )
    )


def soundtrack(plays: DataFrame, params: Params) -> DataFrame:
    """Top tracks of a period; without endpoints, of the 30 days up to the latest track."""
    if params.date_from is None and params.date_to is not None:
        params = replace(params, date_from=params.date_to - timedelta(days=29))
    rows = selection(plays, params).filter(F.col("media_kind") == "track")
    if params.date_from is None:
        latest = calendar.with_local(plays.filter(F.col("media_kind") == "track"), params).agg(
            F.max(F.col("local_ts").cast("date")).alias("_end"), F.max("ts").alias("_last")
        )
        # The bound on ts is wide enough for any zone; the local test is exact.
        rows = rows.crossJoin(F.broadcast(latest)).filter(
            (F.col("ts") >= F.col("_last") - F.expr("INTERVAL '32' DAY"))
            & (F.col("local_ts").cast("date") >= F.date_sub("_end", 29))
        )
    return (
        rows.groupBy(F.col("artist_label").alias("artist"), F.col("track_label").alias("track"))
        .agg(F.count("*").alias("plays"), minutes(F.sum("ms_played")).alias("minutes"))
        .orderBy(F.desc("plays"), F.desc("minutes"), "artist", "track")
        .limit(params.top_n)
        .select(
            "artist", "track", F.concat("track", F.lit(" · "), "artist").alias("label"), "plays", "minutes"
        )
    )
