"""Composites over the operators: year-over-year changes and the summary of a year."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronicle.functions import calendar, stats
from chronicle.operators import cross, messages, money, plays
from chronicle.params import Params
from chronicle.plans.registry import FACT_NAMES, OperatorSpec, Tables, available

AT_ONCE = 8  # headlines computed at the same time
_HEADLINE = "dig_id string, dig_title string, which string, label string, value double, unit string"
PERCENT = ("%", "percent", "percentage")


def _facts(tables: Tables) -> Tables:
    return {name: tables[name] for name in FACT_NAMES if name in tables}


def year_params(year: int, params: Params) -> Params:
    return replace(params, date_from=date(year, 1, 1), date_to=date(year, 12, 31))


def compared_year(tables: Tables, params: Params) -> int | None:
    """The last complete local year in the data, or up to `date_to`. Reads two scalars."""
    span = cross.coverage(_facts(tables), params.tz).select("last_day").first()
    if span is None:
        return None
    cutoff = min(span["last_day"], params.date_to) if params.date_to else span["last_day"]
    return cutoff.year if (cutoff.month, cutoff.day) == (12, 31) else cutoff.year - 1


def _fixed_currency(tables: Tables, params: Params, year: int) -> Params:
    """One currency for both years."""
    if params.currency is None and "transactions" in tables:
        both = replace(params, date_from=date(year - 1, 1, 1), date_to=date(year, 12, 31))
        found = money.dominant_currency(tables["transactions"], both).first()
        return replace(params, currency=found["currency"] if found else None)
    return params


def year_over_year(
    spark: SparkSession,
    tables: Tables,
    params: Params,
    specs: list[OperatorSpec] | None = None,
) -> DataFrame:
    """Numeric headlines of the last complete year against the year before.

    Two headlines compare when their labels and units agree. Percentages change by points, other
    values by percent of the earlier one. Headlines are one row each and are computed side by side, as small plans: a union
    of them all spends its time in planning.
    """
    year = compared_year(tables, params)
    specs = available(tables) if specs is None else specs
    parts = []
    if year is not None:
        params = _fixed_currency(tables, params, year)
        for spec in specs:
            if spec.headline is None:
                continue
            for which, at in (("this", year), ("last", year - 1)):
                row = spec.headline(tables, year_params(at, params))
                unit = F.col("unit") if "unit" in row.columns else F.lit(params.currency)
                parts.append(
                    row.select(
                        F.lit(spec.id).alias("dig_id"),
                        F.lit(spec.title).alias("dig_title"),
                        F.lit(which).alias("which"),
                        "label",
                        F.round(F.col("value").cast("double"), 10).alias("value"),
                        unit.cast("string").alias("unit"),
                    )
                )
    if not parts:
        return spark.createDataFrame([], _YOY)
    with ThreadPoolExecutor(AT_ONCE) as pool:
        found = [tuple(row) for rows in pool.map(DataFrame.collect, parts) for row in rows]
    rows = spark.createDataFrame(found, _HEADLINE).filter("value IS NOT NULL AND NOT isnan(value)")

    def side(which: str, column: str) -> Column:
        return F.max(F.when(F.col("which") == which, F.col(column)))

    pairs = rows.groupBy("dig_id", "dig_title").agg(
        side("this", "label").alias("label"),
        side("last", "label").alias("_label"),
        side("this", "unit").alias("unit"),
        side("last", "unit").alias("_unit"),
        side("this", "value").alias("this_year"),
        side("last", "value").alias("last_year"),
    )
    pairs = pairs.filter(
        (F.col("label") == F.col("_label"))
        & F.col("unit").eqNullSafe(F.col("_unit"))
        & F.col("this_year").isNotNull()
        & F.col("last_year").isNotNull()
    )
    points = F.coalesce(F.col("unit").isin(*PERCENT), F.lit(False))
    base = F.abs("last_year")
    relative = (F.col("this_year") - F.col("last_year")) / F.when(base != 0, base) * 100
    delta = F.round(F.when(points, F.col("this_year") - F.col("last_year")).otherwise(relative), 10)
    compared = pairs.agg(F.count("*").alias("_compared"))
    return (
        pairs.crossJoin(F.broadcast(compared))
        .select(
            "dig_id",
            "label",
            "dig_title",
            F.when(points, "pp").otherwise("%").alias("delta_unit"),
            (F.lit(len(specs)) - F.col("_compared")).cast("bigint").alias("skipped_digs"),
            "unit",
            "this_year",
            "last_year",
            delta.alias("delta_pct"),
            F.lit(year).cast("bigint").alias("year"),
            F.lit(year - 1).cast("bigint").alias("previous_year"),
        )
        .orderBy(F.coalesce(F.abs("delta_pct"), F.lit(-1.0)).desc(), "dig_id")
    )


_YOY = (
    "dig_id string, label string, dig_title string, delta_unit string, skipped_digs bigint, "
    "unit string, this_year double, last_year double, delta_pct double, year bigint, "
    "previous_year bigint"
)


# ---- the summary of a year ----------------------------------------------------------------------


def initials(name: Column) -> Column:
    """First and last initial of a name, '?' without letters."""
    starts = F.filter(F.transform(F.split(name, r"\s+"), lambda w: F.substring(w, 1, 1)), lambda c: c.rlike(r"\p{L}"))
    letters = F.transform(starts, F.upper)
    last = F.when(F.size(letters) > 1, F.element_at(letters, -1)).otherwise("")
    return F.when(F.size(letters) == 0, "?").otherwise(F.concat(F.element_at(letters, 1), last))


def _row(section: str, metric: str, df: DataFrame, value: Column, unit: str, label: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"),
        F.lit(metric).alias("metric"),
        (F.lit(None) if label is None else label).cast("string").alias("label"),
        value.cast("double").alias("value"),
        F.lit(unit).alias("unit"),
    )


def _in_year(df: DataFrame, params: Params) -> DataFrame:
    return calendar.in_range(calendar.with_local(df, params), params)


def year_summary(
    tables: Tables, year: int, params: Params, names: bool = False, amounts: bool = False
) -> DataFrame:
    """The numbers behind a yearly review: (section, metric, label, value, unit).

    People appear as initials and amounts of money not at all, unless asked for.
    """
    params = year_params(year, params)
    parts: list[DataFrame] = []
    if "messages" in tables:
        parts += _message_rows(tables, params, names)
    if "media_plays" in tables:
        parts += _play_rows(tables["media_plays"], params)
    if "transactions" in tables:
        parts += _money_rows(tables["transactions"], year, params, amounts)
    if "events" in tables:
        count = _in_year(tables["events"], params).agg(F.count("*").alias("n")).filter("n > 0")
        parts.append(_row("numbers", "events", count, F.col("n"), "events"))
    return reduce(DataFrame.unionByName, parts)


def _message_rows(tables: Tables, params: Params, names: bool) -> list[DataFrame]:
    rows = tables["messages"]
    written = _in_year(rows.filter(F.col("kind").isin("text", "media")), params)
    total = written.agg(F.count("*").alias("n")).filter("n > 0")
    people = messages.selection(rows, params, tables.get("contacts")).groupBy("contact_key").agg(
        F.min("contact").alias("contact"), F.count("*").alias("n")
    )
    top = people.orderBy(F.desc("n"), "contact").limit(3).crossJoin(
        F.broadcast(total.withColumnRenamed("n", "all"))
    )
    shown = F.col("contact") if names else initials(F.col("contact"))
    heat = messages.activity_heatmap(rows, params)
    hours = heat.groupBy("hour").agg(F.sum("messages").alias("n")).orderBy(F.desc("n"), "hour").limit(1)
    days = heat.groupBy("weekday").agg(F.sum("messages").alias("n")).orderBy(F.desc("n"), "weekday").limit(1)
    night = messages.night_share(rows, params)
    title = (
        F.when((F.col("value") >= 15) | (F.col("hour") >= 23) | (F.col("hour") < 4), "Night owl, confirmed")
        .when(F.col("hour").between(5, 9), "Early riser")
        .otherwise("Your rhythm")
    )
    return [
        _row("numbers", "messages", total, F.col("n"), "messages"),
        _row("circle", "contact", top, F.col("n"), "messages", shown),
        _row("circle", "contact_share", top, stats.share(F.col("n"), F.col("all")), "share", shown),
        _row("rhythm", "busiest_hour", hours, F.col("hour"), "hour"),
        _row("rhythm", "busiest_weekday", days, F.col("weekday"), "weekday"),
        _row("rhythm", "night_share", night.crossJoin(hours.select("hour")), F.col("value"), "%", title),
    ]


def _play_rows(rows: DataFrame, params: Params) -> list[DataFrame]:
    monthly = plays.listening_minutes(rows, replace(params, granularity="month"))
    artists = plays.top_artists_by_year(rows, replace(params, top_n=1))
    track = F.get("top_tracks", F.lit(0))
    peak = monthly.orderBy(F.desc("minutes"), "bucket").limit(1)
    total = monthly.agg(F.sum("minutes").alias("minutes")).filter("minutes IS NOT NULL")
    return [
        _row("numbers", "listening", total, F.round(F.col("minutes") / 60, 1), "hours"),
        _row("soundtrack", "top_artist", artists, F.col("minutes") / 60, "hours", F.col("artist")),
        _row("soundtrack", "top_track", artists, track["minutes"] / 60, "hours", F.concat(track["track"], F.lit(" · "), track["artist"])),
        _row("soundtrack", "peak_month", peak, F.month("bucket"), "month"),
    ]


def _money_rows(rows: DataFrame, year: int, params: Params, amounts: bool) -> list[DataFrame]:
    count = _in_year(rows, params).agg(F.count("*").alias("n")).filter("n > 0")
    if params.currency is None:
        found = money.dominant_currency(rows, params).first()
        if found is None:
            return []
        params = replace(params, currency=found["currency"])
    before = year_params(year - 1, params)
    active = money.subscriptions(rows, params).filter("active").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("annual_cost"), F.lit(0)).alias("cost")
    )
    delivery = money.delivery_share(rows, params).agg(
        F.sum("spend").alias("spend"), F.sum("delivery_spend").alias("food")
    ).filter("spend > 0")
    share = F.least(F.greatest(stats.share(F.col("food"), F.col("spend")), F.lit(0.0)), F.lit(1.0))
    months = money.income_vs_spend(rows, params)
    late = F.month("bucket") > 6
    halves = months.agg(
        (F.avg(F.when(late, F.col("savings_rate"))) - F.avg(F.when(~late, F.col("savings_rate")))).alias("half"),
        F.round(F.avg("savings_rate") * 100, 1).alias("rate"),
    )
    last = money.income_vs_spend(rows, before).agg(F.round(F.avg("savings_rate") * 100, 1).alias("rate_before"))
    change = halves.crossJoin(F.broadcast(last)).withColumns(
        {
            "against": F.when(F.col("rate_before").isNotNull() & F.col("rate").isNotNull(), "last year").otherwise("first half"),
            "change": F.coalesce(F.col("rate") - F.col("rate_before"), F.col("half") * 100),
        }
    ).filter("change IS NOT NULL")
    parts = [
        _row("numbers", "transactions", count, F.col("n"), "transactions"),
        _row("money", "active_subscriptions", active, F.col("n"), "subscriptions"),
        _row("money", "delivery_share", delivery, share, "share"),
        _row("money", "savings_change", change, F.col("change"), "points", F.col("against")),
    ]
    if amounts:
        parts += [
            _row("money", "subscription_cost", active, F.col("cost"), params.currency),
            _row("money", "delivery_spend", delivery, F.col("food"), params.currency),
            _row("money", "savings_rate", halves.filter("rate IS NOT NULL"), F.col("rate"), "%"),
        ]
    return parts


def top_changes(
    spark: SparkSession, tables: Tables, year: int, params: Params, limit: int = 4,
    specs: list[OperatorSpec] | None = None,
) -> DataFrame:
    """The largest changes against the year before, if the data covers that year from January."""
    first = cross.coverage(_facts(tables), params.tz).select("first_day").first()
    if first is None or first["first_day"] > date(year - 1, 1, 31):
        return spark.createDataFrame([], _YOY)
    changes = year_over_year(spark, tables, replace(params, date_to=date(year, 12, 31)), specs)
    return changes.filter(F.col("delta_pct").isNotNull() & (F.col("year") == year)).limit(limit)
