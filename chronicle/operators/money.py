"""Spending analytics over the `transactions` fact table, one currency at a time."""

from __future__ import annotations

from decimal import Decimal
from statistics import median

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronicle.functions import calendar, stats
from chronicle.params import Params
from chronicle.session import staged

# The category and merchant patterns of food delivery.
DELIVERY_CATEGORY = r"(?i)delivery|takeaway"
DELIVERY_MERCHANT = (
    r"(?i)\b(glovo|tazz|bolt food|uber eats|deliveroo|wolt|just eat|foodpanda|"
    r"doordash|takeaway|lieferando)\b"
)
SHOWN_CATEGORIES = 7
MONEY = "decimal(38,2)"


def _own(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def spend() -> Column:
    """Money out as a positive amount; a refund lowers the spend of its own month."""
    out = (F.col("amount") < 0) & ~_own("exchange", "topup")
    return F.when(_own("refund") | out, -F.col("amount")).otherwise(F.lit(0).cast("decimal(18,2)"))


def income() -> Column:
    return F.when(
        (F.col("amount") > 0) & ~_own("exchange", "topup", "refund"), F.col("amount")
    ).otherwise(F.lit(0).cast("decimal(18,2)"))


def total(column: Column) -> Column:
    return F.sum(column).cast(MONEY)


def local_rows(transactions: DataFrame, params: Params) -> DataFrame:
    rows = calendar.in_range(calendar.with_local(transactions, params), params)
    return rows.withColumns(
        {
            "merchant_label": F.coalesce("merchant", "merchant_raw"),
            "category_label": F.coalesce("category", F.lit("Uncategorised")),
        }
    )


def dominant_currency(transactions: DataFrame, params: Params) -> DataFrame:
    """The most frequent currency in range, ties by code."""
    return (
        local_rows(transactions, params)
        .groupBy("currency")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "currency")
        .limit(1)
        .select("currency")
    )


def selection(transactions: DataFrame, params: Params) -> DataFrame:
    rows = local_rows(transactions, params)
    if params.currency is not None:
        return rows.filter(F.col("currency") == params.currency)
    # One row, joined without looking at it here.
    chosen = F.broadcast(dominant_currency(transactions, params))
    return rows.join(chosen, "currency", "left_semi")


def _month() -> Column:
    return calendar.bucket(F.col("local_ts"), "month").alias("bucket")


def category_spend(transactions: DataFrame, params: Params) -> DataFrame:
    """Net spend per month and category."""
    spending = (F.col("amount") < 0) & ~_own("exchange", "topup") | _own("refund")
    return (
        selection(transactions, params)
        .filter(spending)
        .groupBy(_month(), F.col("category_label").alias("category"))
        .agg(total(spend()).alias("spend"))
    )


def top_merchants(transactions: DataFrame, params: Params) -> DataFrame:
    """Top-N merchants by net spend over the whole range."""
    return (
        selection(transactions, params)
        .groupBy("merchant_label")
        .agg(total(spend()).alias("spend"))
        .filter(F.col("spend") != 0)
        .select(F.coalesce("merchant_label", F.lit("Unknown")).alias("merchant"), "spend")
        .orderBy(F.desc("spend"), "merchant")
        .limit(params.top_n)
    )


def spend_by_category(transactions: DataFrame, params: Params) -> DataFrame:
    """Monthly category spend; every row carries the range's top merchants as an array."""
    ranked = F.struct((-F.col("spend")).alias("k"), F.col("merchant"))
    merchants = (
        top_merchants(transactions, params)
        # At most top_n rows.
        .agg(
            F.array_sort(
                F.collect_list(F.struct(ranked.alias("k"), F.struct("merchant", "spend").alias("v")))
            ).alias("m")
        )
        .select(F.transform("m", lambda x: x["v"]).alias("top_merchants"))
    )
    return (
        category_spend(transactions, params)
        .crossJoin(F.broadcast(merchants))
        .orderBy("bucket", "category")
    )


def top_categories_with_other(
    transactions: DataFrame, params: Params, keep: int = SHOWN_CATEGORIES
) -> DataFrame:
    """Monthly spend of the `keep` largest categories under readable names, the rest as 'Other'."""
    monthly = category_spend(transactions, params)
    kept = stats.largest(
        monthly.groupBy("category").agg(total(F.col("spend")).alias("total")),
        keep,
        F.desc("total"),
        F.asc("category"),
    ).select("category", F.lit(True).alias("kept"))
    spaced = F.regexp_replace("category", "_", " ")
    readable = F.concat(F.upper(F.substring(spaced, 1, 1)), F.lower(spaced.substr(F.lit(2), F.length(spaced))))
    return (
        monthly.join(kept, "category", "left")
        .withColumn("label", F.when(F.col("kept"), readable).otherwise("Other"))
        .groupBy("bucket", F.col("label").alias("category"))
        .agg(total(F.col("spend")).alias("spend"))
        .orderBy("bucket", "category")
    )


def category_headline(transactions: DataFrame, params: Params) -> DataFrame:
    """The category with the highest spend."""
    return (
        category_spend(transactions, params)
        .groupBy("category")
        .agg(total(F.col("spend")).alias("value"))
        .orderBy(F.desc("value"), "category")
        .limit(1)
        .select(F.col("category").alias("label"), F.col("value").cast("double").alias("value"))
    )


def income_vs_spend(transactions: DataFrame, params: Params) -> DataFrame:
    """Income, spend and savings rate per month; no rate without income."""
    return (
        selection(transactions, params)
        .groupBy(_month())
        .agg(total(income()).alias("income"), total(spend()).alias("spend"))
        .withColumn(
            "savings_rate", stats.share(F.col("income") - F.col("spend"), F.col("income"))
        )
        .orderBy("bucket")
    )


def savings_headline(transactions: DataFrame, params: Params) -> DataFrame:
    """Mean of the monthly savings rates, in percent."""
    mean = income_vs_spend(transactions, params).agg(F.avg("savings_rate").alias("rate"))
    return mean.filter("rate IS NOT NULL").select(
        F.lit("Average savings rate").alias("label"),
        F.round(F.col("rate") * 100, 1).alias("value"),
        F.lit("%").alias("unit"),
    )


def weekday_weekend(transactions: DataFrame, params: Params) -> DataFrame:
    """Average spend per calendar day by month and side of the week; empty days count."""
    daily = (
        selection(transactions, params)
        .groupBy(F.col("local_ts").cast("date").alias("day"))
        .agg(total(spend()).alias("spend"))
    )
    first = F.lit(params.date_from).cast("date") if params.date_from else F.min("day")
    last = F.lit(params.date_to).cast("date") if params.date_to else F.max("day")
    bounds = daily.agg(first.alias("first"), last.alias("last"), F.count("*").alias("rows"))
    days = bounds.filter("rows > 0").select(
        F.explode(F.sequence("first", "last", F.expr("INTERVAL 1 DAY"))).alias("day")
    )
    side = F.when(F.weekday("day") >= 5, "weekend").otherwise("weekday")
    return (
        days.join(daily, "day", "left")
        .groupBy(F.trunc("day", "month").cast("date").alias("bucket"), side.alias("side"))
        .agg(
            F.count("*").alias("days"),
            F.sum(F.coalesce("spend", F.lit(0).cast(MONEY))).cast(MONEY).alias("spend"),
        )
        .withColumn("average_spend", stats.share(F.col("spend"), F.col("days")))
        .orderBy("bucket", "side")
    )


def weekend_headline(transactions: DataFrame, params: Params) -> DataFrame:
    """How much more a weekend day costs than a weekday, when the range has both."""

    def average(side: str) -> Column:
        mine = F.col("side") == side
        return stats.share(F.sum(F.when(mine, F.col("spend"))), F.sum(F.when(mine, F.col("days"))))

    difference = average("weekend") - average("weekday")
    return (
        weekday_weekend(transactions, params)
        .agg(F.round(difference, 2).alias("value"))
        .filter("value IS NOT NULL")
        .select(F.lit("Weekend minus weekday day").alias("label"), "value")
    )


def delivery_share(
    transactions: DataFrame,
    params: Params,
    category_pattern: str = DELIVERY_CATEGORY,
    merchant_pattern: str = DELIVERY_MERCHANT,
) -> DataFrame:
    """Monthly share of spend whose category or merchant matches a pattern."""
    matches = F.col("category_label").rlike(category_pattern) | F.coalesce(
        "merchant_label", F.lit("")
    ).rlike(merchant_pattern)
    nothing = F.lit(0).cast("decimal(18,2)")
    return (
        selection(transactions, params)
        .groupBy(_month())
        .agg(
            total(spend()).alias("spend"),
            total(F.when(matches, spend()).otherwise(nothing)).alias("delivery_spend"),
        )
        .withColumn("delivery_share", stats.share(F.col("delivery_spend"), F.col("spend")))
        .orderBy("bucket")
    )


def delivery_headline(transactions: DataFrame, params: Params, **patterns: str) -> DataFrame:
    """The latest month's share in percent, and its change from the month a year before."""
    monthly = delivery_share(transactions, params, **patterns)
    before = monthly.select(
        F.add_months("bucket", 12).alias("bucket"), F.col("delivery_share").alias("before")
    )
    return (
        monthly.join(before, "bucket", "left")
        .orderBy(F.desc("bucket"))
        .limit(1)
        .select(
            F.lit("Latest delivery share").alias("label"),
            F.round(F.col("delivery_share") * 100, 1).alias("value"),
            F.lit("%").alias("unit"),
            F.round((F.col("delivery_share") - F.col("before")) * 100, 10).alias("delta"),
        )
    )


# ---- recurring charges ------------------------------------------------------------------------


def charges(transactions: DataFrame, params: Params) -> DataFrame:
    """Outgoing rows with a known merchant, as positive amounts on local days."""
    return (
        selection(transactions, params)
        .filter((F.col("amount") < 0) & ~_own("exchange", "topup"))
        .filter(F.col("merchant_label").isNotNull())
        .select(
            F.col("merchant_label").alias("merchant"),
            F.col("local_ts").cast("date").alias("day"),
            (-F.col("amount")).cast("decimal(18,2)").alias("amount"),
            "ts",
            "id",
        )
    )


def day_gaps(paid: DataFrame) -> DataFrame:
    """(merchant, gap, weight): days between consecutive charges, and how often.

    Charges are counted per merchant and day before anything is ordered: n charges on one day are
    n - 1 gaps of 0 days. A merchant's rows are then at most its calendar days.
    """
    days = paid.groupBy("merchant", "day").agg(F.count("*").alias("n"))
    by_day = Window.partitionBy("merchant").orderBy("day")
    between = F.datediff("day", F.lag("day").over(by_day)).cast("bigint")
    gaps = days.withColumn("between", between).select(
        "merchant",
        F.explode(
            F.array(
                F.struct(F.col("between").alias("gap"), F.lit(1).cast("bigint").alias("weight")),
                F.struct(F.lit(0).cast("bigint").alias("gap"), (F.col("n") - 1).alias("weight")),
            )
        ).alias("g"),
    ).select("merchant", "g.gap", "g.weight")
    return (
        gaps.filter("gap IS NOT NULL AND weight > 0")
        .groupBy("merchant", "gap")
        .agg(F.sum("weight").alias("weight"))
    )


def recurring_charges(
    transactions: DataFrame, params: Params, paid: DataFrame | None = None
) -> DataFrame:
    """Merchants with at least three charges whose median day gap is monthly or yearly."""
    counts = staged(day_gaps(charges(transactions, params) if paid is None else paid))
    interval = stats.exact_median(counts, ["merchant"], "gap", "weight", 64)
    return (
        interval.select(
            "merchant",
            (F.col("n") + 1).alias("charges"),
            F.col("median").alias("interval_days"),
        )
        .filter("charges >= 3")
        .filter("interval_days BETWEEN 25 AND 35 OR interval_days BETWEEN 350 AND 380")
    )


_RUNS = (
    "merchant string, run bigint, first_charge date, last_charge date, "
    "charges bigint, amount decimal(18,2), established boolean"
)
_TOLERANCE = Decimal("0.1")
_STEP = Decimal("0.5")


def split_prices(amounts: list[Decimal]) -> list[tuple[int, int]]:
    """Cut ordered amounts into half-open runs whose members stay within 10% of the run's median.

    Amounts are positive, so a run holds together exactly when its smallest and its largest member
    do; the median comes from a sorted copy that grows with the run.
    """
    from bisect import insort

    runs, start, ordered = [], 0, []
    for position, amount in enumerate(amounts):
        insort(ordered, amount)
        middle, odd = divmod(len(ordered), 2)
        typical = ordered[middle] if odd else (ordered[middle - 1] + ordered[middle]) / 2
        limit = typical * _TOLERANCE
        if ordered[-1] - typical > limit or typical - ordered[0] > limit:
            runs.append((start, position))
            start, ordered = position, [amount]
    if amounts:
        runs.append((start, len(amounts)))
    return runs


def _runs_of_merchant(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["ts", "id"], kind="stable")
    days, amounts = rows["day"].tolist(), rows["amount"].tolist()
    runs = split_prices(amounts)
    medians = [median(amounts[a:b]) for a, b in runs]
    steady = all(b - a >= 3 for a, b in runs[:-1]) and all(
        abs(later - earlier) <= earlier * _STEP for earlier, later in zip(medians, medians[1:])
    )
    return pd.DataFrame(
        {
            "merchant": [rows["merchant"].iloc[0]] * len(runs),
            "run": range(len(runs)),
            "first_charge": [days[a] for a, _ in runs],
            "last_charge": [days[b - 1] for _, b in runs],
            "charges": [b - a for a, b in runs],
            "amount": [m.quantize(Decimal("0.01")) for m in medians],
            "established": [steady] * len(runs),
        }
    )


def price_runs(
    transactions: DataFrame, params: Params, recurring: DataFrame | None = None, paid: DataFrame | None = None
) -> DataFrame:
    """Consecutive prices of every recurring merchant, and whether its history is steady.

    The fold depends on order, so a merchant's charges meet in one task. Only recurring merchants
    get here: half of their gaps are at least 25 days, so n charges span at least 12 n days and no
    merchant can hold more than a few thousand, whatever the size of the data.
    """
    if paid is None:
        paid = staged(charges(transactions, params))
    if recurring is None:
        recurring = recurring_charges(transactions, params, paid)
    rows = paid.join(recurring.select("merchant"), "merchant", "left_semi")
    return rows.groupBy("merchant").applyInPandas(_runs_of_merchant, _RUNS)


def subscriptions(transactions: DataFrame, params: Params) -> DataFrame:
    """Recurring merchants with their latest price, yearly cost, activity and price history."""
    reference = params.date_to or params.as_of
    if reference is None:
        raise ValueError("subscriptions need date_to or as_of to decide what is active")
    # The charges are read several times: the table, and its currency, once.
    paid = staged(charges(transactions, params))
    recurring = staged(recurring_charges(transactions, params, paid))
    price = F.struct("first_charge", "last_charge", "amount")
    folded = (
        price_runs(transactions, params, recurring, paid)
        .filter("established")
        .groupBy("merchant")
        .agg(
            F.max_by("amount", "run").alias("typical_amount"),
            F.min("first_charge").alias("first_charge"),
            F.max("last_charge").alias("last_charge"),
            # Runs per merchant are bounded like its charges.
            F.array_sort(F.collect_list(F.struct("run", price.alias("price")))).alias("runs"),
        )
    )
    interval = F.col("interval_days")
    monthly = interval <= 35
    return (
        folded.join(recurring, "merchant")
        .select(
            "merchant",
            F.when(monthly, "monthly").otherwise("yearly").alias("period"),
            "typical_amount",
            (F.col("typical_amount") * F.when(monthly, 12).otherwise(1))
            .cast("decimal(20,2)")
            .alias("annual_cost"),
            "first_charge",
            "last_charge",
            (F.datediff(F.lit(reference), "last_charge") <= interval * 1.5).alias("active"),
            F.date_add("last_charge", F.bround(interval, 0).cast("int")).alias("next_expected_date"),
            "interval_days",
            "charges",
            F.transform("runs", lambda r: r["price"]).alias("price_history"),
        )
        .orderBy(F.desc("annual_cost"), "merchant")
    )


def subscription_headline(transactions: DataFrame, params: Params) -> DataFrame:
    """Yearly cost of the active subscriptions."""
    rows = subscriptions(transactions, params)
    cost = F.coalesce(F.sum(F.when(F.col("active"), F.col("annual_cost"))), F.lit(0))
    return (
        rows.agg(cost.cast("double").alias("value"), F.count("*").alias("rows"))
        .filter("rows > 0")
        .select(F.lit("Active annual subscription cost").alias("label"), "value")
    )
