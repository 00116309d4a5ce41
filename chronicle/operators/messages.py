"""Message analytics over the `messages` fact table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronicle.functions import calendar, ordered, stats, text
from chronicle.params import Params
from chronicle.session import staged

REPLY_LIMIT = "INTERVAL '24' HOUR"
SILENCE = "INTERVAL '6' HOUR"
# Reply gaps are counted in bins of 0.3 s: at most 288,000 bins within 24 hours.
GAP_BIN = 300_000


def contact_roots(contacts: DataFrame) -> DataFrame:
    """(id, root, label): follow `merged_into` to the living contact at the end of each chain.

    Only superseded contacts take part in the rounds. Each round resolves those that point at a
    resolved contact and lets the others skip one step ahead, so a chain of n needs log2(n)
    rounds. Chains that end nowhere, or in a circle, have no root.
    """
    living = contacts.filter(F.col("merged_into").isNull()).select(
        "id", F.col("id").alias("root"), F.col("display_name").alias("label")
    )
    pending = staged(
        contacts.filter(F.col("merged_into").isNotNull()).select("id", "merged_into")
    )
    targets, solved = living, []
    while not pending.isEmpty():
        found = staged(
            pending.join(targets.withColumnRenamed("id", "merged_into"), "merged_into").select(
                "id", "root", "label"
            )
        )
        if found.isEmpty():
            break
        solved.append(found)
        rest = pending.join(found.select("id"), "id", "left_anti")
        ahead = rest.select(F.col("id").alias("merged_into"), F.col("merged_into").alias("_ahead"))
        pending = staged(
            rest.join(ahead, "merged_into", "left").select(
                "id", F.coalesce("_ahead", "merged_into").alias("merged_into")
            )
        )
        targets = reduce(DataFrame.unionByName, solved)
    return reduce(DataFrame.unionByName, solved, living)


def resolve_contact(messages: DataFrame, contacts: DataFrame | None) -> DataFrame:
    """Add `contact_key` and `contact`: root contact, else contact id, else chat name."""
    if contacts is None:
        return messages.withColumns(
            {
                "contact_key": F.coalesce("contact_id", "chat_name", F.lit("Unknown")),
                "contact": F.coalesce("chat_name", F.lit("Unknown")),
            }
        )
    roots = contact_roots(contacts)
    names = (
        contacts.select("id", "display_name")
        .join(roots, "id", "left")
        .select(
            F.col("id").alias("_id"),
            F.col("root").alias("_root"),
            F.coalesce("label", "display_name").alias("_label"),
        )
    )
    # Messages without a contact would all meet in one task: spread them over keys that match none.
    spread = F.concat(F.lit("\x1f"), F.pmod(F.xxhash64("id"), F.lit(4096)).cast("string"))
    keyed = messages.withColumn("_id", F.coalesce("contact_id", spread))
    return keyed.join(names, "_id", "left").withColumns(
        {
            "contact_key": F.coalesce("_root", "contact_id", "chat_name", F.lit("Unknown")),
            "contact": F.coalesce("_label", "chat_name", F.lit("Unknown")),
        }
    ).drop("_id", "_root", "_label")


def selection(
    messages: DataFrame, params: Params, contacts: DataFrame | None = None, direct: bool = True
) -> DataFrame:
    """Text and media rows in range, with local time and the resolved contact."""
    rows = messages.filter(F.col("kind").isin("text", "media"))
    if direct:
        rows = rows.filter(F.col("chat_kind") == "direct")
    rows = calendar.in_range(calendar.with_local(rows, params), params)
    return resolve_contact(rows, contacts)


def volume_by_contact(
    messages: DataFrame, params: Params, contacts: DataFrame | None = None
) -> DataFrame:
    """Messages per bucket of the top-N contacts."""
    # Ranked and listed from the same counts: messages are read once.
    counts = staged(
        selection(messages, params, contacts)
        .groupBy("contact_key", calendar.bucket(F.col("local_ts"), params.granularity).alias("bucket"))
        .agg(F.min("contact").alias("contact"), F.count("*").alias("messages"))
    )
    totals = counts.groupBy("contact_key").agg(F.sum("messages").alias("total"))
    top = stats.largest(totals, params.top_n, F.desc("total"), F.asc("contact_key"))
    return (
        counts.join(top, "contact_key", "left_semi")
        .select("contact", "bucket", "messages")
        .orderBy("bucket", "contact")
    )


def volume_headline(
    messages: DataFrame, params: Params, contacts: DataFrame | None = None
) -> DataFrame:
    """The contact with most messages."""
    return (
        selection(messages, params, contacts)
        .groupBy("contact_key")
        .agg(F.min("contact").alias("contact"), F.count("*").alias("messages"))
        .orderBy(F.desc("messages"), "contact")
        .limit(1)
        .select(F.col("contact").alias("label"), F.col("messages").cast("double").alias("value"),
                F.lit("messages").alias("unit"))
    )


def _yearly_counts(messages: DataFrame, params: Params, contacts: DataFrame | None) -> DataFrame:
    return (
        selection(messages, params, contacts)
        .groupBy("contact_key", F.year("local_ts").cast("bigint").alias("year"))
        .agg(F.min("contact").alias("contact"), F.count("*").alias("messages"))
    )


def top_contacts_by_year(
    messages: DataFrame, params: Params, contacts: DataFrame | None = None
) -> DataFrame:
    """The first min(top_n, 5) contacts of each local year."""
    by_year = Window.partitionBy("year").orderBy(F.desc("messages"), "contact", "contact_key")
    return (
        _yearly_counts(messages, params, contacts)
        .withColumn("rank", F.row_number().over(by_year).cast("bigint"))
        .filter(F.col("rank") <= min(params.top_n, 5))
        .select("contact", "year", "messages", "rank")
        .orderBy("year", "rank")
    )


def biggest_rise(
    messages: DataFrame, params: Params, contacts: DataFrame | None = None
) -> DataFrame:
    """The contact that climbed most ranks between its first and its last year.

    Ranks run over all contacts of a year. A range sort gives them their positions, so that a year
    with very many contacts is ranked by many tasks.
    """
    counts = _yearly_counts(messages, params, contacts)
    ranked = _positions(counts, "year", [F.desc("messages"), F.asc("contact"), F.asc("contact_key")])
    return (
        ranked.groupBy("contact_key")
        .agg(
            F.min("contact").alias("contact"),
            (F.min_by("rank", "year") - F.max_by("rank", "year")).alias("rise"),
        )
        .orderBy(F.desc("rise"), "contact")
        .limit(1)
        .select("contact", "rise")
    )


def _positions(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """`rank` of every row within its group, from a global range sort and per-partition counts.

    The sorted rows are written once: a second run of the sort could cut its ranges elsewhere.
    """
    rows = staged(
        df.orderBy(group, *order).withColumns(
            {"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}
        )
    )
    return ordered.running_total(rows, [group], "_part", ["_at"], F.lit(1), "rank").drop(
        "_part", "_at"
    )


def replies(
    messages: DataFrame, params: Params, contacts: DataFrame | None = None
) -> DataFrame:
    """Messages that answer the other side within 24 hours, with the gap in microseconds."""
    rows = selection(messages, params, contacts).withColumn("_hour", F.date_trunc("hour", "ts"))
    rows = ordered.previous_values(
        rows,
        ["source", "chat_id"],
        "_hour",
        ["ts", "id"],
        {"ts": "previous_ts", "is_from_me": "previous_me"},
    )
    return rows.filter(
        (F.col("is_from_me") != F.col("previous_me"))
        & (F.col("ts") - F.col("previous_ts") <= F.expr(REPLY_LIMIT))
    ).withColumn("gap", F.unix_micros("ts") - F.unix_micros("previous_ts"))


def response_times(
    messages: DataFrame, params: Params, contacts: DataFrame | None = None
) -> DataFrame:
    """Exact median reply minutes per top-N contact and side."""
    side = F.when(F.col("is_from_me"), "you").otherwise("them")
    # The gaps are counted once; ranks and medians read the counts.
    counts = staged(
        replies(messages, params, contacts)
        .groupBy("contact_key", side.alias("side"), "gap")
        .agg(F.min("contact").alias("contact"), F.count("*").alias("weight"))
    )
    sides = counts.groupBy("contact_key", "side").agg(
        F.min("contact").alias("contact"), F.sum("weight").alias("replies")
    )
    totals = sides.groupBy("contact_key").agg(F.sum("replies").alias("total"))
    top = stats.largest(totals, params.top_n, F.desc("total"), F.asc("contact_key"))
    kept = counts.join(top, "contact_key", "left_semi")
    medians = stats.exact_median(kept, ["contact_key", "side"], "gap", "weight", GAP_BIN)
    return (
        medians.join(sides, ["contact_key", "side"])
        .select("contact", "side", (F.col("median") / F.lit(6e7)).alias("minutes"), "replies")
        .orderBy("contact", "side")
    )


def response_headline(
    messages: DataFrame, params: Params, contacts: DataFrame | None = None
) -> DataFrame:
    """My median reply over all contacts."""
    counts = staged(
        replies(messages, params, contacts)
        .filter("is_from_me")
        .groupBy("gap")
        .agg(F.count("*").alias("weight"))
    )
    return stats.exact_median(counts, [], "gap", "weight", GAP_BIN).select(
        F.lit("Your median reply").alias("label"),
        F.round(F.col("median") / F.lit(6e7), 1).alias("value"),
        F.lit("minutes").alias("unit"),
    )


def conversation_starters(
    messages: DataFrame, params: Params, contacts: DataFrame | None = None
) -> DataFrame:
    """Who starts conversations: the first message of a chat, or one after six silent hours."""
    rows = selection(messages, params, contacts).withColumn("_hour", F.date_trunc("hour", "ts"))
    rows = ordered.previous_values(
        rows, ["source", "chat_id"], "_hour", ["ts", "id"], {"ts": "previous_ts"}
    )
    starts = rows.filter(
        F.col("previous_ts").isNull()
        | (F.col("ts") - F.col("previous_ts") >= F.expr(SILENCE))
    )
    counts = staged(
        starts.groupBy("contact_key").agg(
            F.min("contact").alias("contact"),
            F.count("*").alias("conversations"),
            F.count_if("is_from_me").alias("started_by_you"),
        )
    )
    overall = counts.agg(
        stats.share(F.sum("started_by_you"), F.sum("conversations")).alias("overall_share")
    )
    top = counts.orderBy(F.desc("conversations"), "contact", "contact_key").limit(params.top_n)
    return (
        top.crossJoin(F.broadcast(overall))
        .select(
            "contact",
            "conversations",
            "started_by_you",
            stats.share(F.col("started_by_you"), F.col("conversations")).alias("your_share"),
            "overall_share",
        )
        .orderBy(F.desc("conversations"), "contact")
    )


def activity_heatmap(messages: DataFrame, params: Params) -> DataFrame:
    """My messages by local hour and ISO weekday."""
    rows = _local_rows(messages, params).filter("is_from_me")
    return (
        rows.groupBy(
            F.hour("local_ts").cast("bigint").alias("hour"),
            (F.weekday("local_ts") + 1).cast("bigint").alias("weekday"),
        )
        .agg(F.count("*").alias("messages"))
        .orderBy("weekday", "hour")
    )


def night_share(messages: DataFrame, params: Params) -> DataFrame:
    """Percent of my messages sent before 5 am local time."""
    rows = _local_rows(messages, params).filter("is_from_me")
    share = stats.share(F.count_if(F.hour("local_ts") < 5), F.count("*"))
    return rows.agg(share.alias("share")).filter("share IS NOT NULL").select(
        F.lit("Night-owl index").alias("label"),
        F.round(F.col("share") * 100, 1).alias("value"),
        F.lit("%").alias("unit"),
    )


def _local_rows(messages: DataFrame, params: Params) -> DataFrame:
    rows = messages.filter(F.col("kind").isin("text", "media"))
    return calendar.in_range(calendar.with_local(rows, params), params)


def streaks_silences(
    messages: DataFrame, params: Params, contacts: DataFrame | None = None
) -> DataFrame:
    """Longest run of consecutive local days, and longest gap in days, per contact.

    Rows are first reduced to (contact, label, day), so a window sees a contact's calendar only.
    """
    days = (
        selection(messages, params, contacts)
        .select("contact_key", "contact", F.col("local_ts").cast("date").alias("day"))
        .distinct()
    )
    by_day = Window.partitionBy("contact_key").orderBy("day")
    numbered = days.select(
        "contact_key",
        "contact",
        F.date_sub("day", F.row_number().over(by_day)).alias("run"),
        F.datediff("day", F.lag("day").over(by_day)).alias("gap"),
    )
    runs = numbered.groupBy("contact_key", "run").agg(
        F.min("contact").alias("contact"),
        F.count("*").alias("streak"),
        F.max("gap").alias("silence"),
    )
    return (
        runs.groupBy("contact_key")
        .agg(
            F.min("contact").alias("contact"),
            F.max("streak").alias("streak_days"),
            F.coalesce(F.max("silence"), F.lit(0)).cast("bigint").alias("silence_days"),
        )
        .orderBy(F.desc("streak_days"), "contact", "contact_key")
        .limit(params.top_n)
        .select("contact", "streak_days", "silence_days")
    )


def _tokens(messages: DataFrame, params: Params) -> DataFrame:
    """(year, kind, token, count) over my texts; counted before the shuffle."""
    rows = (
        _local_rows(messages, params)
        .filter(F.col("is_from_me") & (F.col("kind") == "text") & F.col("text").isNotNull())
        .select(F.year("local_ts").cast("bigint").alias("year"), text.strip_urls(F.col("text")).alias("text"))
    )
    found = F.concat(text.emoji(F.col("text")), text.words(F.col("text")))
    counted = rows.select("year", F.explode(found).alias("token")).groupBy("year", "token").agg(F.count("*").alias("count"))
    # Kinds are told apart, and stopwords dropped, once per different token.
    word = text.is_word(F.col("token"))
    return counted.filter(~(word & text.is_stopword(F.col("token")))).select(
        "year", F.when(word, "word").otherwise("emoji").alias("kind"), "token", "count"
    )


def emoji_words(messages: DataFrame, params: Params) -> DataFrame:
    """Top-N emoji and words of my texts per local year."""
    order = Window.partitionBy("year", "kind").orderBy(F.desc("count"), "token")
    return (
        _tokens(messages, params)
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= params.top_n)
        .select("year", "kind", "token", "count")
        .orderBy("year", "kind", F.desc("count"), "token")
    )


def emoji_headline(messages: DataFrame, params: Params) -> DataFrame:
    """The emoji used most often over the whole range."""
    return (
        _tokens(messages, params)
        .filter(F.col("kind") == "emoji")
        .groupBy("token")
        .agg(F.sum("count").alias("count"))
        .orderBy(F.desc("count"), "token")
        .limit(1)
        .select("token", "count")
    )
