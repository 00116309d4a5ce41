"""Driver tables as canonical fact tables. Operators never mention driver tables.

Each view is written twice: as a DataFrame here, and as a CTE for DuckDB in `VIEWS`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ts(column: Column) -> Column:
    return column.cast("timestamp")


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense messages of one month, from `events`."""
    user = F.col("user_id").cast("string")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.lit("events").alias("source"),
        user.alias("chat_id"),
        F.concat(F.lit("user-"), user).alias("chat_name"),
        F.when(F.col("user_id") % 5 == 0, "group").otherwise("direct").alias("chat_kind"),
        F.concat(F.lit("c"), user).alias("sender_id"),
        F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("c"), user)).alias("contact_id"),
        F.col("event_type").isin("click", "purchase").alias("is_from_me"),
        _ts(F.col("ts")).alias("ts"),
        _null("string").alias("text"),
        F.when(F.col("event_type") == "error", "system").otherwise("text").alias("kind"),
    )


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One contact per user of `events`; three of four were merged into the one before."""
    user = F.col("user_id")
    return (
        table(spark, sf_dir, "events")
        .select("user_id")
        .distinct()
        .select(
            F.concat(F.lit("c"), user.cast("string")).alias("id"),
            F.concat(F.lit("Person "), (user % 40).cast("string")).alias("display_name"),
            F.when(user % 4 != 0, F.concat(F.lit("c"), (user - 1).cast("string"))).alias(
                "merged_into"
            ),
        )
    )


def messages_yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse messages over seven years, from `orders`."""
    chat = (F.col("o_custkey") % 50).cast("string")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.lit("orders").alias("source"),
        chat.alias("chat_id"),
        F.concat(F.lit("chat-"), chat).alias("chat_name"),
        F.lit("direct").alias("chat_kind"),
        _null("string").alias("contact_id"),
        (F.col("o_orderkey") % 2 == 0).alias("is_from_me"),
        _order_ts().alias("ts"),
        _null("string").alias("text"),
        F.lit("text").alias("kind"),
    )


def _order_ts() -> Column:
    return _ts(F.timestamp_add("SECOND", (F.col("o_orderkey") % 86400).cast("int"), "o_orderdate"))


def messages_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with text, from `conversations`."""
    conv = F.col("conv_id").cast("string")
    start = F.lit("2023-01-01 00:00:00").cast("timestamp_ntz")
    day = F.timestamp_add("DAY", F.col("conv_id").cast("int"), start)
    return table(spark, sf_dir, "conversations").select(
        F.concat(conv, F.lit("-"), F.col("turn").cast("string")).alias("id"),
        F.lit("conversations").alias("source"),
        conv.alias("chat_id"),
        F.concat(F.lit("conv-"), conv).alias("chat_name"),
        F.lit("direct").alias("chat_kind"),
        _null("string").alias("contact_id"),
        (F.col("role") == "user").alias("is_from_me"),
        _ts(F.timestamp_add("MINUTE", F.col("turn").cast("int"), day)).alias("ts"),
        "text",
        F.when(F.col("role") == "system", "system").otherwise("text").alias("kind"),
    )


def documents_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one of my text messages, a day apart, with an emoji added to some."""
    start = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    cry = F.when(F.col("doc_id") % 3 == 0, " \U0001F44D\U0001F3FD ok").when(
        F.col("doc_id") % 3 == 1, " ❤️ \U0001F1F7\U0001F1F4"
    )
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        F.lit("documents").alias("source"),
        F.col("source").alias("chat_id"),
        F.col("source").alias("chat_name"),
        F.lit("direct").alias("chat_kind"),
        _null("string").alias("contact_id"),
        F.lit(True).alias("is_from_me"),
        _ts(F.timestamp_add("DAY", (F.col("doc_id") % 1500).cast("int"), start)).alias("ts"),
        F.concat("text", F.coalesce(cry, F.lit(""))).alias("text"),
        F.lit("text").alias("kind"),
    )


def media_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plays, from `lineitem` and `part`."""
    hour = ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3) % 24).cast("int")
    lines = table(spark, sf_dir, "lineitem")
    return lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        _ts(F.timestamp_add("HOUR", hour, "l_shipdate")).alias("ts"),
        F.when(F.col("l_linestatus") == "F", "track").otherwise("episode").alias("media_kind"),
        F.col("p_brand").alias("artist"),
        F.col("p_name").alias("track"),
        (F.col("l_quantity") * 6000).cast("bigint").alias("ms_played"),
        F.when(F.col("l_returnflag") == "R", True)
        .when(F.col("l_returnflag") == "A", False)
        .alias("skipped"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank rows, from `orders` and `customer`."""
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    code, slot = F.col("o_custkey") % 10, F.col("o_custkey") % 40
    kinds = F.create_map(
        *(F.lit(x) for pair in zip("12345", ("card", "transfer", "fee", "refund", "topup")) for x in pair)
    )
    joined = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    return joined.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.lit("orders").alias("source"),
        _order_ts().alias("ts"),
        F.when(F.col("o_orderstatus") == "P", amount).otherwise(-amount).alias("amount"),
        F.when(code < 6, "EUR").when(code < 9, "USD").otherwise("RON").alias("currency"),
        F.when(slot == 7, "Glovo 24")
        .when(slot == 11, "uber eats")
        .when(slot != 13, F.concat(F.lit("M"), slot.cast("string")))
        .alias("merchant"),
        F.concat(F.lit("raw "), slot.cast("string")).alias("merchant_raw"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("category"),
        F.concat(F.lit("acct:"), F.col("o_custkey").cast("string")).alias("account"),
        F.element_at(kinds, F.substring("o_orderpriority", 1, 1)).alias("kind"),
        F.col("c_name").alias("counterparty"),
        _null("string").alias("contact_id"),
    )


def charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve charges per supplier, 30 days apart; even suppliers raise the price by 20%.

    Every seventh supplier charges at random-looking days and is not recurring.
    """
    n = F.col("n")
    step = F.when(F.col("s_suppkey") % 7 == 3, n * ((F.col("s_suppkey") + n) % 11 + 1)).otherwise(n * 30)
    # Cents are rounded as the SQL does it: Spark's own round to two places goes by the written digits of the double.
    price = (F.round((F.abs(F.col("s_acctbal")) / 100 + 1) * 100) / 100).cast("decimal(18,2)")
    raised = F.when(
        (F.col("s_suppkey") % 2 == 0) & (n >= 6), (price * F.lit(1.2).cast("decimal(3,1)")).cast("decimal(18,2)")
    ).otherwise(price)
    start = F.lit("1999-01-01 12:00:00").cast("timestamp_ntz")
    rows = table(spark, sf_dir, "supplier").withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(11))))
    return rows.select(
        F.concat(F.col("s_suppkey").cast("string"), F.lit("-"), n.cast("string")).alias("id"),
        F.lit("supplier").alias("source"),
        _ts(F.timestamp_add("DAY", step.cast("int"), start)).alias("ts"),
        (-raised).cast("decimal(18,2)").alias("amount"),
        F.lit("EUR").alias("currency"),
        F.col("s_name").alias("merchant"),
        F.col("s_name").alias("merchant_raw"),
        _null("string").alias("category"),
        F.lit("card").alias("kind"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """App events, from `events`."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.lit("events").alias("source"),
        _ts(F.col("ts")).alias("ts"),
        F.concat(F.lit("app."), "event_type").alias("kind"),
        F.col("props").alias("title"),
        _null("string").alias("url"),
    )


# ---- the same views for DuckDB ------------------------------------------------------------------

_ORDER_TS = "o_orderdate + to_seconds(o_orderkey % 86400)"

VIEWS = {
    "messages": """messages AS (SELECT CAST(event_id AS VARCHAR) AS id, 'events' AS source,
        CAST(user_id AS VARCHAR) AS chat_id, 'user-' || user_id AS chat_name,
        CASE WHEN user_id % 5 = 0 THEN 'group' ELSE 'direct' END AS chat_kind,
        'c' || user_id AS sender_id,
        CASE WHEN user_id % 3 <> 0 THEN 'c' || user_id END AS contact_id,
        event_type IN ('click', 'purchase') AS is_from_me, ts, CAST(NULL AS VARCHAR) AS text,
        CASE WHEN event_type = 'error' THEN 'system' ELSE 'text' END AS kind FROM events)""",
    "contacts": """contacts AS (SELECT DISTINCT 'c' || user_id AS id,
        'Person ' || (user_id % 40) AS display_name,
        CASE WHEN user_id % 4 <> 0 THEN 'c' || (user_id - 1) END AS merged_into FROM events)""",
    "messages_yearly": f"""messages AS (SELECT CAST(o_orderkey AS VARCHAR) AS id,
        'orders' AS source, CAST(o_custkey % 50 AS VARCHAR) AS chat_id,
        'chat-' || (o_custkey % 50) AS chat_name, 'direct' AS chat_kind,
        CAST(NULL AS VARCHAR) AS contact_id, o_orderkey % 2 = 0 AS is_from_me,
        {_ORDER_TS} AS ts, CAST(NULL AS VARCHAR) AS text, 'text' AS kind FROM orders)""",
    "messages_text": """messages AS (SELECT conv_id || '-' || turn AS id,
        'conversations' AS source, CAST(conv_id AS VARCHAR) AS chat_id,
        'conv-' || conv_id AS chat_name, 'direct' AS chat_kind,
        CAST(NULL AS VARCHAR) AS contact_id, role = 'user' AS is_from_me,
        TIMESTAMP '2023-01-01' + to_days(CAST(conv_id AS INT)) + to_minutes(turn) AS ts, text,
        CASE WHEN role = 'system' THEN 'system' ELSE 'text' END AS kind FROM conversations)""",
    "documents_text": """messages AS (SELECT CAST(doc_id AS VARCHAR) AS id,
        'documents' AS source, source AS chat_id, source AS chat_name, 'direct' AS chat_kind,
        CAST(NULL AS VARCHAR) AS contact_id, true AS is_from_me,
        TIMESTAMP '2020-01-01' + to_days(CAST(doc_id % 1500 AS INT)) AS ts,
        text || CASE doc_id % 3 WHEN 0 THEN ' \U0001F44D\U0001F3FD ok'
            WHEN 1 THEN ' ❤️ \U0001F1F7\U0001F1F4' ELSE '' END AS text,
        'text' AS kind FROM documents)""",
    "media_plays": """media_plays AS (SELECT
        l_shipdate + to_hours((l_orderkey * 7 + l_linenumber * 3) % 24) AS ts,
        CASE WHEN l_linestatus = 'F' THEN 'track' ELSE 'episode' END AS media_kind,
        p_brand AS artist, p_name AS track, CAST(l_quantity * 6000 AS BIGINT) AS ms_played,
        CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END AS skipped
        FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "transactions": f"""transactions AS (SELECT CAST(o_orderkey AS VARCHAR) AS id,
        'orders' AS source, {_ORDER_TS} AS ts,
        CASE WHEN o_orderstatus = 'P' THEN 1 ELSE -1 END
            * CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
        CASE WHEN o_custkey % 10 < 6 THEN 'EUR' WHEN o_custkey % 10 < 9 THEN 'USD'
            ELSE 'RON' END AS currency,
        CASE WHEN o_custkey % 40 = 7 THEN 'Glovo 24' WHEN o_custkey % 40 = 11 THEN 'uber eats'
            WHEN o_custkey % 40 <> 13 THEN 'M' || (o_custkey % 40) END AS merchant,
        'raw ' || (o_custkey % 40) AS merchant_raw,
        CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS category,
        'acct:' || o_custkey AS account,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'card' WHEN '2' THEN 'transfer'
            WHEN '3' THEN 'fee' WHEN '4' THEN 'refund' ELSE 'topup' END AS kind,
        c_name AS counterparty
        FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "charges": """charge_rows AS (SELECT *, unnest(range(0, 12)) AS n FROM supplier),
        charge_prices AS (SELECT *,
            CAST(round(abs(s_acctbal) / 100 + 1, 2) AS DECIMAL(18,2)) AS price FROM charge_rows),
        transactions AS (SELECT s_suppkey || '-' || n AS id, 'supplier' AS source,
        TIMESTAMP '1999-01-01 12:00:00' + to_days(CAST(CASE WHEN s_suppkey % 7 = 3
            THEN n * ((s_suppkey + n) % 11 + 1) ELSE n * 30 END AS INT)) AS ts,
        -CASE WHEN s_suppkey % 2 = 0 AND n >= 6
            THEN CAST(price * CAST(1.2 AS DECIMAL(3,1)) AS DECIMAL(18,2))
            ELSE price END AS amount,
        'EUR' AS currency, s_name AS merchant, s_name AS merchant_raw,
        CAST(NULL AS VARCHAR) AS category, 'card' AS kind FROM charge_prices)""",
    "events": """app_events AS (SELECT CAST(event_id AS VARCHAR) AS id, 'events' AS source, ts,
        'app.' || event_type AS kind, props AS title FROM events)""",
}


def with_views(*names: str) -> str:
    """`WITH RECURSIVE view, view, ` ready for further CTEs."""
    return "WITH RECURSIVE " + ",\n".join(VIEWS[name] for name in names) + ",\n"
