"""Registered queries of the table services, the yearly composites and whole imports."""

from __future__ import annotations

from datetime import date
from uuid import uuid4

from pyspark.sql import functions as F

from chronicle.operators import ingest, money, services
from chronicle.params import Params
from chronicle.plans import adapters as A
from chronicle.plans import exports as X
from chronicle.plans import registry, yearly
from chronicle.plans.ingestion import _STATEMENTS
from chronicle.plans.insights import _INCOME, _SPEND
from chronicle.plans.query import register, rounded
from chronicle.session import checkpoint_folder
from chronicle.sources import bank, shell
from chronicle.streaming.incremental import incremental_ingest


def _tables(s, d):
    return {
        "messages": A.messages_yearly(s, d),
        "media_plays": A.media_plays(s, d),
        "transactions": A.transactions(s, d),
        "events": A.events(s, d),
    }


_VIEWS = ("messages_yearly", "media_plays", "transactions", "events")
register(
    "table_profile",
    lambda s, d: services.table_profile({**_tables(s, d), "contacts": A.contacts(s, d)}).select(
        "table", "rows", F.unix_micros("min_ts").alias("min_ts"), F.unix_micros("max_ts").alias("max_ts")
    ),
    A.with_views(*_VIEWS, "contacts").rstrip(",\n") + """
    SELECT 'messages' AS "table", count(*) AS rows, epoch_us(min(ts)) AS min_ts, epoch_us(max(ts)) AS max_ts FROM messages
    UNION ALL SELECT 'media_plays', count(*), epoch_us(min(ts)), epoch_us(max(ts)) FROM media_plays
    UNION ALL SELECT 'transactions', count(*), epoch_us(min(ts)), epoch_us(max(ts)) FROM transactions
    UNION ALL SELECT 'events', count(*), epoch_us(min(ts)), epoch_us(max(ts)) FROM app_events
    UNION ALL SELECT 'contacts', count(*), NULL, NULL FROM contacts""",
)
register(
    "bounded_preview",
    lambda s, d: services.bounded_preview(
        A.table(s, d, "documents").select(
            "doc_id", "text", F.when(F.col("doc_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("n_chars") / 2).alias("half")
        ).orderBy("doc_id")
    ),
    """SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 499) || '…' ELSE text END AS text,
        CASE WHEN doc_id % 3 <> 0 THEN n_chars / 2 END AS half, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS non_finite,
        length(text) > 500 AS cut, (SELECT count(*) FROM documents) AS row_count,
        length(text) > 500 OR (SELECT count(*) FROM documents) > 200 AS truncated
    FROM documents ORDER BY doc_id LIMIT 200""",
)
_QUESTION = """WITH big AS (SELECT o_custkey, trim(o_orderpriority) AS p, o_totalprice FROM {orders})
    SELECT split_part(p, '-', 2) AS priority, count(*) FILTER (WHERE o_totalprice > 1000) AS large,
        round(max(o_totalprice), 1) AS top FROM big GROUP BY split_part(p, '-', 2)"""


def _question(s, d):
    """The statement through the guard, the row limit and the time limit."""
    A.table(s, d, "orders").createOrReplaceTempView("chronicle_orders")
    sql = _QUESTION.format(orders="chronicle_orders") + " ORDER BY priority -- a remark"
    found = services.bounded_query(s, sql, limit=4, seconds=120)
    rows = [(*row, found.truncated) for row in found.rows]
    return s.createDataFrame(rows, "priority string, large bigint, top double, truncated boolean")


register(
    "bounded_query",
    _question,
    f"""SELECT *, (SELECT count(DISTINCT split_part(trim(o_orderpriority), '-', 2)) FROM orders) > 4 AS truncated
    FROM ({_QUESTION.format(orders="orders")} ORDER BY priority LIMIT 4)""",
)


def _export(s, d):
    """What is read back from both formats: the plain columns and a nested one."""
    rows = A.table(s, d, "conversations").withColumn("words", F.split("text", " "))
    parts = []
    for fmt in ("csv", "parquet"):
        path = f"{checkpoint_folder(s)}/export-{uuid4().hex}"
        written = services.export_table(rows, path, fmt)
        read = s.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path) if fmt == "csv" else s.read.parquet(path)
        words = F.from_json("words", "array<string>") if fmt == "csv" else F.col("words")
        parts.append(
            read.select(
                F.lit(fmt).alias("format"), F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                "role", "text", F.array_join(words, "|").alias("words"), F.lit(written).cast("bigint").alias("rows"),
            )
        )
    return parts[0].unionByName(parts[1])


register(
    "export_table",
    _export,
    """SELECT format, conv_id, turn, role, text, array_to_string(string_split(text, ' '), '|') AS words,
        (SELECT count(*) FROM conversations) AS rows FROM conversations, (SELECT unnest(['csv', 'parquet']) AS format)""",
)


def _availability(s, d):
    """Which operators have data when there are no transactions."""
    tables = {**_tables(s, d), "transactions": A.transactions(s, d).limit(0)}
    found = {spec.id for spec in registry.available(tables)}
    rows = [(name, spec.title, name in found) for name, spec in registry.operators().items()]
    return s.createDataFrame(rows, "id string, title string, available boolean")


register(
    "operator_registry",
    _availability,
    """WITH known(id, title, needs) AS (VALUES
        ('cross.life_timeline', 'Life timeline', ''), ('cross.messages_vs_youtube', 'Messages versus YouTube', 'me'),
        ('cross.soundtrack', 'Soundtrack of a period', 'p'), ('cross.spend_vs_listening', 'Spend versus listening', 'tp'),
        ('messages.activity_heatmap', 'Activity by local hour', 'm'), ('messages.conversation_starters', 'Conversation starters', 'm'),
        ('messages.emoji_words', 'Your emoji and words by year', 'm'), ('messages.response_times', 'Reply times', 'm'),
        ('messages.streaks_silences', 'Streaks and silences', 'm'), ('messages.top_contacts_by_year', 'Top contacts by year', 'm'),
        ('messages.volume_by_contact', 'Message volume by contact', 'm'), ('money.delivery_index', 'Delivery index', 't'),
        ('money.income_vs_spend', 'Income and spending', 't'), ('money.spend_by_category', 'Spending by category', 't'),
        ('money.subscriptions', 'Recurring subscriptions', 't'), ('money.weekday_weekend', 'Weekday and weekend spending', 't'),
        ('music.discovery_rate', 'New artist discovery', 'p'), ('music.listening_minutes', 'Listening time', 'p'),
        ('music.seasonality', 'Seasonal listening', 'p'), ('music.skips_obsessions', 'Skips and obsessions', 'p'),
        ('music.top_artists_by_year', 'Top artists by year', 'p')),
    filled AS (SELECT (SELECT count(*) FROM orders) > 0 AS m, (SELECT count(*) FROM lineitem) > 0 AS p, (SELECT count(*) FROM events) > 0 AS e)
    SELECT id, title, NOT contains(needs, 't') AND (NOT contains(needs, 'm') OR m) AND (NOT contains(needs, 'p') OR p)
        AND (NOT contains(needs, 'e') OR e) AS available FROM known, filled""",
)


def _imports(s, d):
    """The same statements imported twice into a new warehouse."""
    warehouse = f"{checkpoint_folder(s)}/warehouse-{uuid4().hex}"
    rows, _ = bank.transactions_from_csv(X.statement_lines(s, d))
    for run in ("first", "second"):
        ingest.run_import(rows, "transactions", warehouse, "bank_csv", import_id=run)
    ledger = ingest.imports(s.read.parquet(f"{warehouse}/imports"))
    return ledger.select("id", "connector", "status", "rows_seen", "rows_inserted")


register(
    "run_import",
    _imports,
    _STATEMENTS + """ SELECT unnest(['first', 'second']) AS id, 'bank_csv' AS connector, 'succeeded' AS status,
        count(*) AS rows_seen, unnest([count(DISTINCT (mapping, account, ts, amount, currency, merchant_raw, balance, occurrence)), 0])
        AS rows_inserted FROM copies""",
)

def _passes(s, d):
    """Orders as command histories that arrive in two overlapping batches of files; the stream runs after each."""
    base = f"{checkpoint_folder(s)}/stream-{uuid4().hex}"
    orders = A.table(s, d, "orders").withColumn("k", F.col("o_orderkey"))
    line = F.concat(F.lit("#"), (F.lit(1700000000) + F.col("k")).cast("string"), F.lit("\norder "), F.col("k").cast("string"))
    for wave, left_out in (("first", 0), ("second", 1)):
        orders.filter(f"k % 3 <> {left_out}").select(line.alias("value")).write.text(f"{base}/in/{wave}")
        incremental_ingest(
            s, f"{base}/in", lambda pieces: shell.shell_events(pieces)[0], "events", f"{base}/warehouse", f"{base}/checkpoint", "shell_history"
        ).awaitTermination()
    runs = ingest.imports(s.read.parquet(f"{base}/warehouse/imports")).agg(
        F.sum("rows_seen").alias("seen"), F.sum("rows_inserted").alias("inserted"), F.count("*").alias("passes")
    )
    stored = s.read.parquet(f"{base}/warehouse/events").select("title", F.unix_seconds("ts").alias("at"))
    return stored.crossJoin(F.broadcast(runs))


register(
    "incremental_ingest",
    _passes,
    """SELECT 'order ' || o_orderkey AS title, 1700000000 + o_orderkey AS at, 2 AS passes, (SELECT count(*) FROM orders)::BIGINT AS inserted,
        (SELECT sum((o_orderkey % 3 <> 0)::INT + (o_orderkey % 3 <> 1)::INT) FROM orders)::BIGINT AS seen FROM orders""",
)

# ---- yearly -----------------------------------------------------------------------------------

# The events of the tables are years later than everything else.
UNTIL = Params(date_to=date(2000, 12, 31))
_COMPARED = ("messages.activity_heatmap", "money.income_vs_spend", "music.discovery_rate", "music.listening_minutes")


def _compared(s, d, ids=_COMPARED):
    known = registry.operators()
    return yearly.year_over_year(s, _tables(s, d), UNTIL, [known[i] for i in ids])


_YEARLY = A.with_views(*_VIEWS) + f"""span AS (SELECT greatest((SELECT max(ts) FROM messages), (SELECT max(ts) FROM media_plays),
        (SELECT max(ts) FROM transactions), (SELECT max(ts) FROM app_events)) AS m),
    capped AS (SELECT least(m::DATE, DATE '2000-12-31') AS m FROM span),
    yr AS (SELECT year(m) - CASE WHEN month(m) = 12 AND day(m) = 31 THEN 0 ELSE 1 END AS y FROM capped),
    years AS (SELECT unnest([y, y - 1]) AS yy, y FROM yr),
    cur AS (SELECT currency FROM transactions, yr WHERE year(ts) BETWEEN y - 1 AND y GROUP BY currency
        ORDER BY count(*) DESC, currency LIMIT 1),
    firsts AS (SELECT artist, date_trunc('month', min(ts)) AS f FROM media_plays GROUP BY artist),
    discovery AS (SELECT date_trunc('month', ts) AS b, count(*) FILTER (WHERE f = date_trunc('month', ts)) / count(*) AS r
        FROM media_plays JOIN firsts USING (artist) GROUP BY b),
    monthly AS (SELECT date_trunc('month', ts) AS b, sum({_INCOME})::DOUBLE AS i, sum({_SPEND})::DOUBLE AS s
        FROM transactions WHERE currency = (SELECT currency FROM cur) GROUP BY b),
    heads AS (
        SELECT 'messages.activity_heatmap' AS dig_id, 'Night-owl index' AS label, 'Activity by local hour' AS dig_title, '%' AS unit,
            year(ts) AS yy, round(100.0 * count(*) FILTER (WHERE hour(ts) < 5) / count(*), 1) AS v FROM messages WHERE is_from_me GROUP BY year(ts)
        UNION ALL SELECT 'music.listening_minutes', 'Listening time', 'Listening time', 'hours', year(ts), round(sum(ms_played) / 60000.0 / 60, 1) FROM media_plays GROUP BY year(ts)
        UNION ALL SELECT 'music.discovery_rate', 'Average monthly discovery', 'New artist discovery', '%', year(b), round(100 * avg(r), 1) FROM discovery GROUP BY year(b)
        UNION ALL SELECT 'money.income_vs_spend', 'Average savings rate', 'Income and spending', '%', year(b), round(100 * avg((i - s) / nullif(i, 0)), 1) FROM monthly GROUP BY year(b)),
    pairs AS (SELECT a.dig_id, a.label, a.dig_title, CASE WHEN a.unit = '%' THEN 'pp' ELSE '%' END AS delta_unit, a.unit,
        a.v::DOUBLE AS this_year, b.v::DOUBLE AS last_year, CASE WHEN a.unit = '%' THEN a.v - b.v ELSE (a.v - b.v) / abs(nullif(b.v, 0)) * 100 END AS delta,
        y AS year, y - 1 AS previous_year FROM yr JOIN heads a ON a.yy = y JOIN heads b ON b.yy = y - 1 AND b.dig_id = a.dig_id
        WHERE a.v IS NOT NULL AND b.v IS NOT NULL)"""
register(
    "year_over_year",
    lambda s, d: rounded(_compared(s, d), "delta_pct"),
    _YEARLY + """ SELECT dig_id, label, dig_title, delta_unit, 4 - (SELECT count(*) FROM pairs) AS skipped_digs, unit, this_year,
        last_year, round(delta, 6) AS delta_pct, year, previous_year FROM pairs""",
)
# The other headlines for both years. No merchant of the tables recurs within a year, so subscriptions have none;
# an obsession's headline names its week and never compares.
_MORE = f"""
    chats AS (SELECT *, year(ts) AS yy, coalesce(contact_id, chat_name, 'Unknown') AS who FROM messages
        WHERE kind <> 'system' AND chat_kind = 'direct'),
    nth AS (SELECT *, row_number() OVER (PARTITION BY yy, source, chat_id ORDER BY ts, id) AS place FROM chats),
    pairs_of AS (SELECT a.yy, a.is_from_me AS mine, b.is_from_me AS theirs, epoch_us(a.ts) - epoch_us(b.ts) AS us
        FROM nth a LEFT JOIN nth b ON b.yy = a.yy AND b.source = a.source AND b.chat_id = a.chat_id AND b.place = a.place - 1),
    active AS (SELECT DISTINCT yy, who, ts::DATE AS d FROM chats),
    islands AS (SELECT yy, count(*) AS n FROM (SELECT yy, who, d - CAST(row_number() OVER (PARTITION BY yy, who ORDER BY d) AS INTEGER) AS g
        FROM active) GROUP BY yy, who, g),
    busiest AS (SELECT yy, min(coalesce(chat_name, 'Unknown')) AS label, count(*) AS n FROM chats GROUP BY yy, who
        QUALIFY row_number() OVER (PARTITION BY yy ORDER BY n DESC, label) = 1),
    paid AS (SELECT *, year(ts) AS yy, {_SPEND} AS spent, regexp_matches(category, '{money.DELIVERY_CATEGORY}')
        OR regexp_matches(coalesce(merchant, merchant_raw), '{money.DELIVERY_MERCHANT}') AS food
        FROM transactions WHERE currency = (SELECT currency FROM cur)),
    kinds_of AS (SELECT yy, coalesce(category, 'Uncategorised') AS label, sum(spent)::DOUBLE AS v FROM paid
        WHERE kind = 'refund' OR amount < 0 AND kind NOT IN ('exchange', 'topup') GROUP BY yy, label
        QUALIFY row_number() OVER (PARTITION BY yy ORDER BY sum(spent) DESC, label) = 1),
    calendar AS (SELECT yy, unnest(generate_series(make_timestamp(yy, 1, 1, 0, 0, 0), make_timestamp(yy, 12, 31, 0, 0, 0), INTERVAL 1 DAY))::DATE AS d FROM years),
    daily AS (SELECT ts::DATE AS d, sum(spent) AS s FROM paid GROUP BY 1),
    sides AS (SELECT yy, isodow(d) > 5 AS weekend, sum(coalesce(s, 0))::DOUBLE / count(*) AS v FROM calendar LEFT JOIN daily USING (d) GROUP BY ALL),
    food_months AS (SELECT yy, month(ts) AS m, 100 * coalesce(sum(spent) FILTER (food), 0)::DOUBLE / nullif(sum(spent), 0)::DOUBLE AS v FROM paid GROUP BY ALL),
"""
_OTHERS = """
        UNION ALL SELECT 'messages.volume_by_contact', label, 'Message volume by contact', 'messages', yy, n FROM busiest
        UNION ALL SELECT 'messages.response_times', 'Your median reply', 'Reply times', 'minutes', yy, round(quantile_cont(us, 0.5) / 6e7, 1) FROM pairs_of
            WHERE mine AND NOT theirs AND us <= 86400000000 GROUP BY yy
        UNION ALL SELECT 'messages.conversation_starters', 'Conversations you started', 'Conversation starters', '%', yy,
            round(100.0 * sum(mine::INT) / count(*), 1) FROM pairs_of WHERE us IS NULL OR us >= 21600000000 GROUP BY yy
        UNION ALL SELECT 'messages.streaks_silences', 'Longest streak', 'Streaks and silences', 'days', yy, max(n) FROM islands GROUP BY yy
        UNION ALL SELECT 'money.spend_by_category', label, 'Spending by category', (SELECT currency FROM cur), yy, v FROM kinds_of
        UNION ALL SELECT 'money.weekday_weekend', 'Weekend minus weekday day', 'Weekday and weekend spending', (SELECT currency FROM cur), yy,
            round(max(v) FILTER (weekend) - max(v) FILTER (NOT weekend), 2) FROM sides GROUP BY yy
        UNION ALL SELECT 'money.delivery_index', 'Latest delivery share', 'Delivery index', '%', yy, round(arg_max(v, m), 1) FROM food_months GROUP BY yy),
    pairs AS ("""
_EVERY = (
    _YEARLY.replace("    heads AS (", _MORE + "    heads AS (", 1)
    .replace("),\n    pairs AS (", _OTHERS, 1)
    .replace("b.dig_id = a.dig_id", "b.dig_id = a.dig_id AND b.label = a.label")
)
register(
    "year_over_year_all",
    lambda s, d: rounded(
        yearly.year_over_year(s, _tables(s, d), UNTIL).select("dig_id", "label", "this_year", "last_year", "delta_pct"),
        "this_year", "last_year", "delta_pct", places=4,
    ),
    _EVERY + """ SELECT dig_id, label, round(this_year, 4) AS this_year, round(last_year, 4) AS last_year, round(delta, 4) AS delta_pct FROM pairs""",
)
register(
    "year_summary",
    lambda s, d: rounded(
        yearly.year_summary({k: v for k, v in _tables(s, d).items() if k != "transactions"}, 1998, Params(), names=True), "value"
    ),
    A.with_views("messages_yearly", "media_plays", "events") + """
    m AS (SELECT * FROM messages WHERE year(ts) = 1998), p AS (SELECT * FROM media_plays WHERE year(ts) = 1998),
    people AS (SELECT chat_name AS contact, count(*) AS n FROM m GROUP BY chat_name ORDER BY n DESC, contact LIMIT 3),
    busy AS (SELECT hour(ts) AS h, count(*) AS n FROM m WHERE is_from_me GROUP BY h ORDER BY n DESC, h LIMIT 1),
    night AS (SELECT round(100.0 * count(*) FILTER (WHERE hour(ts) < 5) / count(*), 1) AS v FROM m WHERE is_from_me),
    tracks AS (SELECT artist, track, sum(ms_played) AS ms FROM p WHERE media_kind = 'track' GROUP BY ALL),
    artists AS (SELECT artist, sum(ms) AS ms FROM tracks GROUP BY artist)
    SELECT 'numbers' AS section, 'messages' AS metric, NULL AS label, count(*)::DOUBLE AS value, 'messages' AS unit FROM m
    UNION ALL SELECT 'circle', 'contact', contact, n, 'messages' FROM people
    UNION ALL SELECT 'circle', 'contact_share', contact, round(n / (SELECT count(*) FROM m), 6), 'share' FROM people
    UNION ALL SELECT 'rhythm', 'busiest_hour', NULL, h, 'hour' FROM busy
    UNION ALL (SELECT 'rhythm', 'busiest_weekday', NULL, isodow(ts), 'weekday' FROM m WHERE is_from_me GROUP BY isodow(ts)
        ORDER BY count(*) DESC, isodow(ts) LIMIT 1)
    UNION ALL SELECT 'rhythm', 'night_share', CASE WHEN v >= 15 OR h >= 23 OR h < 4 THEN 'Night owl, confirmed'
        WHEN h BETWEEN 5 AND 9 THEN 'Early riser' ELSE 'Your rhythm' END, v, '%' FROM night, busy
    UNION ALL SELECT 'numbers', 'listening', NULL, round(sum(ms_played) / 60000.0 / 60, 1), 'hours' FROM p
    UNION ALL (SELECT 'soundtrack', 'top_artist', artist, round(ms / 60000.0 / 60, 6), 'hours' FROM artists ORDER BY ms DESC, artist LIMIT 1)
    UNION ALL (SELECT 'soundtrack', 'top_track', track || ' · ' || artist, round(ms / 60000.0 / 60, 6), 'hours' FROM tracks
        ORDER BY ms DESC, artist, track LIMIT 1)
    UNION ALL (SELECT 'soundtrack', 'peak_month', NULL, month(ts), 'month' FROM p GROUP BY month(ts)
        ORDER BY sum(ms_played) DESC, month(ts) LIMIT 1)""",
)
register(
    "year_summary_money",
    lambda s, d: rounded(
        yearly.year_summary({"transactions": A.transactions(s, d)}, 1998, Params(currency="EUR"), amounts=True), "value", places=4
    ),
    A.with_views("transactions") + f"""
    t AS (SELECT *, regexp_matches(coalesce(merchant, merchant_raw), '(?i)\\b(glovo|uber eats)\\b') AS food FROM transactions
        WHERE currency = 'EUR' AND year(ts) IN (1997, 1998)),
    totals AS (SELECT sum({_SPEND})::DOUBLE AS s, sum(CASE WHEN food THEN {_SPEND} ELSE 0 END)::DOUBLE AS f FROM t WHERE year(ts) = 1998),
    monthly AS (SELECT date_trunc('month', ts) AS b, sum({_INCOME})::DOUBLE AS i, sum({_SPEND})::DOUBLE AS s FROM t GROUP BY b),
    rates AS (SELECT year(b) AS y, round(100 * avg((i - s) / nullif(i, 0)), 1) AS r FROM monthly GROUP BY year(b)),
    cadence AS (SELECT merchant, median(gap) AS g FROM (SELECT coalesce(merchant, merchant_raw) AS merchant, date_diff('day',
        lag(ts::DATE) OVER (PARTITION BY coalesce(merchant, merchant_raw) ORDER BY ts, id), ts::DATE) AS gap
        FROM t WHERE year(ts) = 1998 AND amount < 0 AND kind <> 'topup') GROUP BY merchant HAVING count(*) >= 3)
    SELECT 'numbers' AS section, 'transactions' AS metric, NULL AS label, count(*)::DOUBLE AS value, 'transactions' AS unit
        FROM transactions WHERE year(ts) = 1998
    UNION ALL SELECT 'money', 'active_subscriptions', NULL, 0, 'subscriptions'
    UNION ALL SELECT 'money', 'subscription_cost', NULL, 0, 'EUR'
    UNION ALL SELECT 'money', 'delivery_share', NULL, round(least(greatest(f / s, 0), 1), 4), 'share' FROM totals WHERE s > 0
    UNION ALL SELECT 'money', 'delivery_spend', NULL, round(f, 4), 'EUR' FROM totals WHERE s > 0
    UNION ALL SELECT 'money', 'savings_rate', NULL, r, '%' FROM rates WHERE y = 1998
    UNION ALL SELECT 'money', 'savings_change', 'last year', round(a.r - b.r, 4), 'points' FROM rates a, rates b WHERE a.y = 1998 AND b.y = 1997""",
)
