"""Exact results on tiny hand-made facts: boundaries, ties, zones and clock changes."""

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from chronicle import Params
from chronicle.operators import cross, messages, money, plays
from chronicle.plans import registry, yearly

ZONE = "Europe/Bucharest"


@pytest.fixture
def chat(spark):
    """Build messages from (chat, minutes or instant, mine, ...) rows."""

    def build(rows, **defaults):
        out = []
        for n, row in enumerate(rows):
            row = {**dict(chat="A", name=None, kind="text", chat_kind="direct", text=None, contact=None, me=True), **defaults, **row}
            at = row["at"] if isinstance(row["at"], datetime) else datetime(2024, 1, 1) + timedelta(minutes=row["at"])
            out.append((f"{n:04}", "s", row["chat"], row["name"] or row["chat"], row["chat_kind"], row["contact"], row["me"], at, row["text"], row["kind"]))
        return spark.createDataFrame(
            out,
            "id string, source string, chat_id string, chat_name string, chat_kind string, contact_id string, "
            "is_from_me boolean, ts timestamp, text string, kind string",
        )

    return build


def test_reply_gap_of_exactly_a_day_counts(chat, rows):
    day = 24 * 60
    sent = [(0, False), (10, False), (30, True), (35, True), (day + 35, False), (2 * day + 35 + 1 / 60, True), (2 * day + 45 + 1 / 60, False)]
    got = rows(messages.response_times(chat([{"at": at, "me": me} for at, me in sent]), Params()))
    assert got == [("A", "them", 725.0, 2), ("A", "you", 20.0, 1)]


def test_conversation_starts_after_six_hours(chat, rows):
    df = chat([
        {"at": 0}, {"at": 6 * 60 - 1 / 60, "me": False}, {"at": 12 * 60 - 1 / 60, "me": False},
        {"at": 24 * 60, "chat": "B"},
    ])
    got = rows(messages.conversation_starters(df, Params(top_n=1)))
    assert got == [("A", 2, 1, 0.5, 2 / 3)]


def test_heatmap_on_clock_change_days(chat, rows):
    spring, autumn = datetime(2024, 3, 31), datetime(2024, 10, 27)
    df = chat([
        {"at": spring.replace(hour=0, minute=30)}, {"at": spring.replace(hour=1, minute=30)},
        {"at": autumn.replace(hour=0, minute=30), "chat_kind": "group"}, {"at": autumn.replace(hour=1, minute=30)},
        {"at": autumn.replace(hour=3, minute=30)},
    ])
    assert rows(messages.activity_heatmap(df, Params(tz=ZONE))) == [(2, 7, 1), (3, 7, 2), (4, 7, 1), (5, 7, 1)]
    assert rows(messages.night_share(df, Params(tz=ZONE)), "value") == [(80.0,)]


def test_streaks_count_local_days(chat, rows):
    local = [(2024, 3, 30, 12), (2024, 3, 30, 23), (2024, 3, 31, 21), (2024, 4, 1, 9), (2024, 4, 6, 9)]
    df = chat([{"at": datetime(*at)} for at in local])
    assert rows(messages.streaks_silences(df, Params(tz=ZONE))) == [("A", 3, 5)]


def test_tokens(chat, rows):
    df = chat([
        {"at": 0, "text": "Café café https://example.com/word the 👍🏽 👨‍👩‍👧"}, {"at": 1, "text": "pădure PĂDURE ab 👨‍👩‍👧 👍🏽"},
        {"at": 2, "text": "hidden", "kind": "media"}, {"at": 3, "text": "theirs", "me": False},
    ])
    got = rows(messages.emoji_words(df, Params()))
    emoji = sorted(["👍🏽", "👨‍👩‍👧"])
    assert got == [(2024, "emoji", e, 2) for e in emoji] + [(2024, "word", "café", 2), (2024, "word", "pădure", 2)]
    assert rows(messages.emoji_headline(df, Params()))[0][1] == 2


def test_contacts_follow_chains_and_share_labels(spark, chat, rows):
    contacts = spark.createDataFrame(
        [("old", "x", "middle"), ("middle", "y", "root"), ("root", "Same", None), ("other", "Same", None),
         ("loop1", "l", "loop2"), ("loop2", "l", "loop1"), ("lost", "Lost", "nowhere")],
        "id string, display_name string, merged_into string",
    )
    df = chat([{"at": i, "contact": c, "name": "chat"} for i, c in enumerate(["old", "middle", "root", "other", "loop1", "lost", "gone", None])])
    got = dict(((r[0]), (r[1], r[2])) for r in rows(
        messages.selection(df, Params(), contacts).groupBy("contact_key").agg(F.min("contact"), F.count("*"))))
    assert got == {"root": ("Same", 3), "other": ("Same", 1), "loop1": ("l", 1), "lost": ("Lost", 1), "gone": ("chat", 1), "chat": ("chat", 1)}
    assert rows(messages.volume_by_contact(df, Params(top_n=2, granularity="year"), contacts), "contact", "messages") == [("Same", 3), ("chat", 1)]


def test_biggest_rise_uses_all_ranks(chat, rows):
    def many(name, year, n):
        return [{"chat": name, "at": datetime(year, 5, 1) + timedelta(minutes=i)} for i in range(n)]

    df = chat(sum((many(c, 2020, n) for c, n in zip("ABCDEFG", range(9, 2, -1))), []) + many("G", 2021, 9) + many("A", 2021, 1))
    assert rows(messages.top_contacts_by_year(df, Params()).filter("year = 2020"), "contact") == [(c,) for c in "ABCDE"]
    assert rows(messages.biggest_rise(df, Params())) == [("G", 6)]


def test_ranges_are_inclusive_local_dates(chat, rows):
    df = chat([{"at": datetime(2024, 1, 1, 21, 59)}, {"at": datetime(2024, 1, 1, 22)}, {"at": datetime(2024, 1, 2, 21, 59)}, {"at": datetime(2024, 1, 2, 22)}])
    one = Params(date_from=date(2024, 1, 2), date_to=date(2024, 1, 2), tz=ZONE, granularity="day")
    assert rows(messages.volume_by_contact(df, one)) == [("A", date(2024, 1, 2), 2)]
    west = Params(date_from=date(2024, 1, 1), date_to=date(2024, 1, 1), tz="Pacific/Kiritimati")
    assert messages.selection(df, west).count() == 0


def test_empty_tables_give_empty_results(chat, spark, rows):
    none = chat([])
    for run in (messages.volume_by_contact, messages.response_times, messages.conversation_starters, messages.streaks_silences,
                messages.activity_heatmap, messages.emoji_words, messages.top_contacts_by_year, messages.response_headline, messages.night_share):
        assert rows(run(none, Params())) == [], run


# ---- plays ------------------------------------------------------------------------------------

PLAY = "ts timestamp, media_kind string, artist string, track string, ms_played bigint, skipped boolean"


def test_plays(spark, rows):
    df = spark.createDataFrame(
        [(datetime(2024, 1, 31, 23, 0), "track", "A", "x", 60000, True), (datetime(2024, 2, 1), "episode", None, None, 30000, None),
         (datetime(2024, 2, 2), "video", "V", "v", 1, None), (datetime(2024, 7, 2, 7), "track", "B", "y", 120000, False)], PLAY)
    assert rows(plays.listening_minutes(df, Params(tz=ZONE))) == [(date(2024, 2, 1), 1.5), (date(2024, 7, 1), 2.0)]
    assert rows(plays.discovery_rate(df, Params(date_from=date(2024, 2, 1)))) == [
        (date(2024, 2, 1), 1, 1, 1.0), (date(2024, 7, 1), 1, 1, 1.0)]
    assert rows(plays.skip_rate(df, Params())) == [(date(2024, 1, 1), 1, 1, 1.0), (date(2024, 2, 1), 0, 0, None), (date(2024, 7, 1), 1, 0, 0.0)]
    got = rows(plays.seasonality(df, Params()))
    assert ("season", "winter", "A", 1.0, 2 / 3) in got and ("time", "morning", "B", 2.0, 1.0) in got
    assert rows(plays.seasonality_headline(df, Params()), "artist") == [("B",)]
    assert [r[1:3] for r in rows(plays.soundtrack(df, Params()))] == [("y", "y · B")]
    top = plays.top_artists_by_year(df, Params()).collect()
    assert [(t["artist"], t["rank"]) for t in top[0]["top_tracks"]] == [("B", 1), ("A", 2)]


def test_obsession_needs_more_than_thirty(spark, rows):
    week = datetime(2024, 1, 29)
    df = spark.createDataFrame(
        [(week + timedelta(hours=i), "track", "A", "x", 1, None) for i in range(31)]
        + [(week + timedelta(hours=i), "track", "A", "y", 1, None) for i in range(30)], PLAY)
    got = plays.skips_obsessions(df, Params()).collect()
    assert [(r["bucket"], [tuple(o) for o in r["obsessions"]]) for r in got] == [(date(2024, 1, 1), [("A", "x", date(2024, 1, 29), 31)])]


# ---- money ------------------------------------------------------------------------------------


@pytest.fixture
def bank(spark):
    def build(entries):
        out = []
        for n, row in enumerate(entries):
            row = {**dict(cur="RON", merchant="M", raw="raw", category="c", kind="card"), **row}
            out.append((f"{n:04}", "b", row["at"], Decimal(str(row["amount"])), row["cur"], row["merchant"], row["raw"], row["category"], row["kind"]))
        return spark.createDataFrame(
            out, "id string, source string, ts timestamp, amount decimal(18,2), currency string, merchant string, merchant_raw string, category string, kind string")

    return build


def test_spend_by_category(bank, rows):
    df = bank([
        {"at": datetime(2024, 1, 31, 22, 30), "amount": -100, "merchant": None}, {"at": datetime(2024, 2, 10), "amount": -5, "category": None},
        {"at": datetime(2024, 3, 1), "amount": 20, "kind": "refund", "merchant": None}, {"at": datetime(2024, 2, 1), "amount": -9, "kind": "exchange"},
        {"at": datetime(2024, 2, 1), "amount": 50, "kind": "topup"}, {"at": datetime(2024, 2, 1), "amount": -7, "cur": "EUR"},
    ])
    got = money.spend_by_category(df, Params(tz=ZONE)).collect()
    assert [(r["bucket"], r["category"], r["spend"]) for r in got] == [
        (date(2024, 2, 1), "Uncategorised", Decimal(5)), (date(2024, 2, 1), "c", Decimal(100)), (date(2024, 3, 1), "c", Decimal(-20))]
    assert [tuple(m) for m in got[0]["top_merchants"]] == [("raw", Decimal(80)), ("M", Decimal(5))]
    assert rows(money.dominant_currency(df, Params())) == [("RON",)]


def test_savings(bank, rows):
    df = bank([
        {"at": datetime(2024, 1, 1), "amount": 100}, {"at": datetime(2024, 1, 2), "amount": -60}, {"at": datetime(2024, 1, 3), "amount": 10, "kind": "refund"},
        {"at": datetime(2024, 2, 1), "amount": 100}, {"at": datetime(2024, 2, 2), "amount": -75}, {"at": datetime(2024, 3, 2), "amount": -1},
    ])
    assert [r[0] for r in rows(money.income_vs_spend(df, Params()), "savings_rate")] == [0.5, 0.25, None]
    assert rows(money.savings_headline(df, Params()), "value") == [(37.5,)]


def test_weekday_spine(bank, rows):
    df = bank([{"at": datetime(2024, 1, 5, 12), "amount": -20}, {"at": datetime(2024, 1, 7, 12), "amount": 4, "kind": "refund"}])
    to = Params(date_from=date(2024, 1, 5), date_to=date(2024, 1, 8), tz=ZONE)
    assert [(r[1], r[2], float(r[3]), r[4]) for r in rows(money.weekday_weekend(df, to))] == [("weekday", 2, 20.0, 10.0), ("weekend", 2, -4.0, -2.0)]
    assert rows(money.weekend_headline(df, to), "value") == [(-12.0,)]
    assert rows(money.weekday_weekend(bank([]), to)) == []


def test_delivery(bank, rows):
    df = bank([
        {"at": datetime(2023, 5, 1), "amount": -10, "merchant": "GLOVO Iasi"}, {"at": datetime(2023, 5, 2), "amount": -30, "merchant": "glovoo"},
        {"at": datetime(2024, 5, 1), "amount": -5, "category": "Food Delivery"}, {"at": datetime(2024, 5, 2), "amount": -5},
    ])
    assert [r[3] for r in rows(money.delivery_share(df, Params()))] == [0.25, 0.5]
    assert rows(money.delivery_headline(df, Params()), "value", "delta") == [(50.0, 25.0)]


def test_subscriptions(bank, rows):
    def every(name, start, days, amounts):
        return [{"at": start + timedelta(days=days * i), "amount": -a, "merchant": name} for i, a in enumerate(amounts)]

    df = bank(
        [{"at": datetime(2024, m, 5, 9), "amount": -a, "merchant": "Monthly"} for m, a in zip((1, 2, 3, 4), (49.99, 49.99, 49.99, 59.99))]
        + [{"at": datetime(y, 4, 1, 9), "amount": -120, "merchant": "Yearly"} for y in (2022, 2023, 2024)] + every("Odd", datetime(2024, 1, 1), 30, [10, 40, 20])
        + every("Gone", datetime(2023, 1, 1), 30, [8, 8, 8]) + every("Twice", datetime(2024, 1, 1), 7, [5, 5, 5]))
    p = Params(date_to=date(2024, 4, 30))
    got = money.subscriptions(df, p).collect()
    assert [(r["merchant"], r["period"], float(r["annual_cost"]), r["active"], len(r["price_history"])) for r in got] == [
        ("Monthly", "monthly", 719.88, True, 2), ("Yearly", "yearly", 120.0, True, 1), ("Gone", "monthly", 96.0, False, 1)]
    assert got[1]["next_expected_date"] == date(2025, 4, 2) and got[2]["next_expected_date"] == date(2023, 4, 1)
    assert rows(money.subscription_headline(df, p), "value") == [(839.88,)]
    with pytest.raises(ValueError):
        money.subscriptions(df, Params())


@pytest.mark.parametrize("last,kept", [("15", True), ("15.01", False), ("5", True), ("4.99", False)])
def test_price_steps(last, kept):
    import pandas as pd

    frame = pd.DataFrame({"merchant": "m", "day": [date(2024, i, 1) for i in (1, 2, 3, 4)], "ts": range(4), "id": "",
                          "amount": [Decimal(a) for a in ("10", "10", "10", last)]})
    assert money._runs_of_merchant(frame)["established"].all() == kept


def test_price_runs_equal_the_definition():
    import random
    from statistics import median

    def direct(amounts):
        runs, current = [], []
        for amount in amounts:
            middle = median([*current, amount])
            if current and any(abs(x - middle) > middle * Decimal("0.1") for x in [*current, amount]):
                runs.append(current)
                current = []
            current = [*current, amount]
        return [*runs, current]

    rng = random.Random(5)
    for _ in range(200):
        amounts = [Decimal(rng.choice([100, 105, 109, 110, 111, 120, 131])) / 7 for _ in range(rng.randrange(1, 30))]
        assert [amounts[a:b] for a, b in money.split_prices(amounts)] == direct(amounts)


def test_activity_window(bank):
    for days, gap, active in ((30, 45, True), (30, 46, False), (350, 525, True), (350, 526, False)):
        df = bank([{"at": datetime(2020, 1, 1) + timedelta(days=days * i), "amount": -5} for i in range(3)])
        end = date(2020, 1, 1) + timedelta(days=days * 2 + gap)
        assert money.subscriptions(df, Params(as_of=end)).first()["active"] == active


# ---- cross-source -----------------------------------------------------------------------------


def _weeks(spark, values, name):
    rows = [(date(2024, 1, 1) + timedelta(weeks=w), float(v)) for w, v in values]
    return spark.createDataFrame(rows, f"week date, {name} double")


def test_correlation(spark, rows):
    def r(x, y):
        return rows(cross.weekly_correlation(_weeks(spark, x, "x"), _weeks(spark, y, "y"), "x", "y"), "r", "n_weeks")

    assert r([(0, 1), (1, 2), (2, 3)], [(0, 1), (1, 2), (2, 4)])[0] == (0.981980506062, 3)
    assert r([(0, 1), (1, 2), (2, 3), (3, 4)], [(0, 1), (1, 3), (2, 3), (3, 1)])[0] == (0.0, 4)
    assert r([(0, 1), (1, 1)], [(0, 1), (1, 2)])[0] == (None, 2)
    assert r([(0, 1)], [(1, 2)]) == [(-1.0, 2)] * 2
    assert r([], [(0, 1)]) == []


def test_watches_on_a_clock_change_sunday(chat, spark, rows):
    df = chat([{"at": datetime(2024, 10, 27, 0, 30)}, {"at": datetime(2024, 10, 27, 22, 30)}])
    events = spark.createDataFrame([(datetime(2024, 10, 27, 1, 30), "youtube.watch"), (datetime(2024, 10, 27, 0, 30), "youtube.watch")], "ts timestamp, kind string")
    got = rows(cross.messages_vs_watches(df, events, Params(tz=ZONE)), "messages", "youtube_watches")
    assert got == [(1.0, 2.0), (1.0, 0.0)]


def test_timeline_percent_of_own_maximum(chat, spark, rows):
    df = chat([{"at": i} for i in range(100)] + [{"at": datetime(2024, 2, 1)}])
    places = spark.createDataFrame([(datetime(2024, 1, 5),), (datetime(2024, 2, 5),), (datetime(2024, 2, 6),)], "ts timestamp")
    got = rows(cross.life_timeline({"messages": df, "locations": places}, Params()), "stream", "activity_pct", "bucket_end", "busiest_activity")
    assert got == [("locations", 50.0, date(2024, 2, 1), 100), ("messages", 100.0, date(2024, 2, 1), 100),
                   ("locations", 100.0, date(2024, 3, 1), 100), ("messages", 1.0, date(2024, 3, 1), 100)]


def test_last_full_year(chat, rows):
    assert rows(cross.coverage({"messages": chat([{"at": datetime(2024, 12, 31, 22)}])}, ZONE), "last_full_year") == [(2024,)]
    assert rows(cross.coverage({"messages": chat([{"at": datetime(2024, 12, 31, 21)}])}, ZONE), "last_full_year") == [(2024,)]
    assert rows(cross.coverage({"messages": chat([{"at": datetime(2024, 12, 30, 21)}])}, ZONE), "last_full_year") == [(2023,)]


def test_year_over_year_compares_equal_headlines(spark, rows):
    df = spark.createDataFrame(
        [(datetime(2022, 5, 1), "track", "A", "x", 3600000 * 2, None), (datetime(2023, 5, 1), "track", "B", "y", 3600000 * 3, None),
         (datetime(2023, 12, 31), "track", "B", "y", 0, None)], PLAY)
    specs = [registry.operators()[i] for i in ("music.listening_minutes", "music.discovery_rate", "music.top_artists_by_year")]
    got = rows(yearly.year_over_year(spark, {"media_plays": df}, Params(), specs), "dig_id", "delta_unit", "skipped_digs", "this_year", "last_year", "delta_pct")
    assert got == [("music.discovery_rate", "pp", 1, 50.0, 100.0, -50.0), ("music.listening_minutes", "%", 1, 3.0, 2.0, 50.0)]
    assert yearly.top_changes(spark, {"media_plays": df}, 2023, Params(), specs=specs).count() == 0


def test_initials(spark, rows):
    df = spark.createDataFrame([("Lavinia Owlcroft",), ("mira",), ("1 2",), ("Ana Maria Pop",)], "n string")
    assert rows(df.select(yearly.initials(F.col("n")))) == [("LO",), ("M",), ("?",), ("AP",)]
