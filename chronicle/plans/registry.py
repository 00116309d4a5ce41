"""The insight operators by id, and which of them have data."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronicle.operators import cross, messages, money, plays
from chronicle.params import Params

Tables = dict[str, DataFrame]
Operator = Callable[[Tables, Params], DataFrame]


@dataclass(frozen=True)
class OperatorSpec:
    """`headline` is a (label, value, unit) row when the operator's headline is a number."""

    id: str
    title: str
    requires: tuple[str, ...]
    run: Operator
    headline: Operator | None = None


def _facts(tables: Tables) -> Tables:
    return {name: tables[name] for name in FACT_NAMES if name in tables}


FACT_NAMES = ("messages", "media_plays", "transactions", "events", "locations")
_M, _P, _T = ("messages",), ("media_plays",), ("transactions",)


def _message(fn, contacts: bool = True) -> Operator:
    if contacts:
        return lambda t, p: fn(t["messages"], p, t.get("contacts"))
    return lambda t, p: fn(t["messages"], p)


def _play(fn) -> Operator:
    return lambda t, p: fn(t["media_plays"], p)


def _money(fn) -> Operator:
    return lambda t, p: fn(t["transactions"], p)


def _first(label: str, unit: str, column: str, scale: int = 1, places: int | None = None):
    """A headline from the first row of a result."""

    def take(rows: DataFrame) -> DataFrame:
        value = F.col(column).cast("double") * scale
        return rows.limit(1).select(
            F.lit(label).alias("label"),
            (value if places is None else F.round(value, places)).alias("value"),
            F.lit(unit).alias("unit"),
        )

    return take


def _after(run: Operator, take) -> Operator:
    return lambda t, p: take(run(t, p))


_STARTERS = _message(messages.conversation_starters)
_STREAKS = _message(messages.streaks_silences)

BUILT_IN = (
    OperatorSpec("messages.volume_by_contact", "Message volume by contact", _M,
                 _message(messages.volume_by_contact), _message(messages.volume_headline)),
    OperatorSpec("messages.top_contacts_by_year", "Top contacts by year", _M,
                 _message(messages.top_contacts_by_year)),
    OperatorSpec("messages.response_times", "Reply times", _M,
                 _message(messages.response_times), _message(messages.response_headline)),
    OperatorSpec("messages.conversation_starters", "Conversation starters", _M, _STARTERS,
                 _after(_STARTERS, _first("Conversations you started", "%", "overall_share", 100, 1))),
    OperatorSpec("messages.activity_heatmap", "Activity by local hour", _M,
                 _message(messages.activity_heatmap, False), _message(messages.night_share, False)),
    OperatorSpec("messages.streaks_silences", "Streaks and silences", _M, _STREAKS,
                 _after(_STREAKS, _first("Longest streak", "days", "streak_days"))),
    OperatorSpec("messages.emoji_words", "Your emoji and words by year", _M,
                 _message(messages.emoji_words, False)),
    OperatorSpec("music.listening_minutes", "Listening time", _P,
                 _play(plays.listening_minutes), _play(plays.listening_headline)),
    OperatorSpec("music.top_artists_by_year", "Top artists by year", _P,
                 _play(plays.top_artists_by_year)),
    OperatorSpec("music.discovery_rate", "New artist discovery", _P,
                 _play(plays.discovery_rate), _play(plays.discovery_headline)),
    OperatorSpec("music.seasonality", "Seasonal listening", _P, _play(plays.seasonality)),
    OperatorSpec("music.skips_obsessions", "Skips and obsessions", _P,
                 _play(plays.skips_obsessions), _play(plays.obsession_headline)),
    OperatorSpec("money.spend_by_category", "Spending by category", _T,
                 _money(money.spend_by_category), _money(money.category_headline)),
    OperatorSpec("money.income_vs_spend", "Income and spending", _T,
                 _money(money.income_vs_spend), _money(money.savings_headline)),
    OperatorSpec("money.weekday_weekend", "Weekday and weekend spending", _T,
                 _money(money.weekday_weekend), _money(money.weekend_headline)),
    OperatorSpec("money.delivery_index", "Delivery index", _T,
                 _money(money.delivery_share), _money(money.delivery_headline)),
    OperatorSpec("money.subscriptions", "Recurring subscriptions", _T,
                 _money(money.subscriptions), _money(money.subscription_headline)),
    OperatorSpec("cross.life_timeline", "Life timeline", (),
                 lambda t, p: cross.life_timeline(_facts(t), p)),
    OperatorSpec("cross.soundtrack", "Soundtrack of a period", _P, _play(plays.soundtrack)),
    OperatorSpec("cross.spend_vs_listening", "Spend versus listening", _T + _P,
                 lambda t, p: cross.spend_vs_listening(t["transactions"], t["media_plays"], p)),
    OperatorSpec("cross.messages_vs_youtube", "Messages versus YouTube", ("messages", "events"),
                 lambda t, p: cross.messages_vs_watches(t["messages"], t["events"], p)),
)


def operators(extra: tuple[OperatorSpec, ...] = ()) -> dict[str, OperatorSpec]:
    """All operators by id, in order; ids are unique."""
    found: dict[str, OperatorSpec] = {}
    for spec in (*BUILT_IN, *extra):
        if spec.id in found:
            raise ValueError(f"operator {spec.id!r} is registered twice")
        found[spec.id] = spec
    return dict(sorted(found.items()))


def available(tables: Tables, extra: tuple[OperatorSpec, ...] = ()) -> list[OperatorSpec]:
    """Operators whose tables all have rows; those that need none want any fact.

    One row per table is looked for, tables are not counted.
    """
    filled = {name for name, df in tables.items() if not df.isEmpty()}
    has_facts = bool(filled & set(FACT_NAMES))
    return [
        spec
        for spec in operators(extra).values()
        if (set(spec.requires) <= filled if spec.requires else has_facts)
    ]
