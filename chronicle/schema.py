"""Fact table schemas, enum values and the rules a row has to meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_PROVENANCE = (
    "id string not null, source string not null, source_file string not null, "
    "source_row_id string not null, import_id string not null, imported_at timestamp not null, "
    "meta string, "
)

FACTS: dict[str, str] = {
    "messages": (
        "chat_id string not null, chat_name string, chat_kind string not null, sender_id string, "
        "sender_name string, is_from_me boolean not null, contact_id string, "
        "ts timestamp not null, text string, kind string not null, media_type string, "
        "reply_to_id string"
    ),
    "media_plays": (
        "ts timestamp not null, media_kind string not null, artist string, track string, "
        "album string, uri string, ms_played bigint not null, platform string, shuffle boolean, "
        "skipped boolean"
    ),
    "transactions": (
        "ts timestamp not null, amount decimal(18,2) not null, currency string not null, "
        "merchant_raw string, merchant string, counterparty string, contact_id string, "
        "category string, account string not null, balance decimal(18,2), kind string not null"
    ),
    "events": "ts timestamp not null, kind string not null, title string, url string",
    "locations": (
        "ts timestamp not null, end_ts timestamp, lat double not null, lon double not null, "
        "accuracy_m double, place_name string, kind string not null"
    ),
}

ENUMS: dict[str, dict[str, tuple[str, ...]]] = {
    "messages": {
        "chat_kind": ("direct", "group"),
        "kind": ("text", "media", "system", "deleted"),
        "media_type": ("image", "video", "audio", "document", "sticker", "gif", "other"),
    },
    "media_plays": {"media_kind": ("track", "episode", "video", "audiobook")},
    "transactions": {
        "kind": ("card", "transfer", "fee", "topup", "exchange", "refund", "other")
    },
    "events": {},
    "locations": {"kind": ("ping", "visit", "segment")},
}
MONEY_LIMIT = "10000000000000000"


def fact_schema(table: str, provenance: bool = True) -> StructType:
    return StructType.fromDDL((_PROVENANCE if provenance else "") + FACTS[table])


def conform(df: DataFrame, table: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The table's own columns in order; columns a source does not know are NULL."""
    have = set(df.columns)
    extra = [c for c in ("source", "source_file", "source_row_id", "meta", *keep) if c in have]
    own = [
        (F.col(field.name) if field.name in have else F.lit(None)).cast(field.dataType).alias(field.name)
        for field in fact_schema(table, provenance=False)
    ]
    return df.select(*extra, *own)


def reject_reason(df: DataFrame, table: str) -> Column:
    """Why a row is refused, or NULL. Works on columns before the cast to the table's types."""
    have = set(df.columns)
    rules: list[tuple[Column, str]] = []
    for name in ("source", "source_file", "source_row_id"):
        if name in have:
            missing = F.col(name).isNull() | (F.trim(name) == "")
            rules.append((missing, f"{name} is empty"))
    for field in fact_schema(table, provenance=False):
        if not field.nullable:
            missing = F.col(field.name).isNull() if field.name in have else F.lit(True)
            rules.append((missing, f"{field.name} is missing"))
    for name, values in ENUMS[table].items():
        if name in have:
            known = F.col(name).isNull() | F.col(name).isin(*values)
            rules.append((~known, f"{name} is unknown"))
    for name in ("amount", "balance"):
        if name in have and table == "transactions":
            limit = F.lit(MONEY_LIMIT).cast("decimal(38,2)")
            rules.append((F.abs(F.col(name)) >= limit, f"{name} is out of range"))
    if table == "media_plays" and "ms_played" in have:
        rules.append((F.col("ms_played") < 0, "ms_played is negative"))
    return F.coalesce(*(F.when(broken, F.lit(reason)) for broken, reason in rules))


def validate_rows(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(accepted rows in the table's shape, refused rows with a `reason`)."""
    judged = df.withColumn("reason", reject_reason(df, table))
    accepted = conform(judged.filter(F.col("reason").isNull()).drop("reason"), table)
    return accepted, judged.filter(F.col("reason").isNotNull())
