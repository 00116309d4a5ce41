"""Listening history (JSON arrays) as `media_plays` rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronicle.functions.hashing import content_hash, iso_instant
from chronicle.sources.lines import base_name, occurrences

# File name pattern and field names of the two layouts.
FILE_NAME = (
    r"^(?:Streaming_History_(?:Audio|Video)_.+|StreamingHistory(?:_(?:music|podcast)_\d+|\d+))\.json$"
)
TEXT_FIELDS = (
    "ts", "endTime", "platform", "conn_country", "master_metadata_track_name",
    "master_metadata_album_artist_name", "master_metadata_album_album_name", "spotify_track_uri",
    "episode_name", "episode_show_name", "spotify_episode_uri", "audiobook_title", "audiobook_uri",
    "audiobook_chapter_uri", "audiobook_chapter_title", "reason_start", "reason_end", "artistName",
    "trackName", "podcastName", "episodeName",
)
DURATION_FIELDS = ("ms_played", "msPlayed")
FLAG_FIELDS = ("shuffle", "skipped", "offline", "incognito_mode")
META_FIELDS = ("reason_start", "reason_end", "offline", "incognito_mode", "conn_country")
AUDIOBOOK_FIELDS = ("audiobook_title", "audiobook_uri", "audiobook_chapter_uri", "audiobook_chapter_title")
EPISODE_FIELDS = ("episode_name", "episode_show_name", "spotify_episode_uri")

_SCHEMA = ", ".join(
    [f"{name} string" for name in TEXT_FIELDS + DURATION_FIELDS]
    + [f"{name} boolean" for name in FLAG_FIELDS]
)


def _text(name: str) -> Column:
    """A field of the record; an empty text counts as missing."""
    return F.when(F.col("r")[name] != "", F.col("r")[name])


def _any(names: tuple[str, ...]) -> Column:
    return F.coalesce(*(_text(name) for name in names)).isNotNull()


def plays_from_json(records: DataFrame, source: str = "spotify") -> tuple[DataFrame, DataFrame]:
    """(rows, refused records) from (path, block, pos, record)."""
    rows = records.withColumn("name", base_name(F.col("path"))).filter(F.col("name").rlike(FILE_NAME))
    # Behind a generator no filter reaches the record, which would parse it once for each field the filter names.
    rows = rows.select("*", F.explode(F.array(F.from_json("record", _SCHEMA))).alias("r"))
    extended = F.col("name").startswith("Streaming_History_")
    duration = F.when(extended, F.col("r.ms_played")).otherwise(F.col("r.msPlayed"))
    number = duration.try_cast("decimal(38,6)")
    whole = F.when(number == F.floor(number), number).try_cast("bigint")
    kind = (
        F.when(extended & _any(AUDIOBOOK_FIELDS), "audiobook")
        .when(extended & _any(EPISODE_FIELDS), "episode")
        .when(F.col("name").startswith("Streaming_History_Video_"), "video")
        .when(~extended & (F.contains("name", F.lit("podcast")) | _any(("podcastName", "episodeName"))), "episode")
        .otherwise("track")
    )
    artist = F.coalesce(
        *(_text(n) for n in ("master_metadata_album_artist_name", "episode_show_name", "audiobook_title"))
    )
    track = F.coalesce(
        *(_text(n) for n in ("master_metadata_track_name", "episode_name", "audiobook_chapter_title"))
    )
    uri = F.coalesce(
        *(_text(n) for n in ("spotify_track_uri", "spotify_episode_uri", "audiobook_chapter_uri"))
    )
    meta = F.to_json(
        F.struct(*(F.col("r")[name].alias(name) for name in META_FIELDS)),
        {"ignoreNullFields": "false"},
    )
    rows = rows.withColumns(
        {
            "source": F.lit(source),
            "source_file": F.col("path"),
            "ts": F.try_to_timestamp(F.when(extended, _text("ts")).otherwise(_text("endTime"))),
            "media_kind": kind,
            "artist": F.when(extended, artist).otherwise(F.coalesce(_text("artistName"), _text("podcastName"))),
            "track": F.when(extended, track).otherwise(F.coalesce(_text("trackName"), _text("episodeName"))),
            "album": F.when(extended, _text("master_metadata_album_album_name")),
            "uri": F.when(extended, uri),
            "ms_played": whole,
            "platform": F.when(extended, _text("platform")),
            "shuffle": F.when(extended, F.col("r.shuffle")),
            "skipped": F.when(extended, F.col("r.skipped")),
            "meta": F.when(extended, meta),
        }
    )
    good = F.col("ts").isNotNull() & F.coalesce(F.col("ms_played") >= 0, F.lit(False))
    refused = rows.filter(~good).select("path", "block", "pos", "record")
    rows = rows.filter(good).drop("r", "name", "record")
    fields = (
        iso_instant(F.date_trunc("minute", "ts")),
        F.col("media_kind"),
        F.col("artist"),
        F.col("track"),
        F.col("ms_played"),
    )
    rows = occurrences(rows, "ts", *fields)
    return rows.withColumn("source_row_id", content_hash(*fields, F.col("occurrence"))), refused
