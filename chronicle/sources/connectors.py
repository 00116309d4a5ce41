"""Connectors: which files of an export folder each one knows, and how it parses them into fact rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronicle.functions.joins import join_facts
from chronicle.sources import activity, bank, chat, classify, plays, shell
from chronicle.sources.json_records import json_records
from chronicle.sources.lines import read_lines, read_zip_lines


@dataclass(frozen=True)
class Options:
    tz: str = "UTC"
    self_identities: Sequence[str] = ()


@dataclass(frozen=True)
class Files:
    """The files of one format below a folder: (path, text) with the first 64 KiB of each."""

    spark: SparkSession
    root: str
    chosen: DataFrame

    def pieces(self, separator: str = "\n", where: Column | None = None) -> DataFrame:
        """The files' lines, or pieces between `separator`s, also from inside ZIP archives."""
        chosen = self.chosen if where is None else self.chosen.filter(where)
        every = read_lines(self.spark, self.root, separator, exclude=r"\.zip$", hidden=True)
        every = every.unionByName(read_zip_lines(self.spark, self.root, "*", separator))
        return join_facts(every, chosen.select("path"), "path", "left_semi")


@dataclass(frozen=True)
class Connector:
    """`score` rates (path, first 64 KiB) from 0 to 1; `parse` gives fact rows of `table`."""

    id: str
    table: str
    score: Callable[[Column, Column], Column]
    parse: Callable[[Files, Options], DataFrame]
    version: str = "1"


def _scored(name: str) -> Callable[[Column, Column], Column]:
    return lambda path, text: classify.scores(path, text)[name]


def _activity(files: Files, options: Options) -> DataFrame:
    page = F.lower("path").endswith(".html")
    visits = F.col("text").rlike(r'"Browser History"\s*:')
    parts = (
        activity.activity_from_html(files.pieces(activity.CELL, page), options.tz),
        activity.visits_from_json(json_records(files.pieces("}", ~page & visits), member="Browser History")),
        activity.activity_from_json(json_records(files.pieces("}", ~page & ~visits))),
    )
    rows = [rows for rows, _ in parts]
    return rows[0].unionByName(rows[1], allowMissingColumns=True).unionByName(rows[2], allowMissingColumns=True)


BUILT_IN = (
    Connector("bank_csv", "transactions", _scored("bank_csv"),
              lambda f, o: bank.transactions_from_csv(f.pieces(), o.tz)[0]),
    Connector("google_takeout", "events", _scored("google_takeout"), _activity),
    Connector("shell_history", "events", _scored("shell_history"), lambda f, o: shell.shell_events(f.pieces())[0]),
    Connector("spotify", "media_plays", _scored("spotify"),
              lambda f, o: plays.plays_from_json(json_records(f.pieces("}")))[0]),
    Connector("whatsapp", "messages", _scored("whatsapp"),
              lambda f, o: chat.chat_messages(f.pieces(), o.tz, o.self_identities)[0]),
)


def connectors(extra: tuple[Connector, ...] = ()) -> dict[str, Connector]:
    """All connectors by id; ids are unique."""
    found: dict[str, Connector] = {}
    for connector in (*BUILT_IN, *extra):
        if connector.id in found:
            raise ValueError(f"connector {connector.id!r} is registered twice")
        found[connector.id] = connector
    return dict(sorted(found.items()))


def ratings(known: dict[str, Connector], path: Column, text: Column) -> dict[str, Column]:
    """The score of each connector; one whose detector cannot be built rates everything 0."""
    found = {}
    for name, connector in known.items():
        try:
            found[name] = connector.score(path, text)
        except Exception:
            found[name] = F.lit(0.0)
    return found
