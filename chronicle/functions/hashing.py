"""Deterministic row ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the id format.
SEPARATOR = "\x1f"
LENGTH = 32


def content_hash(*fields: Column) -> Column:
    """First 32 hex digits of sha256 over the fields as text, NULL as '', joined by U+001F."""
    texts = [F.coalesce(field.cast("string"), F.lit("")) for field in fields]
    return F.substring(F.sha2(F.concat_ws(SEPARATOR, *texts), 256), 1, LENGTH)


def row_id(source: Column, source_row_id: Column) -> Column:
    return content_hash(source, source_row_id)


def iso_instant(ts: Column) -> Column:
    """A UTC instant as ISO text: seconds, microseconds only when not zero, +00:00."""
    wall = ts.cast("timestamp_ntz")
    plain = F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(wall, ".SSSSSS")
    return F.concat(plain, F.when(micros != ".000000", micros).otherwise(""), F.lit("+00:00"))
