"""Chat text exports as `messages` rows."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from chronicle.functions import calendar
from chronicle.functions.hashing import content_hash, iso_instant
from chronicle.functions.joins import join_facts
from chronicle.session import staged
from chronicle.sources.lines import ORDER, base_name, occurrences, stitch

# Invisible marks, line heads, notices and media words in four languages.
MARKS = r"[\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]"
DATE = r"(\d{1,2})[/.](\d{1,2})[/.](\d{2}|\d{4})"
TIME = r"(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\s*([ap]\.?\s?m\.?))?"
ANDROID = r"(?isU)^" + DATE + r",\s*" + TIME + r"\s+-\s+(.*)$"
IOS = r"(?isU)^\[" + DATE + r",\s*" + TIME + r"\]\s*(.*)$"
PHONE = r"^\+?[\d ()\-.]+$"
GROUP_NOTICE = (
    r"(?iu)created (?:this |the )?group|added .+|left\.?$|"
    r"changed the (?:subject|icon|description|group)|"
    r"a creat grupul|a adăugat|a părăsit|a schimbat (?:subiectul|numele)|"
    r"gruppe .*(?:erstellt|gegründet)|hinzugefügt|hat .*verlassen|gruppenbetreff|"
    r"creó el grupo|añadió|salió del grupo|cambió el asunto"
)
SYSTEM_NOTICE = (
    r"(?iu)^(?:messages and calls are end-to-end encrypted(?:\.|"
    r"\. No one outside of this chat, not even WhatsApp, can read or listen to them\. "
    r"Tap to learn more\.)?|missed (?:voice|video) call\.?|"
    r"your security code with [^\n]+ changed\.?|security code changed\.?|"
    r"created (?:this |the )?group(?: [^\n]+)?|added [^\n]+|left\.?|"
    r"changed the (?:subject|(?:group )?icon|(?:group )?description)(?: [^\n]+)?|"
    r"mesajele și apelurile sunt criptate(?: integral)?\.?|"
    r"apel (?:vocal |video )?ratat\.?|codul (?:tău )?de securitate "
    r"cu [^\n]+ s-a schimbat\.?|a creat grupul(?: [^\n]+)?|a adăugat [^\n]+|"
    r"a părăsit(?: grupul)?\.?|a schimbat (?:subiectul|numele|pictograma|descrierea)"
    r"(?: [^\n]+)?|nachrichten und anrufe sind ende-zu-ende-verschlüsselt\.?|"
    r"verpasster (?:sprach|video)anruf\.?|sicherheitsnummer "
    r"mit [^\n]+ hat sich geändert\.?|gruppe(?: [^\n]+)? (?:erstellt|gegründet)\.?|"
    r"hinzugefügt(?: [^\n]+)?|hat (?:die gruppe )?verlassen\.?|"
    r"gruppen(?:betreff|bild|beschreibung) geändert(?: [^\n]+)?|"
    r"los mensajes y las llamadas están cifrados de extremo a extremo\.?|"
    r"llamada perdida\.?|cambió tu código de seguridad(?: con [^\n]+)?\.?|"
    r"creó el grupo(?: [^\n]+)?|añadió [^\n]+|salió del grupo\.?|"
    r"cambió (?:el asunto|el icono|la descripción)(?: [^\n]+)?)$"
)
DELETED = (
    "This message was deleted",
    "You deleted this message",
    "Acest mesaj a fost șters",
    "Ai șters acest mesaj",
    "Dieser Nachricht wurde gelöscht",
    "Diese Nachricht wurde gelöscht",
    "Du hast diese Nachricht gelöscht",
    "Este mensaje fue eliminado",
    "Eliminaste este mensaje",
    "Borraste este mensaje",
)
MEDIA = (
    r"(?isu)^(?:<(?:Media omitted|Media lipsă|Fișier media omis|Medien ausgeschlossen|"
    r"Multimedia omitido)>|(image|video|audio|sticker|GIF|document) omitted|"
    r"<attached:\s*([^>]+)>|([^\n]+?) \(file attached\))"
    r"(?=$|\s)(.*)$"
)
EXTENSIONS = {
    "image": (".jpg", ".jpeg", ".png", ".heic"),
    "video": (".mp4", ".mov", ".3gp"),
    "audio": (".opus", ".ogg", ".mp3", ".m4a", ".wav"),
}
ANDROID_NAME = "WhatsApp Chat with "
ARCHIVE_NAME = "WhatsApp Chat - "

# Noncharacters keep the fields of a line head apart.
_CUT = "\ufdd0"
_NONE = "\ufdd1"
_FIELDS = _CUT.join(f"${n}" for n in range(1, 9))
_SPACE = r"(?U)^\s+|\s+$"


def clean(text: Column) -> Column:
    return F.regexp_replace(text, MARKS, "")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, _SPACE, "")


def _head(line: Column) -> Column:
    """Array of the eight fields of a line head; other lines give a shorter array."""
    android = F.regexp_replace(line, ANDROID, _FIELDS)
    return F.split(F.regexp_replace(android, IOS, _FIELDS), _CUT, 8)


def _number(parts: Column, index: int) -> Column:
    return F.get(parts, F.lit(index - 1)).try_cast("int")


def wall_time(parts: Column, month_first: Column) -> Column:
    """The wall clock of a line head, or NULL when no such time exists."""
    first, second, year = _number(parts, 1), _number(parts, 2), _number(parts, 3)
    hour, half = _number(parts, 4), F.lower(F.get(parts, F.lit(6)))
    afternoon = F.when(half.startswith("p"), 12).otherwise(0)
    clock = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + afternoon)
    second_of_minute = F.coalesce(_number(parts, 6), F.lit(0))
    return F.when(
        second_of_minute <= 59,
        F.try_make_timestamp_ntz(
            F.when(year < 100, year + 2000).otherwise(year),
            F.when(month_first, first).otherwise(second),
            F.when(month_first, second).otherwise(first),
            clock,
            _number(parts, 5),
            second_of_minute,
        ),
    )


def sender_id(sender: Column) -> Column:
    digits = F.regexp_replace(sender, r"\D", "")
    phone = sender.rlike(PHONE) & F.length(digits).between(7, 15)
    return F.when(phone, F.concat(F.lit("whatsapp:+"), digits)).otherwise(
        F.concat(F.lit("whatsapp:name:"), sender)
    )


@F.pandas_udf(StringType())
def _chat_key(names: pd.Series) -> pd.Series:
    """Composed, casefolded, single-spaced chat name; one call per file."""
    return names.map(
        lambda name: None
        if name is None
        else " ".join(unicodedata.normalize("NFC", name).split()).casefold()
    )


def _chat_name(path: Column) -> Column:
    """The name a file name carries, or NULL."""
    file = F.regexp_replace(base_name(path), r"\.[^.]*$", "")
    folder = F.regexp_replace(
        base_name(F.regexp_replace(path, r"/[^/]*$", "")), r"\.[^.]*$", ""
    )
    in_archive = F.lower(path).rlike(r"\.zip/[^/]+$")
    named = F.when(
        file.startswith(ANDROID_NAME), file.substr(F.lit(len(ANDROID_NAME) + 1), F.length(file))
    ).when(
        in_archive & folder.startswith(ARCHIVE_NAME),
        folder.substr(F.lit(len(ARCHIVE_NAME) + 1), F.length(folder)),
    )
    return _strip(clean(named))


def _heads(lines: DataFrame) -> DataFrame:
    """Lines with their head fields, sender and text: what follows the head, or the whole of other lines.

    `bare` holds the fields of a head read without any marks. The text is kept once.
    """
    marked = F.regexp_replace("line", "^(?:\\x{FEFF}|" + MARKS + ")+", "")
    rows = lines.withColumn("line", marked).withColumn("head", _head(F.col("line")))
    rows = rows.withColumn("is_head", F.size("head") == 8)
    body = F.get("head", F.lit(7))
    at = F.locate(": ", body)
    ends = (at == 0) & body.endswith(":")
    raw_sender = F.when(at > 0, body.substr(F.lit(1), at - 1)).when(
        ends, F.substring(body, F.lit(1), F.length(body) - 1)
    )
    raw_text = F.when(at > 0, body.substr(at + 2, F.length(body))).when(ends, F.lit(""))
    rows = rows.withColumns({"raw_sender": raw_sender, "raw_text": raw_text, "body": body})
    notice = F.col("raw_text").startswith("\u200e") & _strip(clean(F.col("raw_text"))).rlike(
        SYSTEM_NOTICE
    )
    has_sender = F.col("raw_sender").isNotNull() & ~F.coalesce(notice, F.lit(False))
    has_marks = F.col("line").rlike(MARKS)
    bare = F.when(has_marks, _head(clean(F.col("line")))).otherwise(F.col("head"))
    return rows.select(
        "path",
        *ORDER,
        "is_head",
        F.when(F.col("is_head"), F.slice("head", 1, 7)).alias("head"),
        F.when(F.col("is_head"), F.slice(bare, 1, 7)).alias("bare"),
        F.when(F.col("is_head") & has_sender, _strip(clean(F.col("raw_sender")))).alias("sender"),
        F.when(F.col("is_head"), clean(F.coalesce("raw_text", "body"))).otherwise(clean(F.col("line"))).alias("text"),
    )


def _is_self(identity: Column, self_identities: Sequence[str]) -> Column:
    if not self_identities:
        return F.lit(False)
    return F.coalesce(
        F.array_contains(
            F.array(*(sender_id(_strip(clean(F.lit(name)))) for name in self_identities)), identity
        ),
        F.lit(False),
    )


def chat_files(heads: DataFrame, self_identities: Sequence[str]) -> DataFrame:
    """One row per file: date order, chat name and kind, from one pass over the heads.

    The date order is known only at the end of a file, so everything is counted for both orders.
    Lines are first reduced to one row per file and person.
    """
    # The date order is read from lines without any marks.
    bare = F.col("bare")
    possible = F.coalesce(wall_time(bare, F.lit(False)), wall_time(bare, F.lit(True))).isNotNull()
    identity = sender_id(F.col("sender"))
    mine = _is_self(identity, self_identities)
    named = F.col("sender") != ""
    notice = F.col("sender").isNull() & F.col("text").rlike(GROUP_NOTICE)
    other = F.when(named & ~mine, F.struct(*ORDER, "sender"))
    rows = heads.filter("is_head").select(
        "path",
        F.when(named, F.when(mine, "self").otherwise(identity)).alias("person"),
        (possible & (_number(bare, 1) > 12)).alias("dm"),
        (possible & ((_number(bare, 2) > 12) | (F.get(bare, F.lit(6)) != ""))).alias("md"),
        wall_time(F.col("head"), F.lit(False)).isNotNull().alias("valid_d"),
        wall_time(F.col("head"), F.lit(True)).isNotNull().alias("valid_m"),
        notice.alias("notice"),
        other.alias("other"),
    )
    people = rows.groupBy("path", "person").agg(
        F.max("dm").alias("dm"),
        F.max("md").alias("md"),
        *(
            column
            for order in "dm"
            for column in (
                F.max("valid_" + order).alias("valid_" + order),
                F.max(F.col("valid_" + order) & F.col("notice")).alias("notice_" + order),
                F.min(F.when(F.col("valid_" + order), F.col("other"))).alias("other_" + order),
            )
        ),
    )
    files = people.groupBy("path").agg(
        (F.max("md") & ~F.max("dm")).alias("month_first"),
        *(
            column
            for order in "dm"
            for column in (
                F.count_if(F.col("valid_" + order) & F.col("person").isNotNull()).alias("people_" + order),
                F.max("notice_" + order).alias("notice_" + order),
                F.min("other_" + order)["sender"].alias("other_" + order),
            )
        ),
    )

    def chosen(name: str) -> Column:
        return F.when(F.col("month_first"), F.col(name + "_m")).otherwise(F.col(name + "_d"))

    files = files.withColumn("chat_name", F.coalesce(_chat_name(F.col("path")), chosen("other")))
    group = F.col("chat_name").isNotNull() & (chosen("notice") | (chosen("people") > 2))
    return files.select(
        "path",
        "month_first",
        "chat_name",
        F.when(group, "group").otherwise("direct").alias("chat_kind"),
        content_hash(F.lit("whatsapp"), _chat_key(F.col("chat_name"))).alias("named_id"),
    )


def iso_local(ts: Column, tz: str) -> Column:
    """ISO text of an instant in a zone, with the zone's offset."""
    if tz == "UTC":
        return iso_instant(ts)
    wall = calendar.local_time(ts, tz)
    minutes = F.expr("0") + F.timestamp_diff("MINUTE", ts.cast("timestamp_ntz"), wall)
    size = F.abs(minutes)
    offset = F.concat(
        F.when(minutes < 0, "-").otherwise("+"),
        F.lpad((size / 60).cast("int").cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((size % 60).cast("string"), 2, "0"),
    )
    return F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss"), offset)


def media(text: Column) -> Column:
    """Struct (media_type, caption) of an attachment notice, NULL for other texts."""
    word = F.lower(F.regexp_extract(text, MEDIA, 1))
    name = F.lower(
        F.concat(F.regexp_extract(text, MEDIA, 2), F.regexp_extract(text, MEDIA, 3))
    )
    extension = F.regexp_extract(F.regexp_replace(name, r"(?s)^.*/", ""), r"(?s)^.+(\.[^.]+)$", 1)
    kind = F.when(word != "", word).when(
        name.contains("sticker") | (extension == ".webp"), "sticker"
    ).when(extension == ".gif", "gif")
    for label, known in EXTENSIONS.items():
        kind = kind.when(extension.isin(*known), label)
    kind = kind.when(extension != "", "document").otherwise("other")
    caption = _strip(F.regexp_extract(text, MEDIA, 4))
    return F.when(
        text.rlike(MEDIA),
        F.struct(kind.alias("media_type"), F.when(caption != "", caption).alias("caption")),
    )


def chat_messages(
    lines: DataFrame, tz: str = "UTC", self_identities: Sequence[str] = (), source: str = "whatsapp"
) -> tuple[DataFrame, DataFrame]:
    """(messages, refused records) from the lines of chat text files."""
    # Matching heads is the costly step: it runs once, and its result is read in several ways.
    heads = staged(_heads(lines))
    files = staged(chat_files(heads, self_identities))
    # The head travels with the first line of its record.
    first = F.concat_ws(
        _CUT, F.array_join("head", _CUT), F.coalesce("sender", F.lit(_NONE)), "text"
    )
    records = stitch(heads, F.col("is_head"), first, F.col("text"), "\n")
    parts = F.split("text", _CUT, 9)
    records = records.select(
        "path",
        "block",
        "pos",
        F.slice(parts, 1, 7).alias("head"),
        F.when(parts[7] != _NONE, parts[7]).alias("sender_name"),
        parts[8].alias("original"),
    )
    records = join_facts(records, files, "path", counted=heads)
    records = records.withColumn("wall", wall_time(F.col("head"), F.col("month_first")))
    good = F.col("wall").isNotNull() & (
        F.col("sender_name").isNull() | (F.col("sender_name") != "")
    )
    refused = records.filter(~good).select("path", "block", "pos", "original")
    rows = records.filter(good).withColumn("ts", calendar.localise(F.col("wall"), tz)).drop("head", "wall")
    if files.filter("chat_name IS NULL").isEmpty():
        rows = rows.withColumn("chat_id", F.col("named_id"))
    else:
        rows = _with_chat_id(rows, heads)
    rows = rows.withColumn("_iso", iso_local(F.col("ts"), tz))
    fields = (F.col("chat_id"), F.col("_iso"), F.col("sender_name"), F.col("original"))
    rows = occurrences(rows, "ts", *fields)
    shown = F.lower(F.regexp_replace(_strip(F.col("original")), r"\.$", ""))
    deleted = shown.isin([phrase.lower() for phrase in DELETED])
    rows = rows.withColumn("_media", media(F.col("original")))
    kind = (
        F.when(F.col("sender_name").isNull(), "system")
        .when(deleted, "deleted")
        .when(F.col("_media").isNotNull(), "media")
        .otherwise("text")
    )
    rows = rows.withColumn("kind", kind)
    text = (
        F.when(F.col("kind") == "deleted", F.lit(None))
        .when(F.col("kind") == "media", F.col("_media.caption"))
        .otherwise(F.when(F.col("original") != "", F.col("original")))
    )
    identity = sender_id(F.col("sender_name"))
    messages = rows.select(
        "path",
        "block",
        "pos",
        F.lit(source).alias("source"),
        F.col("path").alias("source_file"),
        content_hash(*fields, F.col("occurrence")).alias("source_row_id"),
        "chat_id",
        "chat_name",
        "chat_kind",
        identity.alias("sender_id"),
        "sender_name",
        (F.col("sender_name").isNotNull() & _is_self(identity, self_identities)).alias("is_from_me"),
        "ts",
        text.alias("text"),
        "kind",
        F.when(F.col("kind") == "media", F.col("_media.media_type")).alias("media_type"),
    )
    return messages, refused


def _with_chat_id(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """A chat without any name is identified by its first record."""
    unnamed = (
        rows.filter(F.col("chat_name").isNull())
        .groupBy("path")
        .agg(F.min_by(F.struct("ts", "original"), F.struct(*ORDER)).alias("_first"))
        .select(
            "path",
            content_hash(
                F.lit("whatsapp"),
                F.lit("unnamed"),
                iso_instant(F.col("_first.ts")),
                F.col("_first.original"),
            ).alias("_unnamed"),
        )
    )
    return join_facts(rows, unnamed, "path", "left", counted=heads).withColumn(
        "chat_id", F.when(F.col("chat_name").isNull(), F.col("_unnamed")).otherwise(F.col("named_id"))
    )
