"""Text column functions: tokens, names, phones, merchants and secrets."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# URL, word and emoji patterns, and the stopword list.
URLS = r"(?iU)(?:https?://|www\.)[^\s\x1c-\x1f]+"
WORDS = r"[\p{L}\p{Nl}\p{No}]{3,}"
STOPWORDS = (
    "the and you your that this with for from are was were have has had not but can "
    "este sunt care pentru acest aceasta sau din cum mai fost lui lor noi voi "
    "der die das und ist sind mit von den dem ein eine nicht ich du wir sie "
    "los las del que por para con una uno como pero sus son esta este "
    "les des une un que qui dans pour avec est sont pas nous vous elle ses"
)
EMOJI_BASE = (
    r"(?:[\x{1F1E6}-\x{1F1FF}]{2}|[0-9#*]\x{FE0F}?\x{20E3}|"
    r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{2300}-\x{23FF}"
    r"\x{A9}\x{AE}\x{2122}\x{2B50}\x{2B1B}\x{2190}-\x{21FF}])"
)
EMOJI_PART = (
    EMOJI_BASE
    + r"[\x{FE0F}\x{FE0E}]?[\x{1F3FB}-\x{1F3FF}]?[\x{E0020}-\x{E007E}]*\x{E007F}?"
)
EMOJI = EMOJI_PART + r"(?:\x{200D}" + EMOJI_PART + r")*"


# Whatever an emoji cluster is made of; runs of anything else only part clusters.
EMOJI_OTHER = (
    r"[^#*0-9\x{A9}\x{AE}\x{200D}\x{20E3}\x{2122}\x{2190}-\x{21FF}\x{2300}-\x{23FF}\x{2600}-\x{27BF}"
    r"\x{2B1B}\x{2B50}\x{FE0E}\x{FE0F}\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1FAFF}\x{E0020}-\x{E007F}]+"
)


def strip_urls(column: Column) -> Column:
    return F.regexp_replace(column, URLS, "")


def emoji(column: Column) -> Column:
    """Array of emoji clusters: flags, keycaps, skin tones and joined sequences stay whole."""
    return F.regexp_extract_all(F.regexp_replace(column, EMOJI_OTHER, "\n"), F.lit(EMOJI), F.lit(0))


def words(column: Column) -> Column:
    """Array of lowercase words of at least three letters, stopwords among them."""
    return F.regexp_extract_all(F.lower(column), F.lit(WORDS), F.lit(0))


def is_word(token: Column) -> Column:
    """Whether a token is one of `words`; an emoji never is, as it has at most one letter-like character in a row."""
    return token.rlike(f"^{WORDS}$")


def is_stopword(word: Column) -> Column:
    return word.isin(*sorted(set(STOPWORDS.split())))


# ---- names and phones -------------------------------------------------------------------------


@F.pandas_udf(StringType())
def _fold(names: pd.Series) -> pd.Series:
    """Casefold, decompose and drop combining marks; called for non-ASCII names only."""
    return names.map(
        lambda name: None
        if name is None
        else "".join(
            c if c.isalnum() or c.isspace() else " "
            for c in unicodedata.normalize("NFKD", name.casefold())
            if not unicodedata.combining(c)
        )
    )


def normalise_name(name: Column) -> Column:
    """Casefold, strip accents, turn other characters into spaces, collapse spaces."""
    plain = name.rlike(r"^[\x00-\x7F]*$")
    ascii_fold = F.regexp_replace(F.lower(name), r"[^a-z0-9\s]", " ")
    folded = F.when(plain, ascii_fold).otherwise(_fold(F.when(~plain, name)))
    # \s in the patterns above covers ASCII only; _fold keeps other space characters.
    return F.trim(F.regexp_replace(folded, r"[\s\x1c-\x1f\x{85}\p{Z}]+", " "))


def name_tokens(normalised: Column) -> Column:
    """Sorted distinct tokens of a normalised name."""
    parts = F.filter(F.split(normalised, " "), lambda token: token != "")
    return F.array_sort(F.array_distinct(parts))


def normalise_phone(value: Column) -> Column:
    """Digits of an international number, NULL when the value is not one."""
    bare = F.regexp_replace(value, r"^whatsapp:", "")
    return F.when(bare.rlike(r"^\+[\d\s().\-]+$"), F.regexp_replace(bare, r"\D", ""))


# ---- merchants --------------------------------------------------------------------------------

# Noise patterns and the country and city codes of card descriptors.
MERCHANT_URL = r"(?i)https?://\S+|\b(?:[\w-]+\.)+[a-z]{2,}(?:/\S*)?"
MERCHANT_NOISE = r"\*\S+|#\d+|\d{4,}"
MERCHANT_WORDS = r"(?i)\b(?:payment|purchase|card|pos)\b"
LOCATION_CODES = (
    "RO", "ROU", "GB", "GBR", "US", "USA", "DE", "DEU", "FR", "FRA", "IT", "ITA", "ES", "ESP",
    "NL", "NLD", "IE", "IRL", "CH", "CHE", "AT", "AUT", "CA", "CAN", "AU", "AUS", "SG", "SGP",
    "BUC", "LDN", "NYC", "SIN",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_LETTERS = r"[\p{L}\p{Nl}\p{No}]+"


def _capitalised(text: Column) -> Column:
    """Words of letters, with inner apostrophes, in title case; all else as it is."""
    words = _LETTERS + r"(?:['\x{2019}]" + _LETTERS + ")*"
    pieces = F.regexp_extract_all(text, F.lit(words + r"|[^\p{L}\p{Nl}\p{No}]+"), F.lit(0))
    return F.array_join(
        F.transform(
            pieces,
            lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p)))),
        ),
        "",
    )


def normalise_merchant(raw: Column) -> Column:
    """A card descriptor as a readable merchant name; descriptors without letters stay raw."""
    may_link = raw.contains(".") | raw.contains("://")
    value = F.when(may_link, F.regexp_replace(raw, "(?U)" + MERCHANT_URL, " ")).otherwise(raw)
    value = F.regexp_replace(value, "(?U)" + MERCHANT_NOISE, " ")
    value = F.regexp_replace(value, "(?U)" + MERCHANT_WORDS, " ")
    tokens = F.filter(F.split(value, r"(?U)\s+"), lambda token: token != "")

    def without_place(found: Column) -> Column:
        last = F.element_at(found, -1).isin(*LOCATION_CODES)
        keep = F.when((F.size(found) > 1) & last, F.size(found) - 1).otherwise(F.size(found))
        return F.array_join(F.slice(found, F.lit(1), keep), " ")

    joined = let(tokens, lambda t: F.when(F.size(t) > 0, without_place(t)).otherwise(""))
    return let(joined, lambda j: F.when(j.rlike(r"\p{L}"), _capitalised(j)).otherwise(raw))


# ---- secrets ----------------------------------------------------------------------------------

# The replacement text and the shapes of secrets, in the order they are applied.
REDACTED = "«redacted»"
SECRET_VALUE = r"""(?:\$\([^)]*\)|"(?:\\.|[^"\\])*"|'[^']*'|[^\s;"']+)"""
SECRET_ASSIGNMENT = (
    r"(?iU)(\b\w*(?:token|secret|password|passwd|api_?key|auth)\w*=)" + SECRET_VALUE
)
SECRET_EXPORT = r"""(?U)\b(?:export|env)\s+(?:"(?:\\.|[^"\\])*"|'[^']*'|[^;"'\n])+"""
SECRET_DATABASE = r"(?U)^\s*(?:\S*/)?(?:mysql|mysqldump|mysqladmin|mariadb)(?=\s|$)"
SECRET_ATTACHED = r"(?U)((?<!\S)-p)" + SECRET_VALUE
SECRET_PREFIXED = [
    r"(?iU)(--(?:password|token|secret|api-key)(?:=|\s+))" + SECRET_VALUE,
    r"""(?iU)(Authorization:\s*Bearer\s+)[^\s"']+""",
    r"(?iU)(\b[a-z][a-z0-9+.-]*://)[^\s/@:]+:[^\s/]+(?=@)",
]
SECRET_SHAPES = [
    r"(?U)\b(?:ghp_|gho_|github_pat_)[A-Za-z0-9_]+\b",
    r"(?U)\bsk-[A-Za-z0-9_-]{20,}\b",
    r"(?U)\bxox[abpr]-[A-Za-z0-9-]+\b",
    r"(?U)\bAKIA[0-9A-Z]{16}\b",
]
# Texts without any of these cannot match: a plain search saves most texts the pattern.
EXPORT_SIGNS = ("export", "env")
DATABASE_SIGNS = ("mysql", "mariadb")
PREFIXED_SIGNS = [("--",), (":",), ("://",)]
SHAPE_SIGNS = [("ghp_", "gho_", "github_pat_"), ("sk-",), ("xox",), ("AKIA",)]


def _any_of(text: Column, signs: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(sign) for sign in signs))


def redact(column: Column) -> Column:
    """Struct (text, count): secret values masked, and how many were."""
    # Assignments count only inside an export or env command: split the text at those commands,
    # mask inside them, and put the pieces together again.
    outside = F.split(column, SECRET_EXPORT, -1)
    inside = F.regexp_extract_all(column, F.lit(SECRET_EXPORT), F.lit(0))
    masked = F.transform(inside, lambda c: F.regexp_replace(c, SECRET_ASSIGNMENT, "$1" + REDACTED))
    rebuilt = F.array_join(
        F.zip_with(outside, masked, lambda o, m: F.concat(o, F.coalesce(m, F.lit("")))), ""
    )
    has_export = _any_of(column, EXPORT_SIGNS) & column.rlike(SECRET_EXPORT)
    text = F.when(has_export, rebuilt).otherwise(column)
    count = F.when(
        has_export,
        F.aggregate(
            inside,
            F.lit(0),
            lambda total, c: total + F.regexp_count(c, F.lit(SECRET_ASSIGNMENT)),
        ),
    ).otherwise(0)
    return _mask_database(text, count)


def _mask_database(text: Column, count: Column) -> Column:
    """Chain the remaining passes through one struct, so that each sees the text before it."""
    state = F.struct(text.alias("text"), count.cast("bigint").alias("count"))
    passes = [(DATABASE_SIGNS, SECRET_DATABASE, SECRET_ATTACHED, "$1")]
    passes += [(signs, None, pattern, "$1") for signs, pattern in zip(PREFIXED_SIGNS, SECRET_PREFIXED)]
    passes += [(signs, None, pattern, "") for signs, pattern in zip(SHAPE_SIGNS, SECRET_SHAPES)]
    for signs, guard, pattern, kept in passes:
        state = let(state, _pass(signs, guard, pattern, kept))
    return state


def _pass(signs: tuple[str, ...], guard: str | None, pattern: str, kept: str):
    def step(state: Column) -> Column:
        text = state["text"]
        applies = _any_of(text, signs) & text.rlike(guard or pattern)
        hits = F.when(text.isNotNull() & ~applies, 0).otherwise(F.regexp_count(text, F.lit(pattern)))
        masked = F.when(applies, F.regexp_replace(text, pattern, kept + REDACTED)).otherwise(text)
        return F.struct(masked.alias("text"), (state["count"] + hits).cast("bigint").alias("count"))

    return step
