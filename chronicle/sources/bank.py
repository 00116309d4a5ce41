"""Bank statements (CSV) as `transactions` rows, described by a mapping."""

from __future__ import annotations

import codecs
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronicle.functions import calendar, ordered
from chronicle.functions.hashing import content_hash, iso_instant
from chronicle.functions.joins import join_facts
from chronicle.functions.text import normalise_merchant
from chronicle.session import staged
from chronicle.sources.lines import ORDER, decoded, join_pieces, occurrences

# strptime fields and their datetime pattern.
_TIME_FIELDS = {"%Y": "yyyy", "%y": "yy", "%m": "M", "%d": "d", "%H": "H", "%M": "m", "%S": "s"}


@dataclass(frozen=True)
class BankMapping:
    """How one bank names its columns and writes dates and numbers."""

    id: str
    required_headers: tuple[str, ...]
    ts: str
    ts_format: str
    description: str
    account: str
    ts_fallback: str | None = None
    amount: str | None = None
    debit: str | None = None
    credit: str | None = None
    fee: str | None = None
    invert: bool = False
    currency: str | None = None
    fixed_currency: str | None = None
    balance: str | None = None
    category: str | None = None
    counterparty: str | None = None
    counterparty_regex: str | None = None
    kind: str | None = None
    kinds: dict[str, str] = field(default_factory=dict)
    default_kind: str = "other"
    include: str | None = None
    include_values: tuple[str, ...] = ()
    delimiter: str = ","
    decimal: str = "."
    thousands: str = ""
    skip_rows: int = 0
    footer: str | None = None
    encoding: str = "UTF-8"  # of its files; one in which a newline is a byte of its own

    def __post_init__(self) -> None:
        if bool(self.amount) == bool(self.debit and self.credit):
            raise ValueError(f"{self.id}: give amount, or debit and credit")
        if bool(self.currency) == bool(self.fixed_currency):
            raise ValueError(f"{self.id}: give currency or fixed_currency")
        if self.thousands == self.decimal:
            raise ValueError(f"{self.id}: thousands must differ from decimal")
        if codecs.lookup(self.encoding).name.startswith(("utf-16", "utf-32")):
            raise ValueError(f"{self.id}: convert {self.encoding} before, lines are cut at single bytes")
        if self.counterparty and self.counterparty_regex:
            raise ValueError(f"{self.id}: give counterparty or counterparty_regex")

    def columns(self) -> list[str]:
        """Every header the mapping reads."""
        named = [
            self.ts, self.ts_fallback, self.amount, self.debit, self.credit, self.fee,
            self.currency, self.description, self.balance, self.category, self.counterparty,
            self.kind, self.include, *re.findall(r"\{([^}]+)\}", self.account),
        ]
        return sorted({name.strip().lower() for name in named if name})


# The built-in statement layouts.
EXAMPLE_BANK = BankMapping(
    id="example_bank",
    required_headers=("Date", "Details", "Debit", "Credit", "Balance", "Category"),
    delimiter=";",
    decimal=",",
    thousands=".",
    skip_rows=2,
    footer="^END OF STATEMENT",
    ts="Date",
    ts_format="%d.%m.%Y",
    debit="Debit",
    credit="Credit",
    fixed_currency="RON",
    description="Details",
    balance="Balance",
    account="example:current",
    category="Category",
)
REVOLUT = BankMapping(
    id="revolut",
    required_headers=(
        "Type", "Product", "Started Date", "Completed Date", "Description", "Amount", "Fee",
        "Currency", "State", "Balance",
    ),
    ts="Completed Date",
    ts_fallback="Started Date",
    ts_format="%Y-%m-%d %H:%M:%S",
    amount="Amount",
    fee="Fee",
    currency="Currency",
    description="Description",
    balance="Balance",
    account="revolut:{Product}:{Currency}",
    counterparty_regex="^(?:To |Transfer from |Payment from )(.+)$",
    kind="Type",
    kinds={
        "CARD_PAYMENT": "card",
        "TRANSFER": "transfer",
        "TOPUP": "topup",
        "EXCHANGE": "exchange",
        "FEE": "fee",
        "CARD_REFUND": "refund",
        "REFUND": "refund",
    },
    include="State",
    include_values=("COMPLETED",),
)
MAPPINGS = (EXAMPLE_BANK, REVOLUT)


def _field(delimiter: str) -> str:
    """The pattern of a field behind its delimiter."""
    cut = re.escape(delimiter)
    return cut + r'(?:"(?:[^"]++|"")*+"|[^' + cut + r"]*)"


def _bare(found: Column) -> Column:
    """A found field without its delimiter and quotes."""
    f = F.substring(found, F.lit(2), F.length(found))
    inner = F.replace(F.substring(f, F.lit(2), F.greatest(F.length(f) - 2, F.lit(0))), F.lit('""'), F.lit('"'))
    return F.when(F.startswith(f, F.lit('"')), inner).otherwise(f)


def split_csv(record: Column, delimiter: str) -> Column:
    """Fields of one CSV record; doubled quotes inside a quoted field are one quote."""
    found = F.regexp_extract_all(F.concat(F.lit(delimiter), record), F.lit(_field(delimiter)), F.lit(0))
    return F.transform(found, _bare)


def first_field(record: Column, delimiter: str) -> Column:
    """The first of `split_csv`'s fields."""
    return _bare(F.regexp_extract(F.concat(F.lit(delimiter), record), _field(delimiter), 0))


def quotes(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit('"'), F.lit("")))


def csv_records(lines: DataFrame) -> DataFrame:
    """Records of lines with their `quotes` and those `_before` them: a line break inside quotes does not end a record.

    A line starts a record when the quotes before it are even, and is all of it when its own are even too.
    So only the lines of records with line breaks are counted through and brought together.
    """
    begins, even = F.col("_before") % 2 == 0, F.col("quotes") % 2 == 0
    whole = lines.filter(begins & even).select("path", *ORDER, F.col("line").alias("text"))
    pieces = lines.filter(~(begins & even)).select("path", *ORDER, begins.cast("int").alias("_starts"), F.col("line").alias("_piece"))
    pieces = ordered.running_total(pieces, ["path"], "block", ORDER, F.col("_starts"), "_record")
    # Written first: the end of a statement is looked for before its records are read.
    return whole.unionByName(staged(join_pieces(pieces, "\n")))


def _headers(fields: Column) -> Column:
    return F.transform(fields, lambda f: F.lower(F.trim(f)))


def choose_mapping(
    numbered: DataFrame, mappings: tuple[BankMapping, ...] = MAPPINGS
) -> DataFrame:
    """(path, mapping, header, skipped): the first mapping whose headers stand in a file's first 64 KiB.

    `skipped` is the number of quotes up to the end of the header, which open no field of a record.
    """
    last = max(m.skip_rows for m in mappings)
    top = numbered.filter((F.col("block") < 65_536) & (F.col("line_no") <= last))
    chosen = []
    for rank, mapping in enumerate(mappings):
        header = _headers(split_csv(decoded(F.col("line"), mapping.encoding), mapping.delimiter))
        wanted = F.array(*(F.lit(h.strip().lower()) for h in mapping.required_headers))
        chosen.append(
            top.filter(F.col("line_no") == mapping.skip_rows)
            .select(
                "path",
                F.lit(rank).alias("rank"),
                F.lit(mapping.id).alias("mapping"),
                header.alias("header"),
                (F.col("_before") + F.col("quotes")).alias("skipped"),
            )
            .filter(F.size(F.array_except(wanted, F.col("header"))) == 0)
        )
    found = reduce(DataFrame.unionByName, chosen)
    best = F.min_by(F.struct("mapping", "header", "skipped"), "rank").alias("best")
    return found.groupBy("path").agg(best).select("path", "best.*")


def _money(text: Column, mapping: BankMapping) -> Column:
    """A written number as DECIMAL(18,2), half-even; '' is zero and nonsense is NULL."""
    bare = F.replace(text, F.lit(mapping.thousands), F.lit("")) if mapping.thousands else text
    number = F.replace(bare, F.lit(mapping.decimal), F.lit(".")).try_cast("decimal(38,12)")
    value = F.when(text == "", F.lit(0).cast("decimal(38,12)")).otherwise(number)
    return F.bround(value, 2).try_cast("decimal(18,2)")


def _time_pattern(mapping: BankMapping) -> str:
    pattern = mapping.ts_format
    for python, java in _TIME_FIELDS.items():
        pattern = pattern.replace(python, java)
    return pattern


def parsed_csv(
    lines: DataFrame, tz: str = "UTC", mappings: tuple[BankMapping, ...] = MAPPINGS
) -> tuple[DataFrame, DataFrame]:
    """(rows, refused records) from the lines of statements; rows have no ids yet."""
    counted = lines.withColumn("quotes", quotes(F.col("line")))
    totals = {"line_no": F.lit(1), "_before": F.col("quotes")}
    numbered = ordered.running_totals(counted, ["path"], "block", ORDER, totals)
    less = {"line_no": F.col("line_no") - 1, "_before": F.col("_before") - F.col("quotes")}
    numbered = staged(numbered.withColumns(less))
    files = staged(choose_mapping(numbered, mappings))
    parts = [_of_mapping(numbered, files.filter(F.col("mapping") == m.id), m, tz) for m in mappings]
    rows = reduce(DataFrame.unionByName, [part[0] for part in parts])
    refused = reduce(DataFrame.unionByName, [part[1] for part in parts])
    return rows, refused


def transactions_from_csv(
    lines: DataFrame,
    tz: str = "UTC",
    mappings: tuple[BankMapping, ...] = MAPPINGS,
    source: str = "bank_csv",
) -> tuple[DataFrame, DataFrame]:
    """(transactions, refused records) from the lines of statements."""
    rows, refused = parsed_csv(lines, tz, mappings)
    fields = (
        F.col("mapping"),
        F.col("account"),
        iso_instant(F.col("ts")),
        F.col("amount"),
        F.col("currency"),
        F.col("merchant_raw"),
        F.col("balance"),
    )
    rows = occurrences(rows, "ts", *fields)
    return (
        rows.withColumns(
            {
                "source": F.lit(source),
                "source_file": F.col("path"),
                "source_row_id": content_hash(*fields, F.col("occurrence")),
            }
        ),
        refused,
    )


def _of_mapping(
    numbered: DataFrame, files: DataFrame, mapping: BankMapping, tz: str
) -> tuple[DataFrame, DataFrame]:
    lines = numbered.filter(F.col("line_no") > mapping.skip_rows)
    lines = join_facts(lines, files.select("path", "skipped"), "path")
    lines = lines.withColumns(
        {"line": decoded(F.col("line"), mapping.encoding), "_before": F.col("_before") - F.col("skipped")}
    )
    records = csv_records(lines).filter(F.col("text") != "")
    split = records.withColumn("fields", split_csv(F.col("text"), mapping.delimiter))
    facts = files.select("path", "header")
    if mapping.footer:
        ends = (
            records.filter(first_field(F.col("text"), mapping.delimiter).rlike(mapping.footer))
            .groupBy("path")
            .agg(F.min(F.struct(*ORDER)).alias("_end"))
        )
        facts = facts.join(ends, "path", "left")
    records = join_facts(split, facts, "path", counted=numbered)
    if mapping.footer:
        records = records.filter(F.col("_end").isNull() | (F.struct(*ORDER) < F.col("_end")))

    def value(name: str | None) -> Column:
        if not name:
            return F.lit("")
        return F.trim(F.get("fields", F.array_position("header", name.strip().lower()).cast("int") - 1))

    absent = [
        F.when(~F.array_contains("header", name), F.raise_error(F.lit(f"mapping {mapping.id}: missing column {name}")))
        for name in mapping.columns()
    ]
    records = records.withColumn("_complete", F.coalesce(*absent, F.lit(True).cast("string")).isNotNull())
    date = F.when(value(mapping.ts) != "", value(mapping.ts)).otherwise(value(mapping.ts_fallback))
    wall = F.try_to_timestamp(date, F.lit(_time_pattern(mapping))).cast("timestamp_ntz")
    if mapping.amount:
        amount = F.when(value(mapping.amount) != "", _money(value(mapping.amount), mapping))
    else:
        amount = _money(value(mapping.credit), mapping) - _money(value(mapping.debit), mapping)
    amount = (-amount if mapping.invert else amount) - _money(value(mapping.fee), mapping)
    currency = F.lit(mapping.fixed_currency) if mapping.fixed_currency else value(mapping.currency)
    raw = value(mapping.description)
    party = F.lit(None).cast("string")
    if mapping.counterparty:
        party = F.when(value(mapping.counterparty) != "", value(mapping.counterparty))
    elif mapping.counterparty_regex:
        found = raw.rlike(mapping.counterparty_regex)
        party = F.when(found, F.trim(F.regexp_extract(raw, mapping.counterparty_regex, 1)))
    account = F.concat(
        *(
            value(piece[1:-1]) if piece.startswith("{") else F.lit(piece)
            for piece in re.split(r"(\{[^}]+\})", mapping.account)
            if piece
        )
    )
    kind = F.lit(mapping.default_kind)
    if mapping.kind and mapping.kinds:
        table = F.create_map(*(F.lit(x) for pair in mapping.kinds.items() for x in pair))
        kind = F.coalesce(F.try_element_at(table, value(mapping.kind)), kind)
    balance = value(mapping.balance)
    rows = records.withColumns(
        {
            "ts": calendar.localise(wall, tz),
            "amount": amount.cast("decimal(18,2)"),
            "currency": currency,
            "merchant_raw": raw,
            "merchant": normalise_merchant(raw),
            "counterparty": party,
            "category": F.when(value(mapping.category) != "", value(mapping.category)),
            "account": account,
            "balance": F.when(balance != "", _money(balance, mapping)),
            "kind": kind,
            "mapping": F.lit(mapping.id),
            "_wanted": value(mapping.include).isin(list(mapping.include_values))
            if mapping.include
            else F.lit(True),
        }
    )
    good = (
        F.col("_complete")
        & (F.size("fields") == F.size("header"))
        & F.col("ts").isNotNull()
        & F.col("amount").isNotNull()
        & (F.col("currency") != "")
        & ((balance == "") | F.col("balance").isNotNull())
    )
    good = F.coalesce(good, F.lit(False))
    names = [
        "path", "block", "pos", "mapping", "ts", "amount", "currency", "merchant_raw", "merchant",
        "counterparty", "category", "account", "balance", "kind",
    ]
    unwanted = F.coalesce((F.size("fields") == F.size("header")) & ~F.col("_wanted"), F.lit(False))
    refused = rows.filter(~good & ~unwanted).select("path", "block", "pos", "text")
    return rows.filter(good & F.col("_wanted")).select(*names), refused
