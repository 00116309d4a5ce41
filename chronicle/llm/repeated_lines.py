"""Line dedup by winnowing: later copies of repeated runs of lines are deleted. DataFrame functions only.

A document is the sequence of its lines that are not blank, compared without white space at their ends. A run counts if it has at
least `run` lines or more than `LONG` words, were it one line; shorter runs, as common short lines make them, stay. Windows are
the `run` consecutive lines at each place, and the fewer lines there that have more than `LONG` words, so that windows cover every run that
counts. A run that is in a window which occurred earlier, in the order of keys and then of lines, is deleted with the blank lines inside
it; the first occurrence of every window stays.

Of every window the least line hash is selected (the first of equal ones), so two copies of a window select the same line: a guaranteed fingerprint. Only
selected positions are shuffled, with the hashes of the `run` - 1 lines on both sides. Each is joined with the first position of its fingerprint,
and the match is extended both ways from there, line hash by line hash; an extended match that counts is a run. A window beyond its
match may still repeat another position than the first, where a common line stands among different lines. Only such windows are written and grouped:
what is not the first of its group is a run too. Runs of a document that overlap or touch grow into one.

Words are separated by white space (ASCII), so a long line of a script without spaces is one word and counts by lines only.

Hot lines and copies: positions are aggregated before they are shuffled (the count and first position of each fingerprint or window) and never
paired with each other; joins meet one row for each fingerprint or window, so Spark may split their large side. Line hashes have 64 bits, and a match needs all of a window's in a row: one for a long line, or up to `run`.

Defined results: null text counts no lines and stays null; empty and blank texts, and documents without a run that counts, stay as
they are; rows that repeat key and text are one document, so they lose the same lines; keys may be null (they come first); an empty
table gives an empty table. `deduplicated` keeps all columns; the names that it uses for itself begin with an underscore.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronicle.llm.frames import kept

RUN = 3
LONG = 50  # a run of more words counts, however few lines it has
_ENDS = " \t\r"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(run: int) -> list[tuple[int, int]]:
    """(first, last) places of the windows that hold the middle of 2 * run - 1 lines."""
    return [(a, a + n - 1) for n in range(1, run + 1) for a in range(run - n, run)]


def _place(lines: Column, i: int, field: str) -> Column:
    return F.get(lines, F.lit(i))[field]


def _words(lines: Column, a: int, b: int) -> Column:
    return sum((F.coalesce(_place(lines, i, "words"), F.lit(0)) for i in range(a, b + 1)), F.lit(0))


def _selects(lines: Column, a: int, b: int, run: int, long: int) -> Column:
    """Whether the window is one, and selects the middle line: less than all before it, and than or equal to all after it."""
    middle, least = _place(lines, run - 1, "h"), F.lit(True)
    for i in range(a, b + 1):
        if i < run - 1:
            least = least & (middle < _place(lines, i, "h"))
        elif i >= run:
            least = least & (middle <= _place(lines, i, "h"))
    counts = F.lit(True) if b - a + 1 == run else _words(lines, a, b) > long
    return F.coalesce(least & counts, F.lit(False))  # null where the document ends inside


def positions(docs: DataFrame, key: str, text: str, run: int, long: int = LONG) -> DataFrame:
    """(_key, _print, least, at, around): each selected position, with the lines around it (null beyond the document's ends)."""
    numbered = F.transform(
        lines_of(F.col("_text")), lambda line, i: F.struct(i.alias("i"), F.btrim(line, F.lit(_ENDS)).alias("line"))
    )
    hashed = F.transform(
        F.filter(numbered, lambda x: x["line"] != ""),
        lambda x: F.struct(
            F.xxhash64(x["line"]).alias("h"), x["i"].alias("i"), F.size(F.split(x["line"], r"\s+")).alias("words")
        ),
    )
    beyond = F.array_repeat(F.lit(None).cast("struct<h: bigint, i: int, words: int>"), run - 1)
    places = F.transform(
        F.sequence(F.lit(1), F.size("_lines")), lambda i: F.slice(F.col("_wide"), i, 2 * run - 1)
    )
    around = F.col("around")
    selected = reduce(lambda x, w: x | _selects(around, *w, run, long), _windows(run), F.lit(False))
    return (
        docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_print"), F.col(text).alias("_text"))
        .withColumn("_lines", hashed)
        .filter(F.size("_lines") > 0)
        .withColumn("_wide", F.concat(beyond, "_lines", beyond))
        .select("_key", "_print", F.explode(places).alias("around"))
        .filter(selected)
        .select("_key", "_print", _place(around, run - 1, "h").alias("least"), _place(around, run - 1, "i").alias("at"), "around")
    )


def _extended(later: DataFrame, run: int) -> DataFrame:
    """Adds `a` and `b`: the places in `around` to which the match with the lines around the first position extends."""
    around, first = F.col("around"), F.col("origin")["around"]
    same = [F.coalesce(_place(around, i, "h") == F.get(first, F.lit(i)), F.lit(False)) for i in range(2 * run - 1)]
    left = right = F.lit(0)
    for i in range(run - 1):
        left = F.when(same[i], left + 1).otherwise(F.lit(0))  # so many lines up to this one, without a gap
        right = F.when(same[2 * run - 2 - i], right + 1).otherwise(F.lit(0))
    return later.withColumns({"a": F.lit(run - 1) - left, "b": F.lit(run - 1) + right})


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """(_key, _print, first, last): maximal runs of lines, numbered from 0, that repeat earlier ones."""
    selected, _ = kept(positions(docs, key, text, run), "positions")
    around = F.col("around")
    # Written, since Spark splits a join's frequent key only where no aggregate shares the join's shuffle.
    common, _ = kept(
        selected.groupBy("least")
        .agg(F.count("*").alias("n"), F.min(F.struct("_key", "_print", "at", F.col("around.h").alias("around"))).alias("origin"))
        .filter("n > 1")
        .select("least", "origin"),
        "fingerprints",
    )
    place = F.struct("_key", "_print", "at")
    later = selected.join(common, "least").filter(place != F.struct("origin._key", "origin._print", "origin.at"))
    later, _ = kept(_extended(later, run).drop("origin", "least", "at"), "later")
    inside = F.slice(around, F.col("a") + 1, F.col("b") - F.col("a") + 1)
    counts = (F.size(inside) >= run) | (F.aggregate(inside, F.lit(0), lambda n, x: n + x["words"]) > LONG)
    grown = later.filter(counts).select(
        "_key", "_print", F.get(inside, F.lit(0))["i"].alias("first"), F.element_at(inside, -1)["i"].alias("last")
    )
    beyond = F.array_compact(
        F.array(
            *[
                F.when(
                    _selects(around, a, b, run, LONG) & ((F.col("a") > a) | (F.col("b") < b)),
                    F.slice(around, a + 1, b - a + 1),
                )
                for a, b in _windows(run)
            ]
        )
    )
    windows = later.select("_key", "_print", F.explode(beyond).alias("w")).select(
        "_key", "_print", F.get("w", F.lit(0))["i"].alias("first"), F.element_at("w", -1)["i"].alias("last"), F.col("w.h").alias("lines")
    )
    windows, _ = kept(windows, "windows")
    earliest, _ = kept(
        windows.groupBy("lines")
        .agg(F.min(F.struct("_key", "_print", "first")).alias("origin"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("lines", "origin"),
        "earliest",
    )
    others = windows.join(earliest, "lines").filter(F.struct("_key", "_print", "first") != F.col("origin"))
    matches = (
        grown.unionByName(others.select("_key", "_print", "first", "last"))
        .groupBy("_key", "_print", "first")
        .agg(F.max("last").alias("last"))
    )
    # Matches of a document that overlap or touch are one run. Windows come in the order of their starts and ends.
    before = F.max("last").over(
        Window.partitionBy("_key", "_print").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    )
    opens = (before.isNull() | (F.col("first") > before + 1)).cast("int")
    number = F.sum("_opens").over(Window.partitionBy("_key", "_print").orderBy("first"))
    return (
        matches.withColumn("_opens", opens)
        .withColumn("_run", number)
        .groupBy("_key", "_print", "_run")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .drop("_run")
    )


def _rest(lines: Column, runs: Column) -> Column:
    """The lines outside the runs (sorted by start), as one text."""
    pieces = F.transform(
        F.concat(runs, F.array(F.struct(F.size(lines).alias("first"), F.size(lines).alias("last")))),
        lambda r, i: F.slice(
            lines,
            F.when(i == 0, 0).otherwise(F.element_at(runs, i)["last"] + 1) + 1,
            r["first"] - F.when(i == 0, 0).otherwise(F.element_at(runs, i)["last"] + 1),
        ),
    )
    return F.array_join(F.flatten(pieces), "\n")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """`docs` with the text that is left, and _n_lines, _n_removed, _n_runs (blank lines in runs count as removed)."""
    runs = repeated_runs(docs, key, text, run)
    spans = runs.groupBy("_key", "_print").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("_runs"))
    spans = spans.withColumnsRenamed({"_key": "_run_key", "_print": "_run_print"})
    marked = docs.withColumn("_print", F.xxhash64(text))
    joined = marked.join(
        spans, marked[key].eqNullSafe(spans["_run_key"]) & (marked["_print"] == spans["_run_print"]), "left"
    )
    removed = F.aggregate("_runs", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    return joined.withColumns(
        {
            "_n_lines": F.coalesce(F.size(lines_of(F.col(text))), F.lit(0)).cast("long"),
            "_n_removed": F.coalesce(removed, F.lit(0).cast("long")),
            "_n_runs": F.greatest(F.coalesce(F.size("_runs"), F.lit(0)), F.lit(0)).cast("long"),
            text: F.when(F.col("_runs").isNull(), F.col(text)).otherwise(_rest(lines_of(F.col(text)), F.col("_runs"))),
        }
    ).drop("_print", "_run_key", "_run_print", "_runs")


def digest(docs: DataFrame) -> DataFrame:
    """The registered query's columns."""
    return deduplicated(docs.select("doc_id", "text")).select(
        "doc_id",
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.col("_n_lines")).cast("long").alias("n_lines"),
        F.col("_n_removed").alias("n_removed"),
        F.col("_n_runs").alias("n_runs"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """Documents without later repeated runs, with all their columns; those of which nothing but blanks is left are dropped.

    `n_chars`, where there is one, is the length of the new text.
    """
    out = deduplicated(docs)
    out = out.filter((F.col("_n_removed") == 0) | (F.regexp_replace("text", r"\s", "") != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn(
            "n_chars", F.when(F.col("_n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        )
    return out.select(*docs.columns)
