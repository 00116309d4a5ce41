"""Raw exports written out from the driver's tables, as the pieces the parsers read.

Positions are dense numbers and blocks are short, so that records, runs of copies and quoted
fields often cross a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronicle.functions import ordered
from chronicle.plans.adapters import table


def _placed(rows: DataFrame, pieces: Column, size: int) -> DataFrame:
    """(path, block, pos, line): the pieces of all records of a path, counted through in the order of `_n`."""
    rows = rows.withColumn("_pieces", pieces).withColumn("_part", F.expr("_n div 64"))
    counted = ordered.running_total(rows, ["path"], "_part", ["_n"], F.size("_pieces"), "_end")
    start = F.col("_end") - F.size("_pieces")
    pieces_at = counted.select("path", start.alias("_start"), F.posexplode("_pieces").alias("_i", "line"))
    place = F.col("_start") + F.col("_i")
    return pieces_at.select("path", F.floor(place / size).alias("block"), place.alias("pos"), "line")


def _lines(df: DataFrame, path: Column, number: Column, text: Column, size: int = 59) -> DataFrame:
    """The lines of one text per row, in the order of `number`; blocks of `size` lines."""
    rows = df.select(path.alias("path"), number.cast("bigint").alias("_n"), text.alias("_text"))
    return _placed(rows, F.split("_text", "\n", -1), size)


def chat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chat file per conversation; every second conversation has each message twice."""
    start = F.lit("2023-01-01 00:00:00").cast("timestamp_ntz")
    at = F.timestamp_add("DAY", F.col("conv_id").cast("int"), start)
    at = F.timestamp_add("MINUTE", F.col("turn").cast("int"), at)
    sender = F.when(F.col("role") == "user", "Me").when(F.col("role") == "system", "Bot").otherwise("Helper")
    rows = table(spark, sf_dir, "conversations").withColumn(
        "copy", F.explode(F.when(F.col("conv_id") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    )
    text = F.concat(F.date_format(at, "dd/MM/yyyy, HH:mm"), F.lit(" - "), sender, F.lit(": "), "text")
    path = F.concat(F.lit("WhatsApp Chat with conv-"), F.col("conv_id").cast("string"), F.lit(".txt"))
    return _lines(rows, path, F.col("turn") * 2 + F.col("copy"), text, size=5)


def one_chat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chat file with every document as a message: a single source holds all rows."""
    start = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    at = F.timestamp_add("MINUTE", F.expr("cast(doc_id div 3 as int)"), start)
    text = F.concat(F.date_format(at, "dd/MM/yyyy, HH:mm"), F.lit(" - "), "lang", F.lit(": "), "text")
    return _lines(table(spark, sf_dir, "documents"), F.lit("everything.txt"), F.col("doc_id"), text)


def _objects(df: DataFrame, path: Column, number: Column, record: Column, opening: str) -> DataFrame:
    """JSON objects of one array per path, cut at every closing brace."""
    lead = F.when(F.col("_n") == F.col("_first"), F.lit(opening)).otherwise(F.lit(",\n"))
    rows = df.select(path.alias("path"), number.cast("bigint").alias("_n"), record.alias("_r"))
    firsts = rows.groupBy("path").agg(F.min("_n").alias("_first"))
    pieces = F.split(F.concat(lead, F.col("_r")), r"\}", -1)
    return _placed(rows.join(firsts, "path"), F.slice(pieces, 1, F.size(pieces) - 1), 257)


def play_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listening history of `orders` in eight files, every second play twice.

    Names hold braces, quotes and backslashes.
    """
    orders = table(spark, sf_dir, "orders").withColumn(
        "copy", F.explode(F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    )
    odd = F.when(F.col("o_custkey") % 3 == 0, F.lit(' }{" \\')).otherwise("")
    record = F.to_json(
        F.struct(
            F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
            F.col("o_totalprice").cast("bigint").alias("ms_played"),
            F.concat("o_orderpriority", odd).alias("master_metadata_track_name"),
            F.concat(F.lit("Artist "), (F.col("o_custkey") % 50).cast("string")).alias("master_metadata_album_artist_name"),
            (F.col("o_orderstatus") == "F").alias("skipped"),
            F.when(F.col("o_orderstatus") == "O", F.lit("an episode")).alias("episode_name"),
        )
    )
    path = F.concat(F.lit("Streaming_History_Audio_"), F.expr("cast(o_orderkey div 2 % 8 as string)"), F.lit(".json"))
    return _objects(orders, path, F.col("o_orderkey") * 2 + F.col("copy"), record, "[")


def visit_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Browser history of `pages`."""
    record = F.to_json(
        F.struct(
            F.substring_index("html", "</title>", 1).alias("title"),
            "url",
            (F.lit(1700000000000000) + F.col("page_id") * 1000001).alias("time_usec"),
            F.lit("LINK").alias("page_transition"),
        )
    )
    opening = '{"Other": [], "Browser History": ['
    return _objects(table(spark, sf_dir, "pages"), F.lit("History.json"), F.col("page_id"), record, opening)


def activity_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity records of `pages`: watches, searches, visits and other products."""
    kind = F.col("page_id") % 5
    title = (
        F.when(kind == 0, F.concat(F.lit("Watched  "), "url"))
        .when(kind == 1, F.lit("Ați vizionat a   page"))
        .when(kind == 2, F.lit("Searched for old words"))
        .when(kind == 3, F.lit("Visited a page"))
        .otherwise(F.lit("Gesucht nach: neu"))
    )
    product = F.when(kind.isin(0, 1, 3), "YouTube").when(kind == 2, "Search").otherwise("Maps")
    link = F.concat(F.lit("https://example.com/search?hl=en&q=page+"), F.col("page_id").cast("string"), F.lit("%21"))
    record = F.to_json(
        F.struct(
            product.alias("header"),
            title.alias("title"),
            link.alias("titleUrl"),
            F.array(F.struct(F.col("url").alias("name"), F.col("url").alias("url"))).alias("subtitles"),
            F.date_format(F.timestamp_seconds(F.lit(1700000000) + F.expr("page_id div 7")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"),
            F.array(product).alias("products"),
            F.when(F.col("page_id") % 2 == 0, F.array(F.struct(F.lit("From Google Ads").alias("name")))).alias("details"),
        )
    )
    return _objects(table(spark, sf_dir, "pages"), F.lit("MyActivity.json"), F.col("page_id"), record, "[")


def activity_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages as cells of an activity page, with escaped titles."""
    page = table(spark, sf_dir, "pages")
    safe = F.replace(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    when = F.timestamp_seconds(F.lit(1700000000) + F.col("page_id") * 61)
    cell = F.concat(
        F.lit(' mdl-cell"><div class="header-cell mdl-cell"><p class="t">YouTube</p></div><div class="content-cell mdl-cell">Watched&nbsp;<a href="'),
        safe, F.lit('">page '), safe, F.lit("</a><br>"), F.date_format(when, "MMM d, yyyy, h:mm:ss a"),
        F.lit(' UTC</div><div class="content-cell"><b>Products:</b><br>YouTube</div></div><div '),
    )
    return page.select(
        F.lit("watch-history.html").alias("path"), F.expr("page_id div 10").alias("block"),
        F.col("page_id").alias("pos"), cell.alias("line"),
    )


def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of `orders` in six files: three per layout, each with its header and footer."""
    orders = table(spark, sf_dir, "orders").withColumn("file", F.col("o_custkey") % 6)
    amount = F.format_string("%.2f", F.col("o_totalprice"))
    shop = F.concat(F.lit("Shop "), (F.col("o_custkey") % 9).cast("string"), F.lit(", the *TX #12 20231 RO"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd 10:30:00")
    kinds = F.create_map(*(F.lit(x) for p in zip("12345", ("CARD_PAYMENT", "TRANSFER", "FEE", "REFUND", "GIFT")) for x in p))
    first = F.concat_ws(
        ",", F.element_at(kinds, F.substring("o_orderpriority", 1, 1)), F.lit("Current"), day,
        F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(day),
        F.concat(F.lit('"'), F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit('a ""b""\n'), shop)).otherwise(shop), F.lit('"')),
        F.concat(F.lit("-"), amount), F.lit("0.125"), F.when(F.col("o_orderkey") % 50 == 7, "").otherwise("EUR"),
        F.when(F.col("o_orderstatus") == "P", "PENDING").otherwise("COMPLETED"), F.lit(""),
    )
    comma = F.replace(amount, F.lit("."), F.lit(","))
    second = F.concat_ws(
        ";", F.date_format("o_orderdate", "dd.MM.yyyy"), F.concat(F.lit("Order "), "o_orderpriority"), comma,
        F.lit(""), F.lit("1.000,00"), "o_orderstatus",
    )
    rows = orders.select("file", (F.col("o_orderkey") + 10).alias("n"), F.when(F.col("file") < 3, first).otherwise(second).alias("text"))
    header = F.when(
        F.col("file") < 3, "Type,Product,Started Date,Completed Date,Description,Amount,Fee,Currency,State,Balance"
    ).otherwise("Statement\nAll accounts\nDate;Details;Debit;Credit;Balance;Category")
    heads = rows.groupBy("file").agg(F.lit(0).cast("bigint").alias("n")).select("file", "n", header.alias("text"))
    last = rows.filter("file >= 3").groupBy("file").agg((F.max("n") + 1).alias("n")).select("file", "n", F.lit("END OF STATEMENT\n01.01.2024;late;1,00;;1,00;x").alias("text"))
    every = rows.unionByName(heads).unionByName(last)
    return _lines(every, F.concat(F.lit("statement"), F.col("file").cast("string"), F.lit(".csv")), F.col("n"), F.col("text"))


def shell_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as commands: one file per format, line breaks as continuations."""
    docs = table(spark, sf_dir, "documents")
    epoch = (F.lit(1700000000) + F.expr("doc_id div 4")).cast("string")
    zsh = F.concat(F.lit(": "), epoch, F.lit(":3;"), F.regexp_replace(F.regexp_replace("text", r"\\", "/"), "\n", "\\\\\n"))
    bash = F.concat(F.lit("#"), epoch, F.lit("\n"), "text")
    return _lines(
        docs, F.when(F.col("doc_id") % 2 == 0, "zsh_history").otherwise("bash_history"), F.col("doc_id"),
        F.when(F.col("doc_id") % 2 == 0, zsh).otherwise(bash),
    )
