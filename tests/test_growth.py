"""Steps whose memory or work must not grow beyond the input, and values that larger tables brought up."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

import check
from chronicle.functions import joins, ordered
from chronicle.plans.catalog import QUERIES
from chronicle.sources import bank, classify, lines, plays
from chronicle.streaming.incremental import incremental_ingest


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().sparkPlan().toString()


def test_heads_of_many_short_blocks(spark):
    lines = [(f"{n % 2}.txt", n // 10, n, f"{n:0500d}", "\n") for n in range(2000)]
    samples = spark.createDataFrame(lines, "path string, block bigint, pos bigint, line string, separator string")
    whole = {p: "".join(x[3] + x[4] for x in lines if x[0] == p) for p in ("0.txt", "1.txt")}
    found = {r["path"]: r["text"] for r in classify.heads(samples).collect()}
    assert found == {p: text[: classify.SAMPLE] for p, text in whole.items()}
    # What a file brings to one task stays near 64 KiB, however many blocks it has.
    held = classify.first_lines(samples).groupBy("path").agg(F.sum(F.length("line") + 1).alias("n"))
    assert [r["n"] < classify.SAMPLE + 501 for r in held.collect()] == [True, True]


def test_subscriptions_round_prices_as_sql_does(spark, tmp_path):
    connection = duckdb.connect()
    connection.execute(
        f"""COPY (SELECT (n * 2)::BIGINT AS s_suppkey, 'Supplier#' || n AS s_name, b AS s_acctbal FROM (
        SELECT n, -(900 + n * 0.5)::DOUBLE AS b FROM range(200) r(n))) TO '{tmp_path}/supplier.parquet' (FORMAT parquet)"""
    )
    connection.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet'")
    for name in ("subscriptions", "price_runs"):
        assert check.compare(QUERIES[name].run(spark, str(tmp_path)), connection, QUERIES[name].sql) is None


def test_facts_of_many_files_are_not_repeated(spark, monkeypatch):
    monkeypatch.setattr(joins, "LARGE", 500)
    hot = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id")))
    rows = spark.range(3000).select(hot.alias("path"), F.expr("id div 5").alias("block"), "id")
    facts = rows.select("path").distinct().withColumn("fact", F.concat(F.lit("f-"), "path"))
    spread, repeated = joins.salted(rows, facts, "path", rows)
    assert repeated.count() == 2000 + joins.SALTS
    assert spread.filter("path = 'hot'").select("_salt").distinct().count() == joins.SALTS
    for how, left in (("inner", 3000), ("left", 3000), ("left_semi", 3000)):
        joined = joins.join_facts(rows, facts, "path", how)
        assert joined.count() == left and (how == "left_semi" or joined.filter("fact <> concat('f-', path)").isEmpty())


def test_running_totals_never_broadcast_their_rows(spark):
    rows = spark.range(1000).selectExpr("'a' AS path", "id div 10 AS block", "id AS pos")
    total = ordered.running_total(rows, ["path"], "block", ["block", "pos"], F.lit(1), "n")
    before = ordered.previous_values(rows, ["path"], "block", ["block", "pos"], {"pos": "p"})
    for made in (total, before):
        assert "BroadcastHashJoin" not in plan(made)[1] and "SortMergeJoin" in plan(made)[1]
    assert total.filter("n <> pos + 1").isEmpty() and before.filter("NOT p <=> nullif(pos - 1, -1)").isEmpty()


def test_a_play_is_parsed_once(spark):
    record = '{"ts": "2020-01-01T00:00:00Z", "ms_played": 5, "master_metadata_track_name": "t"}'
    rows = [("Streaming_History_Audio_1.json", 0, 0, record), ("Streaming_History_Audio_1.json", 0, 1, "{}")]
    records = spark.createDataFrame(rows, "path string, block bigint, pos bigint, record string")
    parsed, refused = plays.plays_from_json(records)
    assert plan(refused)[0].count("from_json") == 1 and parsed.count() == refused.count() == 1


def test_only_records_with_line_breaks_are_grouped(spark, monkeypatch):
    given = []
    join = bank.join_pieces
    monkeypatch.setattr(bank, "join_pieces", lambda rows, by: given.append(rows.count()) or join(rows, by))
    # The quote before the header opens no field of a record.
    head = ['Statement 5"', "All accounts", "Date;Details;Debit;Credit;Balance;Category"]
    body = [f'01.01.2024;"a\n""b"" {n}";1,00;;1,00;x' if n % 10 == 0 else f"01.01.2024;shop {n};1,00;;1,00;x" for n in range(300)]
    text = "\n".join([*head, *body, "END OF STATEMENT", "01.01.2024;late;1,00;;1,00;x"]).split("\n")
    pieces = spark.createDataFrame([("s.csv", n // 7, n, line) for n, line in enumerate(text)], "path string, block bigint, pos bigint, line string")
    rows, refused = bank.parsed_csv(pieces)
    found = [r["merchant_raw"] for r in rows.orderBy("block", "pos").collect()]
    assert found == [f'a\n"b" {n}' if n % 10 == 0 else f"shop {n}" for n in range(300)]
    assert refused.count() == 0 and given == [60, 0]


def test_splits_are_read_in_short_blocks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("".join(f"{n}\n" for n in range(100_000)))
    longest = "max(n)", "count(*)"
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (kept, "100k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            pieces = lines.read_lines(spark, str(tmp_path / "in"))
            n = pieces.groupBy("block").agg(F.count("*").alias("n")).selectExpr(*longest).first()
            assert n[0] <= lines.BLOCK_LINES and n[1] >= 7
            assert lines.number_lines(pieces).filter("line_no <> CAST(line AS bigint)").isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    seen = []

    def parse(pieces):
        seen.append(pieces.groupBy("block").agg(F.count("*").alias("n")).selectExpr(*longest).first())
        place = F.struct("block", "pos")
        assert pieces.agg(F.max_by("line", place).alias("l")).first()["l"] == "99999"
        return pieces.selectExpr(
            "path", "block", "pos", "'s' AS source", "path AS source_file", "line AS source_row_id",
            "timestamp_seconds(1) AS ts", "'k' AS kind", "line AS title",
        ).limit(1)

    incremental_ingest(
        spark, str(tmp_path / "in"), parse, "events", str(tmp_path / "w"), str(tmp_path / "c"), "shell_history"
    ).awaitTermination()
    assert [n[0] <= lines.BLOCK_LINES and n[1] == 7 for n in seen] == [True]
