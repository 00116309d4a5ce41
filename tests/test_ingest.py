"""Idempotent appends: repeats, overlaps, refusals, failures and incremental passes."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chronicle import schema
from chronicle.operators import ingest
from chronicle.sources import chat, lines
from chronicle.streaming.incremental import incremental_ingest


def chat_rows(spark, tmp_path, name, texts):
    folder = tmp_path / name
    folder.mkdir()
    body = "".join(f"{day:02}/01/2024, 10:00 - Ana: {text}\n" for day, text in texts)
    (folder / "WhatsApp Chat with Ana.txt").write_text(body, encoding="utf-8")
    return chat.chat_messages(lines.read_lines(spark, str(folder)))[0]


def test_overlapping_exports_add_only_new_rows(spark, tmp_path):
    warehouse = str(tmp_path / "w")
    first = chat_rows(spark, tmp_path, "a", [(13, "one"), (13, "one"), (14, "two")])
    second = chat_rows(spark, tmp_path, "b", [(13, "one"), (13, "one"), (14, "two"), (15, "three")])
    runs = [ingest.run_import(rows, "messages", warehouse, "whatsapp", tz="UTC") for rows in (first, first, second)]
    assert [(r.seen, r.inserted) for r in runs] == [(3, 3), (3, 0), (4, 1)]
    stored = ingest.read_table(spark, f"{warehouse}/messages")
    assert stored.count() == 4 and stored.select("id").distinct().count() == 4
    assert {f.name for f in schema.fact_schema("messages")} | {"month"} == set(stored.columns)
    ledger = ingest.imports(spark.read.parquet(f"{warehouse}/imports"))
    assert ledger.filter("status = 'succeeded'").count() == 3
    latest = ingest.latest_per_connector(ledger).collect()
    assert [(r["connector"], r["imports"], r["rows_inserted"]) for r in latest] == [("whatsapp", 3, 1)]


def test_failed_import_is_recorded_and_can_be_repeated(spark, tmp_path):
    warehouse = str(tmp_path / "w")
    rows = chat_rows(spark, tmp_path, "a", [(13, "one"), (14, "two")])
    broken = rows.withColumn("text", F.when(F.col("text") == "two", F.raise_error(F.lit("no"))).otherwise(F.col("text")))
    with pytest.raises(Exception):
        ingest.run_import(broken, "messages", warehouse, "whatsapp")
    assert ingest.imports(spark.read.parquet(f"{warehouse}/imports")).first()["status"] == "failed"
    assert ingest.run_import(rows, "messages", warehouse, "whatsapp").inserted == 2


def test_first_copy_wins(spark):
    rows = spark.createDataFrame([("x", 2, "late"), ("x", 1, "early"), ("y", 3, "only")], "id string, pos int, text string")
    assert sorted(ingest.first_rows(rows, ("pos",)).select("id", "text").collect()) == [("x", "early"), ("y", "only")]


def test_bad_rows_are_refused_with_a_reason(spark, tmp_path):
    ok = ("s", "f", "1", datetime(2024, 1, 1), "5.00", "EUR", "a", "card")
    bad = [("s", "f", "2", None, "5.00", "EUR", "a", "card"), ("s", "f", "3", ok[3], "1e16", "EUR", "a", "card"),
           ("s", "f", "4", ok[3], "5.00", "EUR", "a", "gift"), ("s", "f", " ", ok[3], "5.00", "EUR", "a", "card")]
    rows = spark.createDataFrame([ok, *bad], "source string, source_file string, source_row_id string, ts timestamp, amount string, currency string, account string, kind string")
    rows = rows.withColumn("amount", F.col("amount").cast("decimal(38,2)"))
    accepted, refused = schema.validate_rows(rows, "transactions")
    assert accepted.count() == 1
    assert sorted(r["reason"] for r in refused.collect()) == ["amount is out of range", "kind is unknown", "source_row_id is empty", "ts is missing"]
    stored = ingest.append_new(rows, "transactions", str(tmp_path / "t"), "run")
    assert (stored.seen, stored.inserted, stored.refused) == (1, 1, 4)


def test_an_id_is_stored_once_whatever_its_month(spark, tmp_path):
    rows = spark.createDataFrame(
        [("s", "k", datetime(2024, m, 5), "shell.command", "t", "{}") for m in (1, 2)],
        "source string, source_row_id string, ts timestamp, kind string, title string, meta string",
    )
    path = str(tmp_path / "t")
    stored = [ingest.append_new(rows.filter(F.month("ts") == m), "events", path, f"run-{m}") for m in (1, 2)]
    assert [r.inserted for r in stored] == [1, 0]
    assert ingest.read_table(spark, path).count() == 1


def test_only_ids_of_stored_rows_are_read(spark, tmp_path):
    base = spark.range(400).selectExpr("'s' source", "cast(id as string) source_row_id", "timestamp_seconds(1704067200 + id * 86400) ts")
    keyed = ingest.keyed(base)
    keyed.write.partitionBy("month").parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    left = ingest.unseen(keyed.filter("month = '2024-03'"), stored)
    assert left.count() == 0
    assert "ReadSchema: struct<id:string>" in left._jdf.queryExecution().executedPlan().toString()


def test_an_unreadable_table_is_an_error(spark, tmp_path):
    assert ingest.read_table(spark, str(tmp_path / "none")) is None
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        ingest.read_table(spark, str(broken))


def test_incremental_passes_take_new_files_only(spark, tmp_path):
    exports, warehouse = tmp_path / "in", str(tmp_path / "w")
    exports.mkdir()

    def arrive(name, days):
        body = "".join(f"{day:02}/01/2024, 10:00 - Ana: day {day}\n" for day in days)
        (exports / name).write_text(body, encoding="utf-8")

    def run():
        query = incremental_ingest(
            spark, str(exports), lambda pieces: chat.chat_messages(pieces)[0], "messages", warehouse,
            str(tmp_path / "checkpoint"), "whatsapp", files_per_batch=1,
        )
        query.awaitTermination()
        return ingest.read_table(spark, f"{warehouse}/messages").count()

    arrive("a.txt", [13, 14])
    assert run() == 2
    # An old message arrives late, and the second file repeats a known one.
    arrive("b.txt", [14, 15])
    arrive("c.txt", [20])
    assert run() == 4
    assert run() == 4
