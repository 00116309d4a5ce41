"""Bounded reads, exports, profiles and the operator registry."""

from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from chronicle import Params
from chronicle.operators import services
from chronicle.plans import registry


@pytest.fixture
def numbers(spark):
    spark.range(25).withColumn("half", F.col("id") / 2).createOrReplaceTempView("numbers")


@pytest.mark.parametrize("sql", [
    "SELECT id FROM numbers ORDER BY id DESC -- last first", "WITH x AS (SELECT 1 AS a) SELECT * FROM x;",
    "VALUES (1), (2)", "(SELECT id FROM numbers)", "FROM numbers SELECT id",
])
def test_reads_run(spark, numbers, sql):
    assert services.bounded_query(spark, sql).rows


@pytest.mark.parametrize("sql", [
    "", " ; ", "DROP VIEW numbers", "CREATE TABLE t (a INT)", "INSERT INTO numbers VALUES (1)", "SET a=1",
    "SELECT 1; SELECT 2", "SHOW TABLES", "DESCRIBE numbers", "SELECT reflect('java.lang.System', 'exit')",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/region.parquet`", "SELECT nothing FROM numbers",
])
def test_other_statements_are_refused(spark, numbers, sql):
    with pytest.raises(services.QueryRefused):
        services.bounded_query(spark, sql)


def test_rows_are_bounded(spark, numbers):
    found = services.bounded_query(spark, "SELECT id FROM numbers ORDER BY id", limit=10)
    assert [r[0] for r in found.rows] == list(range(10)) and found.truncated
    assert not services.bounded_query(spark, "SELECT id FROM numbers", limit=25).truncated


def test_time_is_bounded(spark):
    slow = "SELECT sum(a.id * b.id % 7) FROM range(30000000) a JOIN range(3000) b ON a.id % 3 = b.id % 3"
    with pytest.raises(services.QueryTimeout):
        services.bounded_query(spark, slow, seconds=1.0)


def test_preview(spark, rows):
    df = spark.createDataFrame(
        [("x" * 600, float("nan"), [1, 2]), ("y", 1.5, None), ("z", float("inf"), [])], "s string, d double, a array<int>"
    )
    got = services.bounded_preview(df, limit=2).collect()
    assert [(len(r["s"]), r["s"][-1], r["d"], r["a"], r["row_count"], r["non_finite"], r["truncated"]) for r in got] == [
        (500, "…", None, "[1,2]", 3, 1, True), (1, "y", 1.5, None, 3, 0, True),
    ]


def test_export(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", [1]), ('"q"', [])], "s string, a array<int>")
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        assert services.export_table(df, path, fmt) == 2
        with pytest.raises(AnalysisException):
            services.export_table(df, path, fmt)
        assert services.export_table(df, path, fmt, force=True) == 2


def test_profile_and_registry(spark, rows):
    ts = "cast(timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) as timestamp) ts"
    tables = {"events": spark.range(3).selectExpr(ts, "'a.b' kind"), "contacts": spark.range(2),
              "messages": spark.range(0).selectExpr(ts)}
    got = {r["table"]: tuple(r)[1:] for r in services.table_profile(tables).collect()}
    assert got["events"] == (3, datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 2))
    assert got["contacts"] == (2, None, None) and got["messages"] == (0, None, None)
    assert ("events", "kind", "string") in rows(services.column_profile(spark, tables), "table", "column", "type")
    mine = registry.OperatorSpec("mine.count", "Count", ("contacts",), lambda t, p: t["contacts"])
    assert [s.id for s in registry.available(tables, (mine,))] == ["cross.life_timeline", "mine.count"]
    with pytest.raises(ValueError):
        registry.operators((mine, mine))


def test_params_are_checked():
    from datetime import date

    for bad in ({"top_n": 0}, {"granularity": "hour"}, {"date_from": date(2024, 2, 1), "date_to": date(2024, 1, 1)}):
        with pytest.raises(ValueError):
            Params(**bad)
    with pytest.raises(Exception):
        Params(tz="Nowhere/Land")


@pytest.mark.parametrize("sql", [
    "SELECT `reflect`('java.lang.Math', 'abs', -7)", "SELECT reflect/**/('java.lang.Math', 'abs', -7)",
    "SELECT try_reflect('java.lang.Math', 'abs', -7)", "SELECT id, input_file_name() FROM numbers",
    "SELECT id FROM numbers WHERE java_method('java.lang.Math', 'abs', -7) = '7'",
])
def test_reflection_is_refused_however_it_is_spelled(spark, numbers, sql):
    with pytest.raises(services.QueryRefused):
        services.bounded_query(spark, sql)


def test_texts_that_look_like_calls_are_read_and_settings_stay(spark, numbers):
    before = spark.conf.get("spark.sql.runSQLOnFiles")
    found = services.bounded_query(spark, "SELECT 'reflect(1)' AS s, id FROM numbers WHERE id < 2")
    assert [r[0] for r in found.rows] == ["reflect(1)"] * 2 and spark.conf.get("spark.sql.runSQLOnFiles") == before
