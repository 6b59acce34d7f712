"""SQL guard and batches, export fixtures E1-E5, run-log and recurrence."""
import datetime as dt
import glob
import os

import pytest


def local(uri):
    return uri[len("file:"):] if uri.startswith("file:") else uri

from pyspark.sql import functions as F

from sluice.operators import sql as S
from sluice.operators.export import ExportError, export_frame, run_export
from sluice.operators.runlog import due, find_cycles, job_kind, merge_runs, nest_steps, prune_runs, with_next_run
from sluice.options import ExportOptions


@pytest.fixture(scope="module")
def people(spark):
    spark.createDataFrame([("Alice", 10, "北京"), ("Bob", 20, "上海"), ("Carol", 30, "北京")],
                          "name string, amount int, city string").write.mode("overwrite").saveAsTable("export_people")
    return "export_people"


def test_read_only_guard(spark, people):
    cols, rows, truncated = S.read_only_query(spark, "select name, amount from export_people order by amount;")
    assert cols == ["name", "amount"] and rows[0] == ["Alice", "10"] and not truncated
    assert S.read_only_query(spark, "show tables")[0]
    assert S.read_only_query(spark, "describe export_people")[1]
    for bad in ["drop table export_people", "insert into export_people values ('x', 1, 'y')",
                "select 1; drop table export_people", "create table z as select 1 as a",
                "with q as (select 1) insert into export_people select 'a', 1, 'b'"]:
        with pytest.raises((S.ReadOnlyViolation, Exception)):
            S.check_read_only(spark, bad)
    assert spark.catalog.tableExists("export_people")


def test_query_cap(spark):
    spark.range(1500).createOrReplaceTempView("r1500")
    _, rows, truncated = S.read_only_query(spark, "select id from r1500 order by id")
    assert len(rows) == 1000 and truncated


def test_statement_splitter(spark):
    text = "select ';' as a; -- c;\n select 2 /* x; */ ; ; select \"a;b\""
    assert S.split_statements(text) == ["select ';' as a", "-- c;\n select 2 /* x; */", 'select "a;b"']
    assert S.execute_batch(spark, "create or replace temp view v1 as select 1 as x; create or replace temp view v2 as select 2 as y") == 2
    assert spark.table("v2").first()[0] == 2
    S.execute_batch(spark, "create table if not exists aff_t (x int) using parquet")
    assert S.execute_batch(spark, "insert into aff_t values (1), (2); insert into aff_t select 3", affected=True) == 3


def test_e1_e4_exports(spark, tmp_dir, people):
    o = ExportOptions(fmt="csv", fields=("name", "amount"), where="where amount >= 20")
    res = run_export(spark, [{"type": "table", "table": "export_people"}], tmp_dir, o)
    assert res[0].rows == 2
    e2 = export_frame(spark.sql("select name, amount from export_people order by amount"), tmp_dir, "e2", ExportOptions(fmt="csv"))
    text = open(local(e2.files[0]), encoding="utf-8").read()
    assert text.startswith("name,amount")
    e3 = export_frame(spark.table("export_people"), tmp_dir, "e3", ExportOptions(fmt="json", split_field="city"))
    assert sorted(e3.parts) == ["上海", "北京"]
    e4 = export_frame(spark.sql("select name from export_people where city = '北京'"), tmp_dir, "e4", ExportOptions(fmt="xml"))
    assert e4.rows == 2 and open(local(e4.files[0]), encoding="utf-8").read().startswith("<?xml")


def test_export_job_payload(spark, tmp_dir, people):
    from sluice.operators.export import run_export_job

    out = run_export_job(spark, {"extension": "csv", "items": [
        {"type": "table", "table": "export_people"},
        {"type": "query", "name": "bj", "sql": "select name from export_people where city = '北京'"}],
        "beforeSql": "create or replace temp view pre_v as select 1 as x", "splitByBatch": "true", "batchRows": "2"}, tmp_dir)
    assert out["rows"] == 5 and len(out["files"]) >= 3  # every row, two to a file at most


def test_e5_large_and_cap_and_names(spark, tmp_dir):
    big = spark.range(1, 20001).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("n"), F.col("id")).alias("name"),
                                       (F.col("id") % 100).cast("int").alias("amount"))
    r = export_frame(big, tmp_dir, "large", ExportOptions(fmt="csv", max_records_per_file=5000))
    assert r.rows == 20000 and len(r.files) >= 4
    assert open(local(r.files[0]), encoding="utf-8").readline().strip() == "id,name,amount"
    capped = export_frame(big.orderBy("id"), tmp_dir, "large", ExportOptions(fmt="txt", row_cap=10), taken={"large"})
    assert capped.rows == 10 and capped.path.endswith("large_2.txt")
    assert export_frame(big.where("id < 0"), tmp_dir, "empty", ExportOptions(skip_empty=True)) is None
    with pytest.raises(ExportError):
        export_frame(big, tmp_dir, "x", ExportOptions(fmt="xls"))
    with pytest.raises(ExportError):
        export_frame(big, tmp_dir, "x", ExportOptions(time_field="name"))


def test_j2_next_run_modes(spark):
    rules = spark.createDataFrame([
        ("interval", 10, "seconds", None, None, None, None, "", "", ""),
        ("daily", None, None, "09:00:00", None, None, None, "", "", ""),
        ("weekly", None, None, "09:00:00", 1, None, None, "", "", ""),
        ("monthly", None, None, "09:00:00", None, 31, None, "", "", ""),
        ("yearly", None, None, "09:00:00", None, 29, 2, "", "", ""),
        ("once", None, None, None, None, None, None, "2026-01-05", "", "2026-01-01 00:00:00"),
        ("daily", None, None, None, None, None, None, "", "2026-01-01", ""),
    ], "mode string, amount int, unit string, time string, weekday int, day int, month int, "
       "start_at string, end_at string, last_run_at string")
    base = F.lit(dt.datetime(2026, 2, 28, 10, 0, 0)).cast("timestamp_ntz")
    got = [r.next_run_at for r in with_next_run(rules, base).collect()]
    assert got == ["2026-02-28 10:00:10", "2026-03-01 09:00:00", "2026-03-02 09:00:00",
                   "2026-03-31 09:00:00", "2027-02-28 09:00:00", "", ""]


def test_run_log_operators(spark):
    runs = spark.createDataFrame([
        (1, 1, 7, "load", "2026-01-01 09:00:00", "2026-01-01 09:01:00", 60000, "success"),
        (2, 2, 7, "export", "2026-01-01 09:00:00", "2026-01-01 09:02:00", 120000, "failed"),
        (3, 1, 7, "load", "2025-01-01 09:00:00", "2025-01-01 09:01:00", 1000, "success"),
    ], "id long, job_id long, schedule_id long, job_name string, started_at string, ended_at string, elapsed_ms long, status string")
    steps = spark.createDataFrame([
        (1, 2, "s2", "sql", "success", 5), (1, 1, "s1", "import", "success", 5), (2, 1, "sub", "job", "success", 1),
        (2, 2, "e", "export", "failed", 3), (3, 1, "old", "sql", "success", 1),
    ], "run_id long, step_index int, step_name string, step_type string, status string, elapsed_ms long")
    nested = {r.id: r for r in nest_steps(runs, steps).collect()}
    assert [s.step_name for s in nested[1].steps] == ["s1", "s2"] and nested[2].failed == 1
    merged = merge_runs(runs, steps).where("started_at = '2026-01-01 09:00:00'").first()
    assert merged.status == "failed" and merged.elapsed_ms == 120000 and merged.ended_at == "2026-01-01 09:02:00"
    assert [(s.step_index, s.step_name) for s in merged.steps] == [(1, "load / s1"), (2, "load / s2"), (3, "export / e")]
    kept_runs, kept_steps = prune_runs(runs, steps, 30, now=dt.datetime(2026, 1, 10))
    assert sorted(r.id for r in kept_runs.collect()) == [1, 2]
    assert sorted(r.run_id for r in kept_steps.collect()) == [1, 1, 2, 2]
    sched = spark.createDataFrame([(1, 1, 0, "2026-01-01 00:00:00"), (2, 1, 1, "2026-01-01 00:00:00"),
                                   (3, 0, 0, "2026-01-01 00:00:00"), (4, 1, 0, ""), (5, 1, 0, "2027-01-01 00:00:00")],
                                  "id int, enabled int, running int, next_run_at string")
    assert [r.id for r in due(sched, "2026-06-01 00:00:00").collect()] == [1]


def test_job_kind_and_cycles(spark):
    js = spark.createDataFrame([(1, "sql", None), (1, "export", None), (2, "import", None), (3, "job", 2), (4, "job", 1),
                                (5, "job", 3), (6, "job", 5), (7, "job", 99), (8, "job", 9), (9, "job", 8),
                                (10, "job", 2), (10, "job", 3), (11, "job", 2), (11, "sql", None)],
                               "job_id long, step_type string, target_job_id long")
    kinds = {r.job_id: r.kind for r in job_kind(js).collect()}
    assert kinds == {1: "job", 2: "import", 3: "import", 4: "job", 5: "import", 6: "import", 7: "job",
                     8: "job", 9: "job", 10: "job", 11: "job"}
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "job_id long, child_id long")
    assert sorted(r.job_id for r in find_cycles(edges).collect()) == [1, 2, 3]
