"""Run-log and recurrence operators (LOG-1..11) over ordinary tables.

Run-log tables: runs(id, job_id, schedule_id, job_name, started_at, ended_at,
elapsed_ms, status, message) and steps(id, run_id, step_index, step_name,
step_type, started_at, ended_at, elapsed_ms, status, message); import log
(id, created_at, file_name, table_name, mode, rows_read, rows_written,
rows_updated, rows_skipped, status, message); schedules(..., enabled,
running, next_run_at).  Times are ``YYYY-MM-DD HH:MM:SS`` text.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.clock import now as clock_now
from sluice.functions.clock import now_col, now_text
from sluice.functions.schedule import next_run
from sluice.operators.cycles import find_cycles  # noqa: F401 - one of the run-log operators
from sluice.session import cut

# Listing sizes of the log views.
IMPORT_LOG_ROWS = 50
RUN_LIST_ROWS = 80

IMPORT_LOG_SCHEMA = (
    "id string, created_at string, file_name string, table_name string, mode string, rows_read long, "
    "rows_written long, rows_updated long, rows_skipped long, status string, message string"
)


def import_log_rows(spark: SparkSession, results, mode: str, created_at: str | None = None) -> DataFrame:
    """LOG-1: one log row per imported file (results of ``import_path``)."""
    import uuid

    now = created_at or now_text()
    rows = []
    for r in results:
        res = r.result
        rows.append((uuid.uuid4().hex, now, r.file_name, r.table, mode, int(r.rows_read),
                     int(res.rows_written if res else 0), int(res.rows_updated if res else 0),
                     int(res.rows_skipped if res else 0), r.status, r.message))
    return spark.createDataFrame(rows, IMPORT_LOG_SCHEMA)


def append_import_log(spark: SparkSession, log_table: str, rows: DataFrame) -> None:
    if spark.catalog.tableExists(log_table):
        rows.write.insertInto(log_table)
    else:
        rows.write.format("parquet").saveAsTable(log_table)


def latest(df: DataFrame, time_col: str = "created_at", n: int = IMPORT_LOG_ROWS) -> DataFrame:
    """LOG-2: newest entries first (a top-k: TakeOrdered, no full sort)."""
    return df.orderBy(F.col(time_col).desc(), F.col(df.columns[0]).desc()).limit(n)


def nest_steps(runs: DataFrame, steps: DataFrame, *, job_id=None, schedule_id=None, limit: int | None = RUN_LIST_ROWS) -> DataFrame:
    """LOG-3 + LOG-5: runs (optionally filtered) with their steps nested in
    step order and succeeded/failed counts.  Steps are grouped per run before
    the join, so each run's list is built from partial aggregates."""
    if job_id is not None:
        runs = runs.where(F.col("job_id") == job_id)
    if schedule_id is not None:
        runs = runs.where(F.col("schedule_id") == schedule_id)
    if limit:
        runs = runs.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(limit)
        # only the listed runs' steps are grouped: a semi join against at most
        # ``limit`` ids (a proven-small broadcast)
        ids = F.broadcast(runs.select(F.col("id").alias("__rid")))
        steps = steps.join(ids, steps["run_id"] == ids["__rid"], "left_semi")
    step_struct = F.struct(*[F.col(c) for c in steps.columns if c != "run_id"])
    grouped = steps.groupBy("run_id").agg(
        F.array_sort(F.collect_list(step_struct), lambda a, b: F.when(a["step_index"] < b["step_index"], -1)
                     .when(a["step_index"] > b["step_index"], 1).otherwise(0)).alias("steps"),
        F.count_if(F.col("status") == "success").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    out = runs.join(grouped, runs["id"] == grouped["run_id"], "left").drop("run_id")
    return out.select(
        *runs.columns,
        F.coalesce(F.col("steps"), F.array()).alias("steps"),
        F.coalesce(F.col("succeeded"), F.lit(0)).alias("succeeded"),
        F.coalesce(F.col("failed"), F.lit(0)).alias("failed"),
    )


def merge_runs(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """LOG-4: runs of one schedule started at the same time form one merged run.

    Root = the run with the earliest id; end = max end; elapsed = max; status
    failed if any run failed; child steps renamed ``job / step``, steps of type
    ``job`` dropped, renumbered 1..n in (run, step) order.
    """
    key = ["schedule_id", "started_at"]
    s = steps.where(F.col("step_type") != "job")
    r = runs.select("id", "job_name", *key)
    joined = s.join(r.withColumnRenamed("id", "run_id"), "run_id")
    step_rows = joined.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("run_id").alias("run"), F.col("step_index").alias("index"),
            F.concat_ws(" / ", F.col("job_name"), F.col("step_name")).alias("step_name"),
            F.col("step_type"), F.col("status"), F.col("elapsed_ms"),
        ))).alias("__steps")
    )
    merged = runs.groupBy(*key).agg(
        F.min("id").alias("id"),
        F.min_by("job_name", "id").alias("job_name"),
        F.max("ended_at").alias("ended_at"),
        F.max("elapsed_ms").alias("elapsed_ms"),
        F.when(F.bool_or(F.col("status") == "failed"), F.lit("failed")).otherwise(F.lit("success")).alias("status"),
        F.count(F.lit(1)).alias("runs"),
    )
    out = merged.join(step_rows, key, "left")
    steps_col = F.transform(
        F.coalesce(F.col("__steps"), F.array()),
        lambda x, i: F.struct((i + 1).alias("step_index"), x["step_name"].alias("step_name"),
                              x["step_type"].alias("step_type"), x["status"].alias("status"),
                              x["elapsed_ms"].alias("elapsed_ms")),
    )
    return out.withColumn("steps", steps_col).drop("__steps")


def prune_runs(runs: DataFrame, steps: DataFrame, retention_days: int, now: dt.datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """LOG-6: drop runs started before now - n days (n at least 1) and their steps.

    Steps are removed with an anti join against the *ids* of old runs only.
    """
    cutoff = now_text((now or clock_now()) - dt.timedelta(days=max(int(retention_days), 1)))
    old = runs.where(F.col("started_at") < cutoff).select(F.col("id").alias("__old"))
    kept_runs = runs.where(~(F.col("started_at") < cutoff) | F.col("started_at").isNull())
    kept_steps = steps.join(old, steps["run_id"] == old["__old"], "left_anti")
    return kept_runs, kept_steps


def due(schedules: DataFrame, now: dt.datetime | str | None = None) -> DataFrame:
    """LOG-7: enabled, not running, next run set and not after now."""
    at = now if isinstance(now, str) else now_text(now)
    return schedules.where(
        (F.col("enabled") == 1) & (F.col("running") == 0)
        & (F.coalesce(F.col("next_run_at"), F.lit("")) != "") & (F.col("next_run_at") <= at)
    )


def with_next_run(rules: DataFrame, base: Column | None = None, out: str = "next_run_at") -> DataFrame:
    """LOG-8 over a table of rules (columns named as in the rule)."""
    cols = set(rules.columns)

    def c(name):
        return F.col(name) if name in cols else F.lit(None)

    from sluice.operators.order import balance

    b = base if base is not None else now_col()
    return balance(rules).withColumn(out, next_run(
        c("mode"), b, amount=c("amount"), unit=c("unit"), time=c("time"), weekday=c("weekday"),
        day=c("day"), month=c("month"),
        start_at=F.coalesce(c("start_at"), F.lit("")), end_at=F.coalesce(c("end_at"), F.lit("")),
        last_run_at=F.coalesce(c("last_run_at"), F.lit("")),
    ))


def job_kind(job_steps: DataFrame) -> DataFrame:
    """LOG-10: a job's kind from its steps ``(job_id, step_type, target_job_id)``.

    A job whose only step runs another job takes that job's kind, followed
    through any depth; a missing target, or a chain that loops, gives ``job``.
    Otherwise: one distinct step type -> that type, several -> ``job``.

    Chains are followed by pointer jumping over the open jobs and the jobs that
    open ones point at; all others are settled before the first round.  Every
    round an open job takes over what its target knows by then, so the distance
    covered doubles; a chain without a loop is at most n open jobs long, so after
    ceil(log2 n) + 1 rounds anything still open is a loop.
    """
    import math

    per_job = job_steps.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("__steps"),
        F.count_distinct("step_type").alias("__types"),
        F.min("step_type").alias("__type"),
        F.min("target_job_id").alias("__target"),
    )
    single = (F.col("__steps") == 1) & (F.col("__type") == "job")
    state = per_job.select(
        "job_id",
        F.when(single, F.col("__target")).alias("cur"),
        F.when(single & F.col("__target").isNull(), F.lit("job")).when(single, F.lit(None).cast("string"))
        .when(F.col("__types") == 1, F.col("__type")).otherwise(F.lit("job")).alias("kind"),
    )
    state = cut(state)
    settled = state.filter("kind IS NOT NULL").select("job_id", "kind")
    open_jobs = cut(state.filter("kind IS NULL").select("job_id", "cur"))
    asked = open_jobs.select(F.col("cur").alias("job_id")).distinct()
    known = cut(settled.join(asked, "job_id", "left_semi"))
    n, found = open_jobs.count(), []
    for _ in range(int(math.ceil(math.log2(max(n, 2)))) + 1):
        if open_jobs.isEmpty():
            break
        answers = known.select(F.col("job_id").alias("t_id"), F.lit(None).cast(open_jobs.schema["cur"].dataType).alias("t_cur"), F.col("kind").alias("t_kind"))
        answers = answers.union(open_jobs.select("job_id", "cur", F.lit(None).cast("string")))
        met = cut(open_jobs.join(answers, F.col("cur") == F.col("t_id"), "left").select(
            "job_id", F.col("t_cur").alias("cur"), F.when(F.col("t_id").isNull(), F.lit("job")).otherwise(F.col("t_kind")).alias("kind")))
        found.append(met.filter("kind IS NOT NULL").select("job_id", "kind"))
        known = known.union(found[-1])
        open_jobs = met.filter("kind IS NULL").select("job_id", "cur")
    out = settled.union(open_jobs.select("job_id", F.lit("job").alias("kind")))
    for more in found:
        out = out.union(more)
    return out
