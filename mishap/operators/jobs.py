"""The log of phase runs: latest runs, recent runs, time spent, failure streaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_runs(jobs: DataFrame, by: list[str]) -> DataFrame:
    """The last started run of each key; of runs started at once that with the larger id."""
    order = Window.partitionBy(*by).orderBy(F.desc("started_at"), F.desc("id"))
    return jobs.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def is_done(jobs: DataFrame, sha: str) -> DataFrame:
    """(repo, phase, done): whether the latest run at the commit succeeded."""
    runs = latest_runs(jobs.where(F.col("analyzed_sha") == sha), ["repo", "phase"])
    return runs.select("repo", "phase", (F.col("status") == "success").alias("done"))


def recent_runs(jobs: DataFrame, n: int = 5) -> DataFrame:
    """(repo, recent): the last n runs as "phase:status", newest first."""
    order = Window.partitionBy("repo").orderBy(F.desc("started_at"), F.desc("id"))
    rows = jobs.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n)
    rows = rows.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("__n", F.concat_ws(":", "phase", "status").alias("s")))).alias("r"))
    return rows.select("repo", F.transform("r", lambda x: x["s"]).alias("recent"))


def status_table(repos: DataFrame, jobs: DataFrame) -> DataFrame:
    """Repos with their recent runs, by name."""
    return repos.join(recent_runs(jobs), "repo", "left").orderBy("repo")


def phase_time(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'success'").groupBy("phase").agg(F.sum("duration_ms").alias("ms"))


def failure_streaks(jobs: DataFrame, by: list[str], breaker: int = 5) -> DataFrame:
    """Adds streak, the failures in a row up to each run, and tripped, whether the breaker had opened."""
    order = Window.partitionBy(*by).orderBy("started_at", "id")
    ok = F.when(F.col("status") == "success", 1).otherwise(0)
    rows = jobs.withColumn("__island", F.sum(ok).over(order))
    inside = Window.partitionBy(*by, "__island").orderBy("started_at", "id")
    streak = F.sum(F.when(F.col("status") == "success", 0).otherwise(1)).over(inside)
    return rows.withColumn("streak", streak).withColumn("tripped", F.col("streak") >= breaker).drop("__island")


def alerts(jobs: DataFrame, by: list[str], after: int = 2, again: int = 12) -> DataFrame:
    """Runs that send a note: (..., streak, note). 'failing' at `after` failures in a row and at each multiple of
    `again`; 'recovered' at the success that ends so long a row, streak then being the failures before it."""
    rows = failure_streaks(jobs, by, after)
    before = F.coalesce(F.lag("streak").over(Window.partitionBy(*by).orderBy("started_at", "id")), F.lit(0))
    ok = F.col("status") == "success"
    note = F.when(ok & (before >= after), "recovered").when(~ok & ((F.col("streak") == after) | (F.col("streak") % again == 0)), "failing")
    rows = rows.withColumn("note", note).withColumn("streak", F.when(ok, before).otherwise(F.col("streak"))).drop("tripped")
    return rows.where("note is not null")


def without_orphans(jobs: DataFrame, protected: DataFrame) -> DataFrame:
    """The log without 'running' rows, but for protected repos."""
    return jobs.where("status != 'running' or status is null").unionByName(jobs.where("status = 'running'").join(protected.select("repo"), "repo", "left_semi").select(*jobs.columns))


def with_duration(rows: DataFrame) -> DataFrame:
    return rows.withColumn("duration_ms", F.col("completed_at") - F.col("started_at"))


def batches(rows: DataFrame, by: list[str], order: str, size: int) -> DataFrame:
    """Adds batch: consecutive rows of a key in groups of `size`."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("batch", F.floor((n - 1) / size).cast("long"))


def record_runs(log: DataFrame, runs: DataFrame) -> DataFrame:
    """The log with runs put behind it; what they lack is null, their duration is what they took."""
    rows = with_duration(runs) if "completed_at" in runs.columns else runs
    return log.unionByName(rows.select(*(F.col(c).cast(log.schema[c].dataType).alias(c) if c in rows.columns else F.lit(None).cast(log.schema[c].dataType).alias(c) for c in log.columns)))
