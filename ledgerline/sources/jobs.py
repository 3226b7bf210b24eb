"""Job-run snapshots with nested tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.status import present
from ledgerline.functions.timing import from_millis, span_seconds
from ledgerline.schemas import JOB_STATES


def read_snapshots(texts: DataFrame, column: str = "snapshot") -> DataFrame:
    """Snapshot columns from one JSON document per row."""
    parsed = F.from_json(F.col(column), JOB_STATES).alias("_s")
    return texts.select(*[c for c in texts.columns if c != column], parsed).select(
        *[c for c in texts.columns if c != column], "_s.*")


def job_runs(snapshots: DataFrame, as_of: Column) -> DataFrame:
    """State, times and whole seconds of every job run.

    A run that has not started counts as started ``as_of``; one that has not
    ended has a duration of 0.
    """
    return snapshots.select(
        "job_run_id", F.coalesce("life_cycle_state", F.lit("UNKNOWN")).alias("state"),
        "result_state", "state_message",
        F.coalesce(from_millis(F.col("start_time")), as_of).alias("start_ts"),
        from_millis(F.col("end_time")).alias("end_ts"),
        F.coalesce(span_seconds(F.col("start_time"), F.col("end_time")), F.lit(0))
        .alias("duration_s"),
    )


def job_tasks(snapshots: DataFrame) -> DataFrame:
    """One row per task of a job run; unfinished tasks have no duration."""
    tasks = snapshots.select("job_run_id", F.explode("tasks").alias("t"))
    return tasks.select(
        "job_run_id", "t.task_key", F.coalesce("t.artifact_path", F.lit("")).alias("artifact_path"),
        F.coalesce("t.life_cycle_state", F.lit("UNKNOWN")).alias("state"),
        from_millis(F.col("t.start_time")).alias("start_ts"),
        from_millis(F.col("t.end_time")).alias("end_ts"),
        span_seconds(F.col("t.start_time"), F.col("t.end_time")).alias("duration_s"),
        present(F.col("t.state_message")).alias("error"),
    )
