"""Joins of flows, runs and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.status import present
from ledgerline.functions.text import WAITING_TEXT, fill
from ledgerline.operators.latest import latest_events
from ledgerline.schemas import TERMINAL_RUN


def with_current_run(flows: DataFrame, right: DataFrame) -> DataFrame:
    """Flows left joined to rows that carry the current run as ``run_id``.

    Flows without a run would all meet on the NULL key. They match nothing, so
    their flow_id stands in as a key that spreads them.
    """
    pointer = present(F.col("current_run_id"))
    keyed = flows.withColumns({"_run": F.coalesce(pointer, F.col("flow_id")),
                               "_points": pointer.isNotNull()})
    runs = right.withColumnRenamed("run_id", "_run").withColumn("_points", F.lit(True))
    return keyed.join(runs, ["_run", "_points"], "left").drop("_run", "_points")


def status_snapshot(flows: DataFrame, runs: DataFrame, events: DataFrame) -> DataFrame:
    """Where every flow stands: its row, its current run and the run's last event.

    A flow without a run, or whose run has no job yet, has no step. A finished
    run shows step, summary and iteration only. Events of runs that no flow points to
    are left out before they are ranked: history grows, current runs do not.
    """
    pointers = flows.select(present(F.col("current_run_id")).alias("run_id")).filter(F.col("run_id").isNotNull())
    live = runs.filter(present(F.col("job_run_id")).isNotNull()).select(
        "run_id", F.col("status").alias("run_status")).join(pointers, "run_id", "left_semi")
    last = latest_events(
        events.select("run_id", "iteration_num", "ts", "event_seq", "step", "step_status",
                      "summary", "error").join(live.select("run_id"), "run_id", "left_semi"))
    finished = F.col("run_status").isin(TERMINAL_RUN)
    right = live.join(last, "run_id", "left").select(
        "run_id", "run_status",
        F.col("step").alias("current_step"), F.col("summary").alias("current_summary"),
        F.col("iteration_num").alias("current_iteration"),
        F.when(~finished, F.col("step_status")).alias("step_status"),
        F.when(~finished, present(F.col("error"))).alias("error"),
    )
    return with_current_run(flows, right)


def current_attempts(flows: DataFrame, attempts: DataFrame) -> DataFrame:
    """The attempt each old flow points to, where there is one."""
    pointers = flows.select("flow_name", F.col("current_attempt_id").alias("attempt_id")).filter(
        present(F.col("attempt_id")).isNotNull())
    return pointers.join(attempts.drop("flow_name"), "attempt_id")


def current_artifacts(flows: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Artifacts of the current run of every flow, in iteration and path order."""
    pointers = flows.select("flow_id", F.col("current_run_id").alias("run_id")).filter(
        present(F.col("run_id")).isNotNull())
    listed = artifacts.select("run_id", "iteration_num", "artifact_ref").join(pointers, "run_id")
    return listed.select("flow_id", "run_id", "iteration_num", "artifact_ref").orderBy(
        "flow_id", "iteration_num", "artifact_ref")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Missing parent keys and the child rows that use them.

    Child rows are counted per key first, so a hot key crosses the shuffle as
    one row per split.
    """
    used = (child.filter(F.col(child_key).isNotNull())
            .groupBy(F.col(child_key).alias("key")).agg(F.count("*").alias("rows")))
    return used.join(parent.select(F.col(parent_key).alias("key")), "key", "left_anti")


def count_orphans(child: DataFrame, parent: DataFrame, child_key: str,
                  parent_key: str) -> DataFrame:
    missing = orphans(child, parent, child_key, parent_key)
    return missing.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("orphan_count"))


def by_flow_name(history: DataFrame, names: DataFrame) -> DataFrame:
    """History rows with the flow_id of their flow_name; NULL when unknown.

    ``names`` has one flow_id per flow_name (see ``lookup.first_per_name``).
    """
    return history.join(names.select("flow_name", "flow_id"), "flow_name", "left")


def fetch_artifacts(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Text of each wanted path; missing files give the waiting text.

    ``wanted`` has a ``path`` column, ``files`` (path, content).
    """
    found = wanted.join(files.select("path", "content", F.lit(True).alias("found")), "path", "left")
    note = fill(f"{WAITING_TEXT}\n# {{path}} not found", path=F.col("path"))
    return found.withColumn("found", F.coalesce("found", F.lit(False))).withColumn(
        "content", F.coalesce("content", note))
