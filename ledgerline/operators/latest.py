"""Latest rows, top-n per key, numbering and ordered reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import artifact_name, fill, last_segment, logs_path
from ledgerline.operators.spread import number_rows
from ledgerline.schemas import EVENT_ORDER, HISTORY_ROWS, KEEP_LATEST


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
             rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key.

    ``row_number() <= n`` lets Spark cut every input split to n rows per key
    before the shuffle, so a hot key sends n rows per split, not all of them. Spark
    does so up to ``spark.sql.optimizer.windowGroupLimitThreshold`` rows; raise it
    for a larger ``n``.
    """
    place = rank or "_rank"
    kept = df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = kept.filter(F.col(place) <= n)
    return kept if rank else kept.drop(place)


def latest_events(events: DataFrame) -> DataFrame:
    """The last event of every run, by iteration, time and sequence."""
    return top_rows(events, ["run_id"], [F.desc(c) for c in EVENT_ORDER], 1)


def latest_events_aggregated(events: DataFrame) -> DataFrame:
    """The same as an aggregate, the form a stream can keep up to date."""
    rest = [c for c in events.columns if c != "run_id"]
    return (
        events.groupBy("run_id")
        .agg(F.max_by(F.struct(*rest), F.struct(*EVENT_ORDER)).alias("_last"))
        .select("run_id", *[F.col(f"_last.{c}").alias(c) for c in rest])
    )


def run_history(runs: DataFrame, n: int = HISTORY_ROWS, flow_id: str | None = None) -> DataFrame:
    """Newest runs first: one flow, or the first ``n`` of every flow with their place."""
    order = [F.desc_nulls_last("start_ts"), F.desc("run_id")]
    if flow_id is not None:
        return runs.filter(F.col("flow_id") == flow_id).orderBy(*order).limit(n)
    return top_rows(runs, ["flow_id"], order, n, rank="place")


def attempt_history(attempts: DataFrame, n: int = 10) -> DataFrame:
    """The old history table: newest attempts of every flow name."""
    return top_rows(attempts, ["flow_name"],
                    [F.desc_nulls_last("started_at"), F.desc("attempt_id")], n, rank="place")


def surplus_runs(runs: DataFrame, keep: int = KEEP_LATEST) -> DataFrame:
    """Runs older than the ``keep`` newest of their flow; no time counts as oldest.

    The kept rows are few per flow; the rest is found by an anti join on the
    unique run id, so the runs of a big flow never meet in one task.
    """
    kept = top_rows(runs.select("flow_id", "run_id", "start_ts"), ["flow_id"],
                    [F.desc_nulls_last("start_ts"), F.desc("run_id")], keep)
    return runs.join(kept.select("run_id"), "run_id", "left_anti")


def execution_tasks(artifacts: DataFrame, logs_base: str) -> DataFrame:
    """One task per artifact of an iteration, numbered from 0 in list order."""
    numbered = number_rows(artifacts.select("run_id", "iteration_num", "artifact_ref", "ts"),
                           ["run_id", "iteration_num"],
                           [F.asc("artifact_ref"), F.asc("ts")], "task_index", start=0, unique=True)
    name, index = artifact_name(F.col("artifact_ref")), F.col("task_index")
    logs = logs_path(logs_base, F.col("run_id"), F.col("iteration_num"))
    return numbered.select(
        "run_id", "iteration_num", "task_index", "artifact_ref",
        fill("execute_{name}_{i}", name=name, i=index).alias("task_key"),
        fill("{logs}/{name}.log", logs=logs, name=name).alias("log_path"),
    )


def deployment_tasks(listing: DataFrame, order: Sequence[str]) -> DataFrame:
    """Task keys of a deployment: ``task_{i}_{flow}`` and artifact ids ``nb_{i}``."""
    numbered = number_rows(listing.select("flow_id", "artifact_ref", *order), ["flow_id"],
                           [F.asc(c) for c in order], "task_index", start=0, unique=True)
    index = F.col("task_index")
    return numbered.select(
        "flow_id", "task_index", "artifact_ref", last_segment(F.col("artifact_ref")).alias("name"),
        fill("task_{i}_{flow}", i=index, flow=F.col("flow_id")).alias("task_key"),
        fill("nb_{i}", i=index).alias("artifact_id"),
    )


def next_iteration(runs: DataFrame, events: DataFrame) -> DataFrame:
    """The next iteration number of every run: last one plus 1, or 1."""
    last = events.groupBy("run_id").agg(F.max("iteration_num").alias("_last"))
    return runs.select("run_id").join(last, "run_id", "left").select(
        "run_id", (F.coalesce("_last", F.lit(0)) + 1).alias("next_iteration"))


def last_written(artifacts: DataFrame, tie_break: Sequence[str] = ()) -> DataFrame:
    """The row that wins when the same path was written several times."""
    return top_rows(artifacts, ["artifact_ref"], [F.desc(c) for c in ("ts", *tie_break)], 1)


def newest_run(runs: DataFrame) -> DataFrame:
    """The run with the latest start of every flow; of equal starts the highest id."""
    newest = top_rows(runs.select("flow_id", "start_ts", "run_id"), ["flow_id"],
                      [F.desc("start_ts"), F.desc("run_id")], 1)
    return newest.select("flow_id", F.col("run_id").alias("newest_run_id"))


def stale_pointers(flows: DataFrame, runs: DataFrame) -> DataFrame:
    """Flows whose stored current run is not their newest run."""
    return (
        flows.select("flow_id", "current_run_id")
        .join(newest_run(runs), "flow_id", "left")
        .filter(~F.col("current_run_id").eqNullSafe(F.col("newest_run_id")))
    )


DETAIL_ORDER = {
    "events": ["iteration_num", "ts", "event_seq"],
    "artifacts": ["iteration_num", "artifact_ref"],
    "scans": ["iteration_num", "artifact_ref"],
    "executions": ["iteration_num", "job_type"],
    "requests": ["iteration_num"],
}


def run_details(child: DataFrame, table: str, run_id: str | None = None) -> DataFrame:
    """Rows of a child table in reading order: of one run, or of all runs.

    For all runs the sort is by range, with a hash of the other columns as the last
    key, so a run or an iteration with many rows is cut over several tasks.
    """
    order = DETAIL_ORDER[table]
    if run_id is not None:
        return child.filter(F.col("run_id") == run_id).orderBy(*order)
    first = ["run_id", *order]
    rest = [c for c in child.columns if c not in first]
    return child.orderBy(*first, F.xxhash64(*rest))


def details_with_run(child: DataFrame, runs: DataFrame) -> DataFrame:
    """Child rows with flow and status of their run, for all runs at once."""
    parent = runs.select("run_id", "flow_id", F.col("status").alias("run_status"))
    return child.join(parent, "run_id")
