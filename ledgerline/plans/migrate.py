"""Moving the two old tables into flows, runs and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.status import (
    legacy_flow_status, legacy_run_status, placeholder_event, present,
)
from ledgerline.functions.text import flow_name_of
from ledgerline.operators.changes import upsert
from ledgerline.operators.joins import by_flow_name

MIGRATION_UPDATE = ["flow_name", "status", "server", "source_path", "description", "priority",
                    "owner"]
MIGRATION_INSERT = MIGRATION_UPDATE + ["current_run_id"]


def fallback_id(source_path: Column, flow_name: Column) -> Column:
    """md5 of the file name without ``.xml``, or of the flow name when there is no path."""
    path = present(source_path)
    return F.md5(F.coalesce(flow_name_of(path), flow_name).cast("binary"))


def migrated_flows(old_flows: DataFrame, catalogued: DataFrame | None = None) -> DataFrame:
    """Old flows as new rows: the id of their file where it can be read, else the fallback.

    Of several ids that ``catalogued`` (see ``ingest.catalogue``) has for a path, the highest
    stands, as in ``name_table``.
    """
    if catalogued is None:
        with_id = old_flows.withColumn("_id", F.lit(None).cast("string"))
    else:
        ids = catalogued.groupBy(F.col("path").alias("source_path")).agg(F.max("flow_id").alias("_id"))
        with_id = old_flows.join(ids, "source_path", "left")
    return with_id.select(
        F.coalesce("_id", fallback_id(F.col("source_path"), F.col("flow_name"))).alias("flow_id"),
        "flow_name", legacy_flow_status(F.col("status")).alias("status"),
        F.lit(None).cast("string").alias("current_run_id"), "server", "source_path",
        "description", "priority", "owner")


def name_table(new_flows: DataFrame) -> DataFrame:
    """flow_name → flow_id; of equal names the highest flow_id stands."""
    return new_flows.groupBy("flow_name").agg(F.max("flow_id").alias("flow_id"))


def migrated_runs(history: DataFrame, new_flows: DataFrame) -> DataFrame:
    """Old attempts as runs. Rows whose flow name is unknown keep a NULL flow_id."""
    found = by_flow_name(history, name_table(new_flows))
    return found.select(
        F.col("attempt_id").alias("run_id"), "flow_id", F.col("job_id").alias("job_run_id"),
        F.col("started_at").alias("start_ts"), F.col("completed_at").alias("end_ts"),
        legacy_run_status(F.col("status")).alias("status"), "flow_name")


def placeholder_events(runs: DataFrame, as_of: Column) -> DataFrame:
    """One event per migrated run that tells how it ended."""
    event = placeholder_event(F.col("status"))
    return runs.select(
        "run_id", F.lit(1).alias("iteration_num"), F.lit("migration_placeholder").alias("step"),
        event["step_status"].alias("step_status"), as_of.alias("ts"),
        event["summary"].alias("summary"), event["error"].alias("error"),
        F.lit(1).cast("long").alias("event_seq"))


def migrate(flows: DataFrame, runs: DataFrame, events: DataFrame, old_flows: DataFrame,
            history: DataFrame, as_of: Column, catalogued: DataFrame | None = None
            ) -> dict[str, DataFrame]:
    """The three tables after the migration, and the history rows left out."""
    fresh = migrated_flows(old_flows, catalogued)
    moved = migrated_runs(history, fresh)
    kept = moved.filter(F.col("flow_id").isNotNull()).drop("flow_name")
    return {
        "flows": upsert(flows, fresh, ["flow_id"], MIGRATION_UPDATE, MIGRATION_INSERT,
                        {"updated_ts": as_of}, order=["flow_name"]),
        "runs": runs.unionByName(kept, allowMissingColumns=True),
        "events": events.unionByName(placeholder_events(kept, as_of), allowMissingColumns=True),
        "left_out": moved.filter(F.col("flow_id").isNull()).select(
            F.col("run_id").alias("attempt_id"), "flow_name"),
    }
