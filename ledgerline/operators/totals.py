"""Counts and totals. All are one grouped pass with map-side combining."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import intent_of


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Table name and row count, one row per table."""
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
              for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def old_against_new(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Old and new totals of each migrated table, side by side."""
    rows = []
    for name, (old, new) in pairs.items():
        both = old.select(F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(
            new.select(F.lit(0).alias("o"), F.lit(1).alias("n")))
        rows.append(both.agg(F.coalesce(F.sum("o"), F.lit(0)).alias("old_rows"),
                             F.coalesce(F.sum("n"), F.lit(0)).alias("new_rows"))
                    .select(F.lit(name).alias("table_name"), "old_rows", "new_rows"))
    return reduce(DataFrame.unionByName, rows)


def status_distribution(table: DataFrame, column: str = "status") -> DataFrame:
    return (table.groupBy(F.col(column).alias("status")).agg(F.count("*").alias("count"))
            .orderBy(F.desc("count"), "status"))


def dashboard_totals(flows: DataFrame) -> DataFrame:
    status = F.col("status")
    return flows.agg(
        F.count("*").alias("total"),
        F.count_if(status == "NOT_STARTED").alias("not_started"),
        F.count_if(status == "RUNNING").alias("converting"),
        F.count_if(status == "DONE").alias("done"),
        F.count_if(status.isin("NEEDS_HUMAN", "NEEDS_ATTENTION")).alias("needs_attention"),
    )


def any_running(flows: DataFrame) -> DataFrame:
    return flows.agg(F.coalesce(F.bool_or(F.col("status") == "RUNNING"), F.lit(False))
                     .alias("any_running"))


def with_intent(processors: DataFrame) -> DataFrame:
    return processors.withColumn("intent", intent_of(F.col("type")))


def intent_counts(processors: DataFrame) -> DataFrame:
    """Processors per flow and intent."""
    return with_intent(processors).groupBy("flow_id", "intent").agg(
        F.count("*").alias("processors"))


def intents_of_flow(processors: DataFrame) -> DataFrame:
    return with_intent(processors).select("flow_id", "intent").distinct()


def start_summary(admitted: DataFrame) -> DataFrame:
    return admitted.agg(F.count_if("accepted").alias("started"),
                        F.count_if(~F.col("accepted")).alias("failed"))


def ingest_report(catalogue: DataFrame) -> DataFrame:
    parsed = F.col("flow_id").isNotNull()
    return catalogue.agg(F.count("*").alias("files_found"), F.count_if(parsed).alias("parsed"),
                         F.count_if(~parsed).alias("failed"))


def attempt_totals(runs: DataFrame) -> DataFrame:
    """Attempts, successes and first and last attempt time of every flow."""
    return runs.groupBy("flow_id").agg(
        F.count("*").alias("total_attempts"),
        F.count_if(F.col("status") == "SUCCESS").alias("successful_conversions"),
        F.min("start_ts").alias("first_attempt_at"),
        F.max("start_ts").alias("last_attempt_at"),
    )


def next_attempt_numbers(flows: DataFrame, runs: DataFrame) -> DataFrame:
    """Attempts so far plus one; 1 for a flow without any."""
    so_far = runs.groupBy("flow_id").agg(F.count("*").alias("_n"))
    return flows.select("flow_id").join(so_far, "flow_id", "left").select(
        "flow_id", (F.coalesce("_n", F.lit(0)) + 1).alias("attempt_number"))
