"""Totals kept from the change feed: a change row adds or takes away, no table is counted anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.totals import attempt_totals

CAME, GONE = ("insert", "update_postimage"), ("delete", "update_preimage")


def sign() -> Column:
    """+1 for a row that a change brings, -1 for one that it takes."""
    kind = F.col("change_type")
    return F.when(kind.isin(*CAME), 1).when(kind.isin(*GONE), -1)


def status_counts_after(counts: DataFrame, changes: DataFrame, column: str = "status") -> DataFrame:
    """``status``, ``count`` after the changes; a status that no row has any more is gone."""
    moved = changes.select(F.col(column).alias("status"), sign().cast("long").alias("count"))
    return (
        counts.select("status", "count").unionByName(moved).groupBy("status")
        .agg(F.sum("count").alias("count")).filter("count <> 0")
    )


def dashboard_of_counts(counts: DataFrame) -> DataFrame:
    """The totals of ``dashboard_totals`` from counts per status."""
    def of(*names: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("status").isin(*names), F.col("count"))), F.lit(0))

    return counts.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total"), of("NOT_STARTED").alias("not_started"),
        of("RUNNING").alias("converting"), of("DONE").alias("done"),
        of("NEEDS_HUMAN", "NEEDS_ATTENTION").alias("needs_attention"))


def attempt_totals_after(totals: DataFrame, changes: DataFrame, runs: DataFrame) -> DataFrame:
    """``attempt_totals`` after the changes of ``runs``, which is the table they lead to.

    Counts add up, and so do first and last times while rows only come. Where a row goes that
    held the first or last time of its flow, that flow alone is read again, from ``runs``.
    """
    came, ok = F.col("_sign") > 0, F.col("status").eqNullSafe(F.lit("SUCCESS"))
    start = F.col("start_ts")
    deltas = changes.withColumn("_sign", sign()).groupBy("flow_id").agg(
        F.sum("_sign").alias("_n"), F.sum(F.when(ok, F.col("_sign")).otherwise(0)).alias("_ok"),
        F.min(F.when(came, start)).alias("_first"), F.max(F.when(came, start)).alias("_last"),
        F.min(F.when(~came, start)).alias("_gone_first"), F.max(F.when(~came, start)).alias("_gone_last"))
    # runs without a flow are counted together, under NULL
    both = totals.alias("t").join(deltas.alias("d"), F.col("t.flow_id").eqNullSafe(F.col("d.flow_id")), "full_outer")
    flow = F.coalesce("t.flow_id", "d.flow_id").alias("flow_id")
    anew = (F.col("_gone_first") <= F.col("first_attempt_at")) | (F.col("_gone_last") >= F.col("last_attempt_at"))
    merged = both.select(
        flow, (F.coalesce("total_attempts", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("total_attempts"),
        (F.coalesce("successful_conversions", F.lit(0)) + F.coalesce("_ok", F.lit(0))).alias("successful_conversions"),
        F.least("first_attempt_at", "_first").alias("first_attempt_at"),
        F.greatest("last_attempt_at", "_last").alias("last_attempt_at"),
        F.coalesce(anew, F.lit(False)).alias("_anew")).filter("total_attempts <> 0")
    wanted = merged.filter("_anew").select(F.col("flow_id").alias("_flow"))
    again = attempt_totals(runs.join(wanted, F.col("flow_id").eqNullSafe(F.col("_flow")), "left_semi"))
    return merged.filter(~F.col("_anew")).drop("_anew").unionByName(again)
