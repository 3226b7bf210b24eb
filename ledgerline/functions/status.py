"""Status maps and display values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.text import fill
from ledgerline.schemas import (
    LEGACY_FLOW_STATUS, LEGACY_RUN_STATUS, STARTABLE, STATUS_BADGES,
)


def present(col: Column) -> Column:
    """The value, with an empty string counted as missing."""
    return F.nullif(col, F.lit(""))


def legacy_flow_status(status: Column) -> Column:
    """Old flow status in the new vocabulary; unknown values stay."""
    changed = {old: new for old, new in LEGACY_FLOW_STATUS.items() if old != new}
    mapped = status
    for old, new in changed.items():
        mapped = F.when(status == old, F.lit(new)).otherwise(mapped)
    return mapped


def legacy_run_status(status: Column) -> Column:
    """Old run status; unknown or missing becomes FAILED."""
    return F.when(status.isin(LEGACY_RUN_STATUS), status).otherwise(F.lit("FAILED"))


# Texts of the event that stands for an old run
PLACEHOLDER = "Conversion {what} (migrated from old schema)"
PLACEHOLDER_WHAT = {"SUCCESS": "completed", "RUNNING": "in progress"}
PLACEHOLDER_ERROR = "Migrated from old schema - check original history for details"


def placeholder_event(status: Column) -> Column:
    """Summary, step_status and error of the event that stands for an old run."""
    what = F.lower(status)
    for value, words in PLACEHOLDER_WHAT.items():
        what = F.when(status == value, words).otherwise(what)
    return F.struct(
        fill(PLACEHOLDER, what=what).alias("summary"),
        F.when(status.isin("FAILED", "RUNNING"), status)
        .otherwise("COMPLETED").alias("step_status"),
        F.when(status == "FAILED", PLACEHOLDER_ERROR).alias("error"),
    )


def badge(status: Column) -> Column:
    """Label and colour shown for a status, ``Unknown``/gray for others."""
    label, colour = F.lit("Unknown"), F.lit("gray")
    for value, (text, tint) in STATUS_BADGES.items():
        label = F.when(status == value, text).otherwise(label)
        colour = F.when(status == value, tint).otherwise(colour)
    return F.struct(label.alias("label"), colour.alias("colour"))


def can_start(status: Column) -> Column:
    return F.coalesce(status.isin(STARTABLE), F.lit(False))


def allowed_action(status: Column) -> Column:
    return (F.when(can_start(status), "Start")
            .when(status == "RUNNING", "Stop").otherwise("View"))


def progress_text(summary: Column, step: Column) -> Column:
    return F.coalesce(present(summary), present(step), F.lit("Waiting to start"))
