"""Keys that carry a time, durations and time display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.status import present
from ledgerline.functions.text import fill


def epoch_seconds(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


# Formats of keys and job names
RUN_KEY = "{flow}_run_{seconds}"
ATTEMPT_KEY = "{flow}_attempt_{seconds}"
AGENT_JOB = "Agent_{flow}_{run}_iter{n}_{seconds}"
EXECUTION_JOB = "Execute_{flow}_iter{n}_{seconds}"
CONVERSION_JOB = "{prefix}_{flow}_{seconds}"


def run_key(flow: Column, ts: Column) -> Column:
    return fill(RUN_KEY, flow=flow, seconds=epoch_seconds(ts))


def base_run_key(run_id: Column) -> Column:
    """A run id without the place that tells runs of one second apart."""
    return F.regexp_replace(run_id, "(_run_[0-9]+)_[0-9]+$", "$1")


def attempt_key(flow: Column, ts: Column) -> Column:
    return fill(ATTEMPT_KEY, flow=flow, seconds=epoch_seconds(ts))


def agent_job_name(flow_name: Column, run_id: Column, iteration: Column, ts: Column) -> Column:
    return fill(AGENT_JOB, flow=flow_name, run=run_id, n=iteration, seconds=epoch_seconds(ts))


def execution_job_name(flow_name: Column, iteration: Column, ts: Column) -> Column:
    return fill(EXECUTION_JOB, flow=flow_name, n=iteration, seconds=epoch_seconds(ts))


def conversion_job_name(flow_name: Column, ts: Column, prefix: str = "Conversion") -> Column:
    """Name of a whole-flow job; the caller may put a product label in ``prefix``."""
    return fill(CONVERSION_JOB, prefix=F.lit(prefix), flow=flow_name, seconds=epoch_seconds(ts))


def from_millis(ms: Column) -> Column:
    """Epoch milliseconds as a time; 0 and NULL are missing."""
    return F.timestamp_millis(F.nullif(ms.cast("long"), F.lit(0)))


def span_seconds(start_ms: Column, end_ms: Column) -> Column:
    """Whole seconds between two epoch-millisecond values, floored; NULL if unfinished."""
    start, end = F.nullif(start_ms, F.lit(0)), F.nullif(end_ms, F.lit(0))
    return F.floor((end - start) / 1000).cast("long")


def duration_seconds(start: Column, end: Column) -> Column:
    """Whole seconds between two timestamps; NULL if either is missing."""
    return epoch_seconds(end) - epoch_seconds(start)


def duration_text(seconds: Column) -> Column:
    """``Xm Ys``; ``N/A`` for 0 or missing."""
    minutes = F.floor(seconds / 60).cast("long")
    text = fill("{m}m {s}s", m=minutes, s=seconds % 60)
    return F.when(seconds.isNull() | (seconds == 0), "N/A").otherwise(text)


def short_error(error: Column, width: int = 50) -> Column:
    return F.coalesce(F.substring(present(error), 1, width), F.lit("-"))


def time_text(ts: Column, missing: str = "N/A") -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(missing))


def iso_text(ts: Column) -> Column:
    """ISO 8601 text; the fraction only when it is not zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, "SSSSSS")
    return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))
