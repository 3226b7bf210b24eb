"""One poll for all flows: decide, write what follows, show where flows stand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.status import present
from ledgerline.operators.changes import keyed_update
from ledgerline.operators.joins import status_snapshot
from ledgerline.operators.rules import (
    execution_rows, human_rows, latest_of, next_actions, scan_hand_offs, start_rows, transition_rows)
from ledgerline.operators.sieve import matching, sieved
from ledgerline.schemas import TERMINAL_RUN
from ledgerline.session import written

OF_RUN = ["run_id", "flow_id", "status", "job_run_id"]     # what a decision needs of a run


def current_runs(flows: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs that their flow points to. Run ids are unique, so no key is hot."""
    pointers = flows.select(F.col("current_run_id").alias("run_id")).filter(
        present(F.col("run_id")).isNotNull())
    return matching(runs, pointers, "run_id")


def open_runs(runs: DataFrame) -> DataFrame:
    return runs.filter(~F.coalesce(F.col("status").isin(TERMINAL_RUN), F.lit(False)))


def decide(tables: dict[str, DataFrame], job_states: DataFrame,
           latest: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The next action of every current run.

    ``latest`` is the last event per run where a stream keeps it; without it the
    events of open current runs are read and ranked. Finished runs need no last event:
    their action does not depend on it, and they show none.

    The current runs are written once (by ``keep``, or below the shared folder), as all other tables
    are reduced by them.
    """
    keep = keep or (lambda df: written(df, "current-runs"))
    runs = keep(current_runs(tables["flows"], tables["runs"]).select(*OF_RUN))
    return decide_on(runs, tables, job_states, latest)


def decide_on(runs: DataFrame, tables: dict[str, DataFrame], job_states: DataFrame,
              latest: DataFrame | None = None) -> DataFrame:
    """``decide`` for ``runs`` (the columns ``OF_RUN``, read several times): current runs, or some of them."""
    asked = open_runs(runs).select("run_id", "job_run_id")
    if latest is None:
        latest = latest_of(matching(tables["events"], asked, "run_id"))
    else:
        latest = sieved(latest, runs, "run_id")
    return next_actions(
        runs, sieved(job_states, asked, "job_run_id"), latest,
        sieved(tables["artifacts"], asked, "run_id"), sieved(tables["executions"], asked, "run_id"))


def record(jobs: DataFrame, as_of: Column, logs_base: str = "") -> dict[str, DataFrame]:
    """Rows to add for execution jobs (see ``rules.execution_rows``).

    Finished jobs give their result; the next poll finds it, closes the step and goes on.
    """
    return {"executions": execution_rows(jobs, as_of, logs_base)}


def security_gate(tables: dict[str, DataFrame], as_of: Column) -> dict[str, DataFrame]:
    """Stop open current runs whose scans are blocked, before they are decided on.

    The same four results as ``apply``; an iteration is asked about once.
    """
    asked = scan_hand_offs(tables["scans"], current_runs(tables["flows"], tables["runs"]), tables["requests"])
    rows = human_rows(asked, as_of)
    return {
        "flows": update_flows(tables["flows"], rows["flows"], as_of),
        "runs": update_runs(tables["runs"], rows["runs"]),
        "events": rows["events"],
        "requests": rows["requests"],
    }


def apply(tables: dict[str, DataFrame], decisions: DataFrame, as_of: Column,
          launches: DataFrame | None = None, logs_base: str = "", stored: bool = False) -> dict[str, DataFrame]:
    """Next states of flows and runs, and rows to add to events and requests.

    Each result reads ``decisions``; write them once (``Store.materialize``) when
    all four results are wanted. ``stored`` says so: then runs without an update are not shuffled.
    """
    rows = transition_rows(decisions, as_of, launches, logs_base)
    return {
        "flows": update_flows(tables["flows"], rows["flows"], as_of),
        "runs": update_runs(tables["runs"], rows["runs"], few=stored),
        "events": rows["events"],
        "requests": rows["requests"],
    }


def start(tables: dict[str, DataFrame], admitted: DataFrame, as_of: Column,
          launches: DataFrame | None = None) -> dict[str, DataFrame]:
    """Next flows, and rows to add to runs and events, for accepted starts."""
    rows = start_rows(admitted, as_of, launches, tables["runs"])
    return {"flows": update_flows(tables["flows"], rows["flows"], as_of),
            "runs": rows["runs"], "events": rows["events"]}


def update_flows(flows: DataFrame, updates: DataFrame, as_of: Column) -> DataFrame:
    return keyed_update(flows, updates, "flow_id", {"updated_ts": as_of})


def update_runs(runs: DataFrame, updates: DataFrame, few: bool = False) -> DataFrame:
    """Status always; end time and job only where given."""
    return keyed_update(runs, updates, "run_id", when_given=["end_ts", "job_run_id"], few=few)


def snapshot_after(tables: dict[str, DataFrame], result: dict[str, DataFrame]) -> DataFrame:
    """The status list as it is once the poll's rows are written."""
    events = tables["events"].unionByName(result["events"], allowMissingColumns=True)
    pointers = result["flows"].select(present(F.col("current_run_id")).alias("run_id")).filter(F.col("run_id").isNotNull())
    return status_snapshot(result["flows"], sieved(result["runs"], pointers, "run_id"), sieved(events, pointers, "run_id"))
