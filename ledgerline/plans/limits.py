"""Time limits that act: what the job service ends becomes a job state, and goes the way of all others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.status import present
from ledgerline.operators.rules import overdue_runs, timed_out
from ledgerline.operators.sieve import matching
from ledgerline.plans import poll
from ledgerline.schemas import AGENT_LIMIT_S, EXECUTION_LIMIT_S

# Fixed value: result state of a job that ran out of time
TIMED_OUT = "TIMEDOUT"


def overdue_states(runs: DataFrame, as_of: Column, limit_s: int = AGENT_LIMIT_S) -> DataFrame:
    """The state of every job whose run is over the limit: ended, out of time.

    A run without a job has nothing to end; ``overdue_runs`` still tells of it.
    """
    late = overdue_runs(runs.filter(present(F.col("job_run_id")).isNotNull()), as_of, limit_s).select("run_id")
    none = F.lit(None).cast("string")
    return matching(runs, late, "run_id").select(
        "job_run_id", F.lit("TERMINATED").alias("life_cycle_state"), F.lit(TIMED_OUT).alias("result_state"),
        none.alias("state_message"), none.alias("poll_error"))


def enforce(tables: dict[str, DataFrame], as_of: Column, logs_base: str = "",
            agent_limit_s: int = AGENT_LIMIT_S, execution_limit_s: int = EXECUTION_LIMIT_S
            ) -> dict[str, DataFrame]:
    """Next flows, runs and executions, and rows to add to events and requests.

    Current runs over the agent limit are decided as jobs that ended out of time (the run is
    cancelled, its flow stops); executions over theirs are TIMEOUT. Only overdue runs are decided
    on; enforcing again changes nothing more.
    """
    states = overdue_states(tables["runs"], as_of, agent_limit_s)
    late = matching(tables["runs"], states, "job_run_id")
    decisions = poll.decide({**tables, "runs": late}, states)
    result = poll.apply(tables, decisions, as_of, None, logs_base)
    return {**result, "executions": timed_out(tables["executions"], execution_limit_s)}
