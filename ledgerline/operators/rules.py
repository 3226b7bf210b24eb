"""Workflow rules: decide for all rows at once, then give the rows to write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.status import present
from ledgerline.functions.text import fill, logs_path
from ledgerline.functions.timing import attempt_key, base_run_key, epoch_seconds, run_key
from ledgerline.operators.joins import with_current_run
from ledgerline.operators.latest import latest_events, top_rows
from ledgerline.operators.lookup import identifiers
from ledgerline.schemas import (
    ACTIVE_JOB, AGENT_LIMIT_S, EXECUTION_LIMIT_S, MAX_ITERATIONS, TERMINAL_RUN,
)

# messages
NOT_FOUND = "Flow not found"
IN_PROGRESS = "Conversion already in progress"
NO_SOURCE = "XML path not configured for this flow"
NO_JOB = "No running job found"
JOB_FAILED = "Job failed"
EXECUTION_FAILED = "Execution failed"
MISSING_PARAMETERS = "Missing required parameters: run_id, flow_id, and flow_name are required."
NOT_CREATED = "job was not created"
SOURCE_REQUIRED = "source_path is required for iteration 1 (generation)"
LOGS_REQUIRED = "logs_path is required for iteration 2+ (error fixing)"

# Texts of events and requests
GENERATING = "Agent generating notebooks (iteration 1)..."
GENERATED = "Agent completed notebook generation"
EXECUTING = "Executing {count} notebooks..."
EXECUTED = "All notebooks executed successfully"
FIXING = "Agent analyzing logs and fixing errors (iteration {n})..."
FIXED = "Agent completed error fixing (iteration {n})"
CANCELLED = "Cancelled by user"
HANDED_OVER = "Marked as NEEDS_HUMAN: {reason}"
ASK_JOB = "Agent job failed: {error}"
ASK_LIMIT = "Agent tried {limit} iterations but could not fix errors. Review logs at {logs}"
ASK_ERROR = "Error during orchestration: {error}"
ASK_DEFAULT = "Review logs and execution results for {run}"

# Reasons of requests
REASON_JOB = "agent_job_failed"
REASON_LIMIT = "max_iterations_reached"
REASON_ERROR = "orchestration_error"
REASON_SCAN = "sast_blocked"


# ------------------------------------------------------------------ admission
def admit(requests: DataFrame, flows: DataFrame, no_source: str = NO_SOURCE) -> DataFrame:
    """Accept or refuse every start request (``pos``, ``identifier``).

    The first acceptable request of a flow wins; its repeats find the flow
    running. Requests are reduced to their first position per identifier before
    anything is joined, so a flow asked for many times is judged once.
    """
    facts = ["flow_name", "source_path", "current_run_id", "status"]
    asked = requests.groupBy("identifier").agg(F.min("pos").alias("_asked"))
    known = asked.join(identifiers(flows, *facts), "identifier", "left")
    refusal = (
        F.when(F.col("flow_id").isNull(), NOT_FOUND)
        .when(F.col("status") == "RUNNING", IN_PROGRESS)
        .when(present(F.col("source_path")).isNull(), no_source)
    )
    # a flow has an id and a name: two rows at most; unknown ones stay apart
    same_flow = Window.partitionBy(F.coalesce("flow_id", "identifier"))
    judged = known.withColumn("_error", refusal).withColumn(
        "_first", F.min(F.when(F.col("_error").isNull(), F.col("_asked"))).over(same_flow))
    placed = requests.join(judged, "identifier", "left")
    free = F.col("_error").isNull()
    first = F.col("pos") == F.col("_first")
    return placed.select(
        "pos", "identifier", "flow_id", "flow_name", "source_path",
        (free & first).alias("accepted"),
        F.when(free & ~first, IN_PROGRESS).otherwise(F.col("_error")).alias("error"),
        F.when(F.col("_error") == IN_PROGRESS, F.col("current_run_id")).alias("current_run_id"),
    )


def start_rows(admitted: DataFrame, as_of: Column, launches: DataFrame | None = None,
               runs: DataFrame | None = None) -> dict[str, DataFrame]:
    """Rows of every accepted start: new run, flow update, first event.

    ``launches`` (flow_id, job_run_id, error) is what starting the job gave; an
    error, or a flow without a launch row, leaves a failed run and a flow for a
    human. Run ids have a resolution of one second; with ``runs``, the runs so far, a
    flow that is started again within it gets its place as an ending.
    """
    accepted = admitted.filter("accepted").select("flow_id", "flow_name")
    if launches is None:
        outcome = accepted.withColumns({"job_run_id": F.lit(None).cast("string"),
                                        "error": F.lit(None).cast("string")})
        started = F.lit(True)
    else:
        outcome = accepted.join(launches.select("flow_id", "job_run_id", "error"),
                                "flow_id", "left")
        started = present(F.col("job_run_id")).isNotNull() & F.col("error").isNull()
    rows = outcome.withColumns({
        "run_id": run_key(F.col("flow_id"), as_of), "started": started, "ts": as_of})
    if runs is not None:
        taken = runs.groupBy(base_run_key(F.col("run_id")).alias("run_id")).agg(F.count("*").alias("_taken"))
        place = F.concat(F.lit("_"), (F.col("_taken") + 1).cast("string"))
        rows = rows.join(taken, "run_id", "left").withColumn(
            "run_id", F.concat("run_id", F.coalesce(place, F.lit(""))))
    status = (F.when(~F.col("started"), "FAILED")
              .when(F.col("job_run_id").isNull(), "CREATING").otherwise("QUEUED"))
    new_runs = rows.select(
        "run_id", "flow_id", F.when(F.col("started"), F.col("job_run_id")).alias("job_run_id"),
        F.col("ts").alias("start_ts"), F.when(F.lit(False), as_of).alias("end_ts"),
        status.alias("status"))
    flow_updates = rows.select(
        "flow_id", F.when(F.col("started"), "RUNNING").otherwise("NEEDS_HUMAN").alias("status"),
        F.col("run_id").alias("current_run_id"))
    events = rows.select(
        "run_id", F.lit(1).alias("iteration_num"),
        F.when(F.col("started"), "agent_generate").otherwise("job_creation").alias("step"),
        F.when(F.col("started"), "RUNNING").otherwise("FAILED").alias("step_status"), "ts",
        F.when(F.col("started"), GENERATING).alias("summary"),
        F.when(~F.col("started"), F.coalesce("error", F.lit(NOT_CREATED))
               ).alias("error"),
        F.lit(1).cast("long").alias("event_seq"))
    return {"runs": new_runs, "flows": flow_updates, "events": events}


def new_attempts(accepted: DataFrame, runs: DataFrame, as_of: Column) -> DataFrame:
    """Old-style attempts for accepted starts: number, first time and key.

    The job is not known yet (see ``attempted_flows`` for the flow's side).
    """
    so_far = runs.groupBy("flow_id").agg(F.count("*").alias("_n"),
                                         F.min("start_ts").alias("_first"))
    return accepted.select("flow_id", "flow_name").join(so_far, "flow_id", "left").select(
        attempt_key(F.col("flow_name"), as_of).alias("attempt_id"), "flow_id", "flow_name",
        F.lit("CREATING").alias("status"), as_of.alias("started_at"),
        (F.coalesce("_n", F.lit(0)) + 1).alias("attempt_number"),
        F.lit("user").alias("triggered_by"),
        F.coalesce("_first", as_of).alias("first_attempt_at"))


def attempted_flows(flows: DataFrame, attempts: DataFrame, as_of: Column) -> DataFrame:
    """Old-style flows after new attempts: pointer, counts, times and status.

    ``flows``: flow_name with ``current_attempt_id``, ``total_attempts``,
    ``first_attempt_at``, ``last_attempt_at``, ``status`` and ``last_updated``; a flow
    keeps its first time, and flows without an attempt stay as they are.
    """
    new = attempts.select("flow_name", F.struct("attempt_id", "attempt_number", "started_at").alias("_new"))
    hit = F.col("_new").isNotNull()
    given = {
        "current_attempt_id": F.col("_new.attempt_id"), "total_attempts": F.col("_new.attempt_number"),
        "last_attempt_at": F.col("_new.started_at"), "status": F.lit("CONVERTING"), "last_updated": as_of,
        "first_attempt_at": F.coalesce("first_attempt_at", "_new.started_at"),
    }
    columns = [F.when(hit, given[c]).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in flows.columns]
    return flows.join(new, "flow_name", "left").select(*columns)


def agent_call_check(calls: DataFrame) -> DataFrame:
    """The first rule an agent call breaks; NULL message when it may start."""
    missing = [present(F.col(c)).isNull() for c in ("run_id", "flow_id", "flow_name")]
    message = (
        F.when(missing[0] | missing[1] | missing[2], MISSING_PARAMETERS)
        .when((F.col("iteration_num") == 1) & present(F.col("source_path")).isNull(),
              SOURCE_REQUIRED)
        .when((F.col("iteration_num") > 1) & present(F.col("logs_path")).isNull(), LOGS_REQUIRED)
    )
    return calls.withColumn("message", message)


# ---------------------------------------------------------------- next action
def iteration_outcomes(executions: DataFrame) -> DataFrame:
    """The last execution result of every (run_id, iteration_num)."""
    last = top_rows(executions, ["run_id", "iteration_num"],
                    [F.desc(c) for c in ("ts", "job_type", "runtime_s", "error")], 1)
    return last.select(
        "run_id", "iteration_num", F.col("status").alias("outcome"), "runtime_s",
        F.col("error").alias("outcome_error"), "logs_ref")


def next_actions(runs: DataFrame, job_states: DataFrame, latest: DataFrame,
                 artifacts: DataFrame, executions: DataFrame,
                 max_iterations: int = MAX_ITERATIONS) -> DataFrame:
    """One row per run: what to do next, and for finished steps what follows.

    ``action`` is the first rule that matches; ``follow_up`` refines
    EXECUTE_GENERATED and EXECUTE_FIXED: NO_ARTIFACTS, AWAIT (not executed yet),
    FINISH, NEXT_ITERATION or HAND_OFF. CHECK_EXECUTION looks again after an
    execution that an earlier poll left running. A job without a state row is left
    alone; a state row with ``poll_error`` is an ERROR.

    Events, artifacts and executions are reduced to open runs before anything is
    ranked or counted: history grows, open runs do not.
    """
    if "poll_error" not in job_states.columns:
        job_states = job_states.withColumn("poll_error", F.lit(None).cast("string"))
    job = present(F.col("job_run_id"))
    open_run = ~F.coalesce(F.col("status").isin(TERMINAL_RUN), F.lit(False))
    polled = job_states.select(
        F.col("job_run_id").alias("_job"), F.lit(True).alias("_asks"), "life_cycle_state",
        "result_state", "state_message", "poll_error")
    # runs that need no poll take their own id as key, so NULL jobs do not meet
    asks = job.isNotNull() & open_run
    keyed = runs.select("run_id", "flow_id", "status", "job_run_id").withColumns({
        "_asks": asks, "_job": F.when(asks, F.col("job_run_id")).otherwise(F.col("run_id"))})
    last = latest.select("run_id", "step", "iteration_num", "step_status")
    facts = keyed.join(polled, ["_job", "_asks"], "left").join(last, "run_id", "left")

    step, state, result = F.col("step"), F.col("life_cycle_state"), F.col("result_state")
    done = state == "TERMINATED"
    action = (
        F.when(job.isNull(), "FLOW_ONLY")
        .when(~open_run, "CACHED")
        .when(present(F.col("poll_error")).isNotNull(), "ERROR")
        .when((state == "RUNNING") & ~F.col("status").eqNullSafe(F.lit("RUNNING")),
              "MARK_RUNNING")
        .when(state.isin(ACTIVE_JOB), "NONE")
        .when(done & (result == "SUCCESS") & (step == "agent_generate"), "EXECUTE_GENERATED")
        .when(done & (result == "SUCCESS") & (step == "agent_fix_errors"), "EXECUTE_FIXED")
        .when(done & (result == "SUCCESS") & (step == "execute_notebooks")
              & (F.col("step_status") == "RUNNING"), "CHECK_EXECUTION")
        .when(done & (result == "SUCCESS"), "NONE")
        .when(done & (result == "FAILED"), "FAIL_NEEDS_HUMAN")
        .when(done, "CANCEL_STOP")
        .otherwise("NONE")
    )
    acting = facts.withColumn("action", action).withColumn(
        "exec_iteration", F.when(F.col("action") == "EXECUTE_GENERATED", 1)
        .when(F.col("action").isin("EXECUTE_FIXED", "CHECK_EXECUTION"), F.col("iteration_num")).cast("int"))

    asked = keyed.filter("_asks").select("run_id")
    artifacts = artifacts.join(asked, "run_id", "left_semi")
    executions = executions.join(asked, "run_id", "left_semi")
    listed = artifacts.groupBy("run_id", F.col("iteration_num").alias("exec_iteration")).agg(
        F.count("*").alias("n_artifacts"))
    results = iteration_outcomes(executions).withColumnRenamed("iteration_num", "exec_iteration")
    full = acting.join(listed, ["run_id", "exec_iteration"], "left").join(
        results, ["run_id", "exec_iteration"], "left")
    follow_up = (
        F.when(F.col("exec_iteration").isNull(), None)
        .when(F.col("n_artifacts").isNull(), "NO_ARTIFACTS")
        .when(F.col("outcome").isNull(), "AWAIT")
        .when(F.col("outcome") == "SUCCESS", "FINISH")
        .when(((F.col("action") == "EXECUTE_FIXED")
               | (F.col("action") == "CHECK_EXECUTION") & (F.col("exec_iteration") > 1))
              & (F.col("exec_iteration") >= max_iterations), "HAND_OFF")
        .otherwise("NEXT_ITERATION")
    )
    executed = F.col("n_artifacts").isNotNull()
    return full.select(
        "run_id", "flow_id", "status", "action", "step", "iteration_num", "exec_iteration",
        F.coalesce("n_artifacts", F.lit(0)).alias("n_artifacts"),
        F.when(executed, F.col("outcome")).alias("outcome"),
        F.when(executed, F.col("runtime_s")).alias("runtime_s"),
        F.when(executed, F.col("outcome_error")).alias("outcome_error"),
        F.when(executed, F.col("logs_ref")).alias("logs_ref"),
        "state_message", "poll_error", follow_up.alias("follow_up"))


def iteration_gate(decisions: DataFrame, max_iterations: int = MAX_ITERATIONS) -> DataFrame:
    """Failed fixes: another iteration, or a human when the limit is reached."""
    failed = decisions.filter(F.col("follow_up").isin("HAND_OFF", "NEXT_ITERATION"))
    return failed.select(
        "run_id", "exec_iteration", "follow_up",
        F.when(F.col("follow_up") == "NEXT_ITERATION", F.col("exec_iteration") + 1)
        .alias("next_iteration"))


# ------------------------------------------------------------ rows of actions
EVENT_TYPE = ("struct<iteration_num:int,step:string,step_status:string,"
              "summary:string,error:string>")


def _event(iteration, step, step_status, summary=None, error=None) -> Column:
    parts = [iteration, step, step_status, summary, error]
    names = ["iteration_num", "step", "step_status", "summary", "error"]
    columns = [(p if isinstance(p, Column) else F.lit(p)).alias(n) for p, n in zip(parts, names)]
    return F.struct(*columns).cast(EVENT_TYPE)


def _failure_message() -> Column:
    return F.coalesce(present(F.col("state_message")), F.lit(JOB_FAILED))


def with_launches(decisions: DataFrame, launches: DataFrame | None = None) -> DataFrame:
    """Decisions with the job of their next iteration, or with what kept it from starting.

    ``launches`` (run_id, iteration_num, job_run_id, error) is what starting the jobs gave.
    A next iteration without a job there, or with an error, has a ``launch_error``.
    Without ``launches`` jobs are not known yet, and nothing has failed.
    """
    none = F.lit(None).cast("string")
    if launches is None:
        return decisions.withColumns({"next_job": none, "launch_error": none})
    error = F.col("error") if "error" in launches.columns else none
    given = launches.select("run_id", F.col("iteration_num").alias("_next"),
                            present(F.col("job_run_id")).alias("_job"), present(error).alias("_error"))
    follows = F.col("follow_up") == "NEXT_ITERATION"
    found = decisions.withColumn("_next", F.when(follows, F.col("exec_iteration") + 1)).join(
        given, ["run_id", "_next"], "left")
    failed = follows & (F.col("_job").isNull() | F.col("_error").isNotNull())
    return found.select(
        *decisions.columns, F.when(~failed, F.col("_job")).alias("next_job"),
        F.when(failed, F.coalesce("_error", F.lit(NOT_CREATED))).alias("launch_error"))


def hand_offs(decisions: DataFrame, logs_base: str = "",
              max_iterations: int = MAX_ITERATIONS) -> DataFrame:
    """Runs to give to a human: reason, instructions and the iteration asked about.

    A next iteration that could not start (``launch_error``, see ``with_launches``) is
    asked about itself.
    """
    action, follow = F.col("action"), F.col("follow_up")
    if "launch_error" not in decisions.columns:
        decisions = with_launches(decisions)
    lost = F.col("launch_error").isNotNull()
    reason = (
        F.when(action == "FAIL_NEEDS_HUMAN", REASON_JOB)
        .when((action == "ERROR") | lost, REASON_ERROR)
        .when(follow == "HAND_OFF", REASON_LIMIT))
    logs = F.coalesce(F.col("logs_ref"),
                      logs_path(logs_base, F.col("run_id"), F.col("exec_iteration")))
    instructions = (
        F.when(action == "FAIL_NEEDS_HUMAN", fill(ASK_JOB, error=_failure_message()))
        .when((action == "ERROR") | lost, fill(ASK_ERROR, error=F.coalesce("poll_error", "launch_error")))
        .otherwise(fill(ASK_LIMIT, limit=F.lit(max_iterations), logs=logs)))
    return decisions.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(
        "run_id", "flow_id", F.when(lost, F.col("exec_iteration") + 1).otherwise(
            F.coalesce("iteration_num", F.lit(1))).alias("iteration_num"),
        "reason", instructions.alias("instructions"))


def human_rows(asked: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """Rows of every hand-off (run_id, flow_id, iteration_num, reason, instructions).

    ``iteration_num`` is the latest of the run, or 1. NULL instructions get the
    default text.
    """
    text = F.coalesce(present(F.col("instructions")), fill(ASK_DEFAULT, run=F.col("run_id")))
    requests = asked.select("run_id", "iteration_num", "reason", text.alias("instructions"),
                            F.lit("PENDING").alias("status"), as_of.alias("ts"))
    events = asked.select(
        "run_id", (F.col("iteration_num") + 1).alias("iteration_num"),
        F.lit("needs_human").alias("step"), F.lit("COMPLETED").alias("step_status"),
        as_of.alias("ts"),
        fill(HANDED_OVER, reason=F.col("reason")).alias("summary"),
        F.lit(None).cast("string").alias("error"), F.lit(100).cast("long").alias("event_seq"))
    runs = asked.select("run_id", F.lit("FAILED").alias("status"), as_of.alias("end_ts"),
                        F.lit(None).cast("string").alias("job_run_id"))
    flows = asked.select("flow_id", F.lit("NEEDS_HUMAN").alias("status"))
    return {"requests": requests, "events": events, "runs": runs, "flows": flows}


def step_events(decisions: DataFrame, as_of: Column) -> DataFrame:
    """Events every decision leaves behind, hand-off events not included.

    A finished agent step closes, its artifacts are executed, and the execution
    result closes in turn or opens the next fixing iteration, which fails at once if
    its job could not start. An execution that is checked again is not begun again.
    """
    if "launch_error" not in decisions.columns:
        decisions = with_launches(decisions)
    n, k = F.col("iteration_num"), F.col("exec_iteration")
    action, follow = F.col("action"), F.col("follow_up")
    closing = (
        F.when(action == "EXECUTE_GENERATED", _event(n, "agent_generate", "COMPLETED", GENERATED))
        .when(action == "EXECUTE_FIXED",
              _event(n, "agent_fix_errors", "COMPLETED", fill(FIXED, n=n)))
        .when((action == "FAIL_NEEDS_HUMAN") & n.isNotNull(),
              _event(n, F.col("step"), "FAILED", error=_failure_message()))
    )
    begun = follow.isin("AWAIT", "FINISH", "NEXT_ITERATION", "HAND_OFF") & (action != "CHECK_EXECUTION")
    running = F.when(begun, _event(
        k, "execute_notebooks", "RUNNING", fill(EXECUTING, count=F.col("n_artifacts"))))
    result = F.when(follow == "FINISH", _event(
        k, "execute_notebooks", "COMPLETED", EXECUTED)
    ).when(follow.isin("NEXT_ITERATION", "HAND_OFF"), _event(
        k, "execute_notebooks", "FAILED",
        error=F.coalesce(present(F.col("outcome_error")), F.lit(EXECUTION_FAILED))))
    lost = F.col("launch_error")
    fixing = F.when(lost.isNotNull(), _event(k + 1, "agent_fix_errors", "FAILED", error=lost)).when(
        follow == "NEXT_ITERATION", _event(k + 1, "agent_fix_errors", "RUNNING", fill(FIXING, n=k + 1)))
    happened = F.filter(F.array(closing, running, result, fixing), lambda e: e.isNotNull())
    return decisions.select("run_id", F.posexplode(happened).alias("_at", "_e")).select(
        "run_id", "_e.iteration_num", "_e.step", "_e.step_status", as_of.alias("ts"),
        "_e.summary", "_e.error", (F.col("_at") + 1).cast("long").alias("event_seq"))


def transition_rows(decisions: DataFrame, as_of: Column, launches: DataFrame | None = None,
                    logs_base: str = "", max_iterations: int = MAX_ITERATIONS
                    ) -> dict[str, DataFrame]:
    """Everything the decisions write: events, run and flow updates, requests.

    ``launches`` (run_id, iteration_num, job_run_id, error) is what starting the jobs
    of new iterations gave: the run follows its new job, or fails and asks a human
    if there is none. Decisions should be of current runs only, as flows take the
    status of their run.
    """
    decisions = with_launches(decisions, launches)
    human = human_rows(hand_offs(decisions, logs_base, max_iterations), as_of)
    action, follow = F.col("action"), F.col("follow_up")
    status = (F.when(action == "MARK_RUNNING", "RUNNING")
              .when(action == "CANCEL_STOP", "CANCELLED")
              .when(follow == "FINISH", "SUCCESS")
              .when((follow == "NEXT_ITERATION") & F.col("launch_error").isNull(), F.col("status")))
    flow_status = (F.when(action == "MARK_RUNNING", "RUNNING")
                   .when(action == "CANCEL_STOP", "STOPPED").when(follow == "FINISH", "DONE"))
    ended = status.isin("SUCCESS", "CANCELLED")
    moved = decisions.withColumns({"_status": status, "_flow": flow_status, "_ended": ended})
    runs = moved.filter(F.col("_status").isNotNull()).select(
        "run_id", F.col("_status").alias("status"),
        F.when(F.col("_ended"), as_of).alias("end_ts"), F.col("next_job").alias("job_run_id"))
    flows = moved.filter(F.col("_flow").isNotNull()).select(
        "flow_id", F.col("_flow").alias("status"))
    return {
        "events": step_events(decisions, as_of).unionByName(human["events"]),
        "runs": runs.unionByName(human["runs"]),
        "flows": flows.unionByName(human["flows"]),
        "requests": human["requests"],
    }


def stop_requests(requests: DataFrame, flows: DataFrame, runs: DataFrame, latest: DataFrame
                  ) -> DataFrame:
    """Flows to stop: accepted with their run and next iteration, or refused.

    The status of the run is not looked at. Repeats collapse to one row per
    flow; identifiers that name no flow stay, refused.
    """
    pointed = (
        requests.select("identifier").distinct()
        .join(identifiers(flows, "current_run_id"), "identifier", "left")
        .select(F.coalesce("flow_id", F.col("identifier")).alias("flow_id"), "current_run_id")
        .distinct()
    )
    jobs = runs.filter(present(F.col("job_run_id")).isNotNull()).select(
        "run_id", F.col("run_id").alias("stopped_run_id")).join(
        latest.select("run_id", "iteration_num"), "run_id", "left")
    found = with_current_run(pointed, jobs)
    ok = F.col("stopped_run_id").isNotNull()
    return found.select(
        "flow_id", F.col("stopped_run_id").alias("run_id"), ok.alias("accepted"),
        F.when(ok, F.coalesce("iteration_num", F.lit(0)) + 1).alias("next_iteration"),
        F.when(~ok, NO_JOB).alias("error"))


def stop_rows(stops: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    done = stops.filter("accepted")
    return {
        "runs": done.select("run_id", F.lit("CANCELLED").alias("status"), as_of.alias("end_ts")),
        "flows": done.select("flow_id", F.lit("STOPPED").alias("status")),
        "events": done.select(
            "run_id", F.col("next_iteration").alias("iteration_num"),
            F.lit("user_cancellation").alias("step"), F.lit("COMPLETED").alias("step_status"),
            as_of.alias("ts"), F.lit(CANCELLED).alias("summary"),
            F.lit(None).cast("string").alias("error"),
            F.lit(1).cast("long").alias("event_seq")),
    }


# ---------------------------------------------------------------- time limits
def overdue_runs(runs: DataFrame, as_of: Column, limit_s: int = AGENT_LIMIT_S) -> DataFrame:
    """Unfinished runs older than the limit, and by how much."""
    age = epoch_seconds(as_of) - epoch_seconds(F.col("start_ts"))
    open_run = F.col("end_ts").isNull() & ~F.col("status").isin(TERMINAL_RUN)
    return runs.filter(open_run & (age > limit_s)).select(
        "run_id", "flow_id", "status", (age - limit_s).alias("overdue_s"))


def timed_out(executions: DataFrame, limit_s: int = EXECUTION_LIMIT_S) -> DataFrame:
    """Executions with the status the time limit gives them."""
    return executions.withColumn(
        "status", F.when(F.col("runtime_s") > limit_s, "TIMEOUT").otherwise(F.col("status")))


# -------------------------------------------------------------- security gate
def scan_gate(scans: DataFrame) -> DataFrame:
    """Iterations with a blocked scan, counts and the worst finding."""
    blocked = F.col("scan_status") == "BLOCKED"
    severity = F.get_json_object("findings_json", "$.severity").cast("int")
    return (
        scans.groupBy("run_id", "iteration_num")
        .agg(F.bool_or(blocked).alias("blocked"), F.count_if(blocked).alias("blocked_scans"),
             F.max(F.when(blocked, severity)).alias("worst_severity"))
        .filter("blocked").drop("blocked")
        .withColumn("reason", F.lit(REASON_SCAN))
    )


def scan_hand_offs(scans: DataFrame, runs: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Hand-offs for runs whose scans are blocked, at their last blocked iteration.

    With ``requests``: for open runs only, and not where that iteration was asked about.
    """
    if requests is not None:
        runs = runs.filter(~F.coalesce(F.col("status").isin(TERMINAL_RUN), F.lit(False)))
        scans = scans.join(runs.select("run_id"), "run_id", "left_semi")
    last = scan_gate(scans).groupBy("run_id").agg(F.max("iteration_num").alias("iteration_num"))
    if requests is not None:
        asked = requests.filter(F.col("reason") == REASON_SCAN).select("run_id", "iteration_num")
        last = last.join(asked, ["run_id", "iteration_num"], "left_anti")
    return runs.select("run_id", "flow_id").join(last, "run_id").select(
        "run_id", "flow_id", "iteration_num", F.lit(REASON_SCAN).alias("reason"),
        F.lit(None).cast("string").alias("instructions"))


# ---------------------------------------------------------------- executions
def execution_rows(jobs: DataFrame, as_of: Column, logs_base: str) -> DataFrame:
    """Execution records of finished jobs (run_id, iteration_num, n_artifacts,
    life_cycle_state, result_state, state_message, runtime_s)."""
    ok = F.col("result_state").eqNullSafe(F.lit("SUCCESS"))
    return jobs.filter(F.col("life_cycle_state") == "TERMINATED").select(
        "run_id", "iteration_num", F.lit("notebook_execution").alias("job_type"),
        F.when(ok, "SUCCESS").otherwise("FAILED").alias("status"), "runtime_s",
        F.when(~ok, F.coalesce(present(F.col("state_message")), F.lit(EXECUTION_FAILED))
               ).alias("error"),
        logs_path(logs_base, F.col("run_id"), F.col("iteration_num")).alias("logs_ref"),
        as_of.alias("ts"))


def execution_events(jobs: DataFrame, as_of: Column) -> DataFrame:
    """The start event of every execution and, when finished, its end event."""
    k, ok = F.col("iteration_num"), F.col("result_state").eqNullSafe(F.lit("SUCCESS"))
    begin = _event(k, "execute_notebooks", "RUNNING",
                   fill(EXECUTING, count=F.col("n_artifacts")))
    end = F.when(F.col("life_cycle_state") == "TERMINATED", F.when(ok, _event(
        k, "execute_notebooks", "COMPLETED", EXECUTED)).otherwise(_event(k, "execute_notebooks", "FAILED", error=F.coalesce(
        present(F.col("state_message")), F.lit(EXECUTION_FAILED)))))
    happened = F.filter(F.array(begin, end), lambda e: e.isNotNull())
    return jobs.select("run_id", F.posexplode(happened).alias("_at", "_e")).select(
        "run_id", "_e.*", as_of.alias("ts"), (F.col("_at") + 1).cast("long").alias("event_seq"))


# ------------------------------------------------------------------ hand-offs
def open_requests(requests: DataFrame, runs: DataFrame, flows: DataFrame) -> DataFrame:
    """Pending hand-offs with run and flow, oldest first.

    Only runs that are waited for are joined to their flows.
    """
    pending = requests.filter(F.col("status") == "PENDING").select(
        "run_id", "iteration_num", "reason", "instructions", "ts")
    placed = pending.join(runs.select("run_id", "flow_id"), "run_id")
    return placed.join(flows.select("flow_id", "flow_name"), "flow_id").select(
        "run_id", "iteration_num", "reason", "instructions", "ts", "flow_id", "flow_name",
    ).orderBy("ts", "run_id", "iteration_num")


def resolve_requests(requests: DataFrame, answers: DataFrame,
                     order: Sequence[str] | None = None) -> DataFrame:
    """Requests with the status given for their (run_id, iteration_num).

    Of several answers the last by ``order`` (columns of ``answers``) counts; without an
    order, answers that differ are an error.
    """
    keys = ["run_id", "iteration_num"]
    if order:
        status = F.max_by("status", F.struct(*order))
    else:
        differ = F.raise_error(F.concat(F.lit("several answers for "), F.concat_ws("/", *keys)))
        status = F.when(F.min("status") == F.max("status"), F.max("status")).when(
            F.count("status") > 0, differ.cast("string"))
    given = answers.groupBy(*keys).agg(status.alias("_new"))
    return requests.join(given, ["run_id", "iteration_num"], "left").withColumn(
        "status", F.coalesce("_new", "status")).select(*requests.columns)


def latest_of(events: DataFrame) -> DataFrame:
    return latest_events(events.select("run_id", "iteration_num", "ts", "event_seq", "step", "step_status"))
