"""Workflow rules on hand-written rows: admission, next action, hand-off, stop."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import latest, rules
from ledgerline.operators.joins import status_snapshot
from ledgerline.plans import limits, poll
from tests.conftest import rows
from tests.ledgers import T0, T1, T2, event, flow, ledger, run, states, table

def now():
    return F.lit(T2)



# ---------------------------------------------------------------- admission
@pytest.fixture(scope="module")
def admitted(spark):
    flows = table(spark, "flows", [
        flow("1", "NOT_STARTED"), flow("2", "RUNNING", "r2"), flow("3", "DONE", path=""),
        flow("4", "FAILED", path=None), flow("5", "STOPPED"), flow("name-5", "DONE")])
    asked = ["1", "name-1", "2", "3", "4", "gone", "gone", "name-5", "5"]
    requests = spark.createDataFrame(list(enumerate(asked)), "pos long, identifier string")
    return {r["pos"]: r for r in rules.admit(requests, flows).collect()}


def test_admission(admitted):
    got = [(r["flow_id"], r["accepted"], r["error"]) for _, r in sorted(admitted.items())]
    assert got == [
        ("1", True, None), ("1", False, "Conversion already in progress"),
        ("2", False, "Conversion already in progress"),
        ("3", False, "XML path not configured for this flow"),
        ("4", False, "XML path not configured for this flow"),
        (None, False, "Flow not found"), (None, False, "Flow not found"),
        ("name-5", True, None), ("5", True, None)]
    assert admitted[2]["current_run_id"] == "r2" and admitted[1]["current_run_id"] is None


def test_started_and_failed_starts(spark):
    admitted = spark.createDataFrame(
        [("1", "a", True), ("2", "b", True), ("3", "c", False), ("4", "d", True)],
        "flow_id string, flow_name string, accepted boolean")
    launches = spark.createDataFrame(
        [("1", "77", None), ("2", None, "no cluster")],
        "flow_id string, job_run_id string, error string")
    got = rules.start_rows(admitted, now(), launches)
    runs = {r["flow_id"]: (r["status"], r["job_run_id"]) for r in got["runs"].collect()}
    assert runs == {"1": ("QUEUED", "77"), "2": ("FAILED", None), "4": ("FAILED", None)}
    steps = {r["run_id"].split("_")[0]: (r["step"], r["step_status"], r["error"])
             for r in got["events"].collect()}
    assert steps == {"1": ("agent_generate", "RUNNING", None),
                     "2": ("job_creation", "FAILED", "no cluster"),
                     "4": ("job_creation", "FAILED", "job was not created")}
    flows = {r["flow_id"]: r["status"] for r in got["flows"].collect()}
    assert flows == {"1": "RUNNING", "2": "NEEDS_HUMAN", "4": "NEEDS_HUMAN"}


# -------------------------------------------------------------- next action
DONE, FAIL = ("TERMINATED", "SUCCESS"), ("TERMINATED", "FAILED")
CASES = {
    # name: run status, job, (life cycle, result, message), last event, artifacts at,
    #       execution, expected action and follow-up
    "no_job": ("RUNNING", None, None, None, None, None, ("FLOW_ONLY", None)),
    "empty_job": ("RUNNING", "", None, None, None, None, ("FLOW_ONLY", None)),
    "finished": ("SUCCESS", "job", DONE, (1, "agent_generate"), 1, None, ("CACHED", None)),
    "pending": ("QUEUED", "job", ("PENDING",), None, None, None, ("NONE", None)),
    "begins": ("QUEUED", "job", ("RUNNING",), None, None, None, ("MARK_RUNNING", None)),
    "runs": ("RUNNING", "job", ("RUNNING",), None, None, None, ("NONE", None)),
    "ending": ("QUEUED", "job", ("TERMINATING",), None, None, None, ("NONE", None)),
    "odd_state": ("RUNNING", "job", ("SKIPPED",), None, None, None, ("NONE", None)),
    "no_state": ("RUNNING", "job", None, None, None, None, ("NONE", None)),
    "poll_error": ("RUNNING", "job", ("x", None, None, "timeout"), (2, "finalize"), None, None,
                   ("ERROR", None)),
    "made_nothing": ("RUNNING", "job", DONE, (1, "agent_generate"), None, None,
                     ("EXECUTE_GENERATED", "NO_ARTIFACTS")),
    "made": ("RUNNING", "job", DONE, (1, "agent_generate"), 1, None,
             ("EXECUTE_GENERATED", "AWAIT")),
    "made_ok": ("RUNNING", "job", DONE, (1, "agent_generate"), 1, "SUCCESS",
                ("EXECUTE_GENERATED", "FINISH")),
    "made_bad": ("RUNNING", "job", DONE, (1, "agent_generate"), 1, "FAILED",
                 ("EXECUTE_GENERATED", "NEXT_ITERATION")),
    "fixed_ok": ("RUNNING", "job", DONE, (3, "agent_fix_errors"), 3, "SUCCESS",
                 ("EXECUTE_FIXED", "FINISH")),
    "fixed_bad": ("RUNNING", "job", DONE, (4, "agent_fix_errors"), 4, "TIMEOUT",
                  ("EXECUTE_FIXED", "NEXT_ITERATION")),
    "fixed_last": ("RUNNING", "job", DONE, (5, "agent_fix_errors"), 5, "FAILED",
                   ("EXECUTE_FIXED", "HAND_OFF")),
    "other_step": ("RUNNING", "job", DONE, (4, "finalize"), 1, None, ("NONE", None)),
    "no_event": ("RUNNING", "job", DONE, None, None, None, ("NONE", None)),
    "failed": ("RUNNING", "job", FAIL, (2, "read_logs"), None, None, ("FAIL_NEEDS_HUMAN", None)),
    "failed_early": ("RUNNING", "job", FAIL + ("boom",), None, None, None,
                     ("FAIL_NEEDS_HUMAN", None)),
    "cancelled": ("RUNNING", "job", ("TERMINATED", "CANCELED"), None, None, None,
                  ("CANCEL_STOP", None)),
    "no_result": ("RUNNING", "job", ("TERMINATED", None), None, None, None,
                  ("CANCEL_STOP", None)),
}


@pytest.fixture(scope="module")
def world(spark):
    data = {"flows": [], "runs": [], "events": [], "artifacts": [], "executions": []}
    told = []
    for name, (status, job, state, last, made, executed, _) in CASES.items():
        data["flows"].append(flow(name, run=f"r-{name}"))
        data["runs"].append(run(f"r-{name}", name, status, job))
        if last:
            data["events"].append(event(f"r-{name}", last[0], last[1]))
        if made:
            data["artifacts"] += [{"run_id": f"r-{name}", "iteration_num": made,
                                   "artifact_ref": f"/o/{k}.py", "ts": T0} for k in "ab"]
        if executed:
            data["executions"].append({
                "run_id": f"r-{name}", "iteration_num": made, "job_type": "notebook_execution",
                "status": executed, "runtime_s": 5, "logs_ref": f"/logs/{name}", "ts": T1,
                "error": "" if executed == "FAILED" else None})
        if state:
            told.append(dict(zip(
                ("life_cycle_state", "result_state", "state_message", "poll_error"), state),
                job_run_id=f"{job}-r-{name}"))
    tables = ledger(spark, **data)
    decisions = poll.decide(tables, states(spark, told)).cache()
    result = poll.apply(tables, decisions, now(), logs_base="/logs")
    return {"tables": tables, "decisions": decisions, "result": result}


def test_actions(world):
    got = {r["flow_id"]: (r["action"], r["follow_up"]) for r in world["decisions"].collect()}
    assert got == {name: case[-1] for name, case in CASES.items()}


def test_events_of_actions(world):
    got = {}
    for r in world["result"]["events"].orderBy("run_id", "event_seq").collect():
        got.setdefault(r["run_id"][2:], []).append(
            (r["iteration_num"], r["step"], r["step_status"], r["summary"] or r["error"]))
    closed = (1, "agent_generate", "COMPLETED", "Agent completed notebook generation")
    running = (1, "execute_notebooks", "RUNNING", "Executing 2 notebooks...")
    assert got["made_nothing"] == [closed]
    assert got["made"] == [closed, running]
    assert got["made_ok"] == [closed, running, (
        1, "execute_notebooks", "COMPLETED", "All notebooks executed successfully")]
    assert got["made_bad"] == [
        closed, running, (1, "execute_notebooks", "FAILED", "Execution failed"),
        (2, "agent_fix_errors", "RUNNING", "Agent analyzing logs and fixing errors (iteration 2)...")]
    assert [e[:3] for e in got["fixed_last"]] == [
        (5, "agent_fix_errors", "COMPLETED"), (5, "execute_notebooks", "RUNNING"),
        (5, "execute_notebooks", "FAILED"), (6, "needs_human", "COMPLETED")]
    assert got["failed"] == [(2, "read_logs", "FAILED", "Job failed"), (
        3, "needs_human", "COMPLETED", "Marked as NEEDS_HUMAN: agent_job_failed")]
    assert [e[:2] for e in got["failed_early"]] == [(2, "needs_human")]
    assert [e[:2] for e in got["poll_error"]] == [(3, "needs_human")]
    assert not {"no_job", "finished", "runs", "begins", "other_step", "cancelled"} & set(got)


def test_states_of_actions(world):
    before = {r["flow_id"]: r["status"] for r in world["tables"]["runs"].collect()}
    runs = {r["flow_id"]: r for r in world["result"]["runs"].collect()}
    flows = {r["flow_id"]: r for r in world["result"]["flows"].collect()}
    want = {"begins": ("RUNNING", "RUNNING"), "made_ok": ("SUCCESS", "DONE"),
            "fixed_ok": ("SUCCESS", "DONE"), "fixed_last": ("FAILED", "NEEDS_HUMAN"),
            "failed": ("FAILED", "NEEDS_HUMAN"), "failed_early": ("FAILED", "NEEDS_HUMAN"),
            "poll_error": ("FAILED", "NEEDS_HUMAN"), "cancelled": ("CANCELLED", "STOPPED"),
            "no_result": ("CANCELLED", "STOPPED")}
    for name in CASES:
        run_status, flow_status = want.get(name, (before[name], "RUNNING"))
        assert (name, runs[name]["status"], flows[name]["status"]) == (
            name, run_status, flow_status)
        ended = name in want and name != "begins"
        assert runs[name]["end_ts"] == (T2 if ended else None)
        assert flows[name]["updated_ts"] == (T2 if name in want else T0)


def test_requests_of_actions(world):
    got = {r["run_id"][2:]: r for r in world["result"]["requests"].collect()}
    assert {k: (r["iteration_num"], r["reason"]) for k, r in got.items()} == {
        "fixed_last": (5, "max_iterations_reached"), "failed": (2, "agent_job_failed"),
        "failed_early": (1, "agent_job_failed"), "poll_error": (2, "orchestration_error")}
    assert got["failed_early"]["instructions"] == "Agent job failed: boom"
    assert got["poll_error"]["instructions"] == "Error during orchestration: timeout"
    assert got["fixed_last"]["instructions"].endswith("Review logs at /logs/fixed_last")


def test_new_iteration_follows_its_job(spark, world):
    launches = spark.createDataFrame([("r-made_bad", 2, "new-job"), ("r-made_ok", 2, "unused")],
                                     "run_id string, iteration_num int, job_run_id string")
    rows = rules.transition_rows(world["decisions"], now(), launches)
    got = poll.update_runs(world["tables"]["runs"], rows["runs"])
    jobs = {r["flow_id"]: r["job_run_id"] for r in got.collect()}
    assert jobs["made_bad"] == "new-job" and jobs["made_ok"] == "job-r-made_ok"


# ------------------------------------------------------- snapshot and others
def test_snapshot_keeps_gaps(spark):
    tables = ledger(
        spark, flows=[flow("a", "DONE", "ra"), flow("b", "RUNNING", "rb"), flow("c"),
                      flow("d", run=""), flow("e", run="gone"), flow("f", run="rf")],
        runs=[run("ra", "a", "SUCCESS"), run("rb", "b"), run("rf", "f", job=None),
              run("c", "x"), run("d", "x")],
        events=[event("ra", 1, "s1", "COMPLETED", error="old"), event("rb", 1, "s", "RUNNING"),
                event("rb", 1, "s", "FAILED", T1, error="bad"), event("rf", 1, "hidden"),
                event("c", 1, "not a pointer")])
    got = {r["flow_id"]: (r["run_status"], r["current_step"], r["step_status"], r["error"])
           for r in status_snapshot(tables["flows"], tables["runs"], tables["events"]).collect()}
    none = (None, None, None, None)
    assert got == {"a": ("SUCCESS", "s1", None, None), "b": ("RUNNING", "s", "FAILED", "bad"),
                   "c": none, "d": none, "e": none, "f": none}


def test_latest_uses_time_then_sequence(spark):
    events = table(spark, "events", [
        event("r", 1, "x", "RUNNING", T0, 9), event("r", 1, "x", "COMPLETED", T1, 1),
        event("q", 2, "late", "RUNNING", T0, 1), event("q", 2, "last", "RUNNING", T0, 2),
        event("q", 1, "early", "FAILED", T2, 3), event("n", 1, "timed", ts=T0),
        event("n", 1, "untimed", ts=None)])
    for form in (latest.latest_events, latest.latest_events_aggregated):
        got = {r["run_id"]: (r["step"], r["step_status"]) for r in form(events).collect()}
        assert got == {"r": ("x", "COMPLETED"), "q": ("last", "RUNNING"),
                       "n": ("timed", "RUNNING")}


def test_stop(spark):
    tables = ledger(
        spark, flows=[flow("a", run="ra"), flow("b", run="rb"), flow("c")],
        runs=[run("ra", "a", "SUCCESS"), run("rb", "b", job="")],
        events=[event("ra", 3, "s")])
    asked = spark.createDataFrame([(n, x) for n, x in enumerate(["a", "name-a", "b", "c", "?"])],
                                  "pos int, identifier string")
    stops = rules.stop_requests(asked, tables["flows"], tables["runs"],
                                rules.latest_of(tables["events"]))
    got = {r["flow_id"]: (r["accepted"], r["next_iteration"], r["error"]) for r in stops.collect()}
    no = (False, None, "No running job found")
    assert got == {"a": (True, 4, None), "b": no, "c": no, "?": no}
    assert [r["step"] for r in rules.stop_rows(stops, now())["events"].collect()] == [
        "user_cancellation"]


def test_agent_calls(spark):
    calls = spark.createDataFrame(
        [("r", "f", "n", 1, "/x", None), ("r", "f", "", 1, "/x", None),
         ("r", "f", "n", 1, "", "/l"), ("r", "f", "n", 2, None, None),
         ("r", "f", "n", 2, None, "/l")],
        "run_id string, flow_id string, flow_name string, iteration_num int, "
        "source_path string, logs_path string")
    got = [r["message"] for r in rules.agent_call_check(calls).collect()]
    assert got == [None, rules.MISSING_PARAMETERS, rules.SOURCE_REQUIRED, rules.LOGS_REQUIRED,
                   None]


def test_limits(spark):
    runs = table(spark, "runs", [
        run("old", "f", start_ts=T0), run("done", "f", "FAILED", start_ts=T0),
        run("young", "f", start_ts=T1), run("ended", "f", start_ts=T0, end_ts=T0)])
    got = rules.overdue_runs(runs, now(), 7000).collect()
    assert [(r["run_id"], r["overdue_s"]) for r in got] == [("old", 200)]


def test_scan_gate(spark):
    scans = table(spark, "scans", [
        {"run_id": "r", "iteration_num": n, "artifact_ref": a, "scan_status": s,
         "findings_json": j} for n, a, s, j in [
            (1, "a", "BLOCKED", '{"severity":3}'), (1, "b", "BLOCKED", "broken"),
            (1, "c", "PASSED", '{"severity":9}'), (2, "a", "PASSED", None)]])
    got = [tuple(r) for r in rules.scan_gate(scans).collect()]
    assert got == [("r", 1, 2, 3, "sast_blocked")]


def test_runs_of_one_second_have_ids_of_their_own(spark):
    admitted = spark.createDataFrame([(True, "a", "n"), (True, "b", "m")], "accepted boolean, flow_id string, flow_name string")
    runs, ids = table(spark, "runs"), []
    for _ in range(3):
        new = rules.start_rows(admitted, now(), runs=runs)["runs"]
        ids.append(sorted(r["run_id"] for r in new.collect()))
        runs = runs.unionByName(new.filter("flow_id = 'a'"), allowMissingColumns=True)
    seconds = ids[0][0].removeprefix("a_run_")
    assert ids == [[f"a_run_{seconds}{end}", f"b_run_{seconds}"] for end in ("", "_2", "_3")]


def test_limits_that_act(spark):
    old = T0 - timedelta(hours=9)
    tables = ledger(
        spark, flows=[flow("a", run="ra"), flow("b", run="rb"), flow("c", run="rc"), flow("d", run="rd")],
        runs=[run("ra", "a", start_ts=old), run("rb", "b"), run("rc", "c", job=None, start_ts=old),
              run("rd", "d", "SUCCESS", start_ts=old, end_ts=T0), run("before", "a", start_ts=old)],
        executions=[{"run_id": "ra", "iteration_num": 1, "job_type": "flow_job", "status": "SUCCESS", "runtime_s": s}
                    for s in (3600, 3601)])
    done = limits.enforce(tables, F.lit(T0))
    runs = {r["run_id"]: (r["status"], r["end_ts"]) for r in done["runs"].collect()}
    # the run that no flow points to, and the one without a job, are told of but not ended
    assert runs == {"ra": ("CANCELLED", T0), "rb": ("RUNNING", None), "rc": ("RUNNING", None),
                    "rd": ("SUCCESS", T0), "before": ("RUNNING", None)}
    assert {r["flow_id"]: r["status"] for r in done["flows"].collect()} == {
        "a": "STOPPED", "b": "RUNNING", "c": "RUNNING", "d": "RUNNING"}
    assert sorted(r["status"] for r in done["executions"].collect()) == ["SUCCESS", "TIMEOUT"]
    again = limits.enforce({**tables, **{n: done[n] for n in ("flows", "runs", "executions")}}, F.lit(T2))
    for name in ("runs", "executions"):
        assert rows(again[name]) == rows(done[name])
    assert again["events"].isEmpty() and again["requests"].isEmpty()
