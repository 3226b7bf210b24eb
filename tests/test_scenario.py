"""One flow from registration to completion, through the store."""

from datetime import timedelta

from pyspark.sql import functions as F

from ledgerline.operators import rules
from ledgerline.plans import ingest, poll
from ledgerline.schemas import TABLES
from ledgerline.session import new_dir
from ledgerline.sources.store import Store
from tests.ledgers import T0, states, table


def test_flow_from_start_to_done(spark):
    store = Store(spark, new_dir(spark, "scenario"))
    clock = [T0]

    def now():
        clock[0] += timedelta(minutes=1)
        return F.lit(clock[0])

    def tables():
        return {name: store.read_or_empty(name) for name in TABLES}

    def flow():
        return store.read("flows").first()

    # 1 registered
    files = spark.createDataFrame(
        [("/v/defs/prod/pay.xml", "<template><groupId>abc-123</groupId></template>")],
        "path string, content string")
    store.commit(replace={"flows": ingest.ingest(
        table(spark, "flows"), ingest.catalogue(files, "defs"), now())}, check_keys=True)
    assert (flow()["flow_id"], flow()["status"], flow()["server"]) == (
        "abc-123", "NOT_STARTED", "prod")

    # 2 started
    asked = spark.createDataFrame([(0, "pay")], "pos int, identifier string")
    admitted = rules.admit(asked, store.read("flows"))
    launches = spark.createDataFrame([("abc-123", "j1", None)],
                                     "flow_id string, job_run_id string, error string")
    begun = poll.start(tables(), admitted, now(), launches)
    store.commit(replace={"flows": begun["flows"]},
                 append={"runs": begun["runs"], "events": begun["events"]})
    run_id = flow()["current_run_id"]
    assert flow()["status"] == "RUNNING" and run_id.startswith("abc-123_run_")
    again = rules.admit(asked, store.read("flows")).first()
    assert (again["accepted"], again["current_run_id"]) == (False, run_id)

    def step(job, state, result, launch=None):
        told = states(spark, [{"job_run_id": job, "life_cycle_state": state,
                               "result_state": result}])
        jobs = launch and spark.createDataFrame(
            [(run_id, *launch)], "run_id string, iteration_num int, job_run_id string")
        before = tables()
        done = poll.apply(before, poll.decide(before, told), now(), jobs or None, "/logs")
        store.commit(replace={"flows": done["flows"], "runs": done["runs"]},
                     append={"events": done["events"], "requests": done["requests"]})

    def wrote(name, **row):
        store.commit(append={name: table(spark, name, [{"run_id": run_id, "ts": clock[0], **row}])})

    # 3 the job runs, and writes an artifact
    step("j1", "RUNNING", None)
    assert store.read("runs").first()["status"] == "RUNNING"
    wrote("artifacts", iteration_num=1, artifact_ref="processor_1.py")
    # 4 the scan passes
    wrote("scans", iteration_num=1, artifact_ref="processor_1.py", scan_status="PASSED")
    assert rules.scan_gate(store.read("scans")).isEmpty()
    # 5 the poll comes before the result, and again; then the execution fails, 6 so the errors are fixed
    step("j1", "TERMINATED", "SUCCESS")
    step("j1", "TERMINATED", "SUCCESS")
    assert [r["step_status"] for r in store.read("events").filter("step = 'execute_notebooks'").collect()] == ["RUNNING"]
    wrote("executions", iteration_num=1, job_type="validation_job", status="FAILED")
    step("j1", "TERMINATED", "SUCCESS", launch=(2, "j2"))
    last = rules.latest_of(store.read("events")).first()
    assert (last["step"], last["iteration_num"]) == ("agent_fix_errors", 2)
    assert store.read("runs").first()["job_run_id"] == "j2"
    wrote("artifacts", iteration_num=2, artifact_ref="processor_1.py")
    wrote("executions", iteration_num=2, job_type="validation_job", status="SUCCESS")
    step("j2", "TERMINATED", "SUCCESS")

    # 7 done
    run = store.read("runs").first()
    assert (run["status"], flow()["status"]) == ("SUCCESS", "DONE") and run["end_ts"] is not None
    steps = [(r["iteration_num"], r["step"], r["step_status"]) for r in
             store.read("events").orderBy("ts", "event_seq").collect()]
    assert steps == [
        (1, "agent_generate", "RUNNING"), (1, "agent_generate", "COMPLETED"),
        (1, "execute_notebooks", "RUNNING"), (1, "execute_notebooks", "FAILED"),
        (2, "agent_fix_errors", "RUNNING"), (2, "agent_fix_errors", "COMPLETED"),
        (2, "execute_notebooks", "RUNNING"), (2, "execute_notebooks", "COMPLETED")]
    # a finished run is left alone
    step("j2", "TERMINATED", "FAILED")
    assert flow()["status"] == "DONE" and store.read("requests").isEmpty()
