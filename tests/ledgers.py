"""Small hand-written ledger tables."""

from datetime import datetime

from ledgerline.schemas import JOB_STATES, TABLES

T0 = datetime(2024, 1, 1, 12)
T1 = datetime(2024, 1, 1, 13)
T2 = datetime(2024, 1, 1, 14)


def table(spark, name, data=()):
    """Rows given as dicts; absent columns are NULL."""
    schema = TABLES[name]
    return spark.createDataFrame([tuple(row.get(f, None) for f in schema.fieldNames())
                                  for row in data], schema)


def ledger(spark, **data):
    return {name: table(spark, name, data.get(name, ())) for name in TABLES}


def states(spark, data):
    fields = [f for f in JOB_STATES.fieldNames() if f in (
        "job_run_id", "life_cycle_state", "result_state", "state_message")] + ["poll_error"]
    return spark.createDataFrame([tuple(row.get(f) for f in fields) for row in data],
                                 ", ".join(f"{f} string" for f in fields))


def flow(flow_id, status="RUNNING", run=None, path="/v/f.xml", **more):
    return {"flow_id": flow_id, "flow_name": f"name-{flow_id}", "status": status,
            "current_run_id": run, "source_path": path, "updated_ts": T0, **more}


def run(run_id, flow_id, status="RUNNING", job="job", **more):
    return {"run_id": run_id, "flow_id": flow_id, "status": status, "start_ts": T0,
            "job_run_id": f"{job}-{run_id}" if job else job, **more}


def event(run_id, n, step, status="RUNNING", ts=T0, seq=1, **more):
    return {"run_id": run_id, "iteration_num": n, "step": step, "step_status": status,
            "ts": ts, "event_seq": seq, **more}
