"""Table schemas, keys, links, status domains and other fixed values."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampType()


def _table(required: dict, optional: dict) -> T.StructType:
    fields = [T.StructField(n, t, False) for n, t in required.items()]
    return T.StructType(fields + [T.StructField(n, t, True) for n, t in optional.items()])


FLOWS = _table(
    {"flow_id": _S, "flow_name": _S, "status": _S},
    {"current_run_id": _S, "updated_ts": _TS, "server": _S, "source_path": _S,
     "description": _S, "priority": _S, "owner": _S},
)
RUNS = _table(
    {"run_id": _S, "flow_id": _S},
    {"job_run_id": _S, "start_ts": _TS, "end_ts": _TS, "status": _S},
)
EVENTS = _table(
    {"run_id": _S, "iteration_num": _I},
    {"step": _S, "step_status": _S, "ts": _TS, "summary": _S, "error": _S, "event_seq": _L},
)
ARTIFACTS = _table(
    {"run_id": _S, "iteration_num": _I, "artifact_ref": _S},
    {"patch_summary": _S, "diff_ref": _S, "ts": _TS},
)
SCANS = _table(
    {"run_id": _S, "iteration_num": _I, "artifact_ref": _S},
    {"scan_status": _S, "findings_json": _S, "ts": _TS},
)
EXECUTIONS = _table(
    {"run_id": _S, "iteration_num": _I, "job_type": _S},
    {"status": _S, "runtime_s": _I, "error": _S, "logs_ref": _S, "ts": _TS},
)
REQUESTS = _table(
    {"run_id": _S, "iteration_num": _I},
    {"reason": _S, "instructions": _S, "status": _S, "ts": _TS},
)
LEGACY_FLOWS = _table(
    {"flow_name": _S},
    {"server": _S, "source_path": _S, "description": _S, "priority": _S, "owner": _S,
     "status": _S, "job_id": _S, "job_run_id": _S, "progress_percentage": _I,
     "iterations": _I, "validation_percentage": _I, "current_attempt_id": _S,
     "total_attempts": _I, "successful_conversions": _I, "last_attempt_at": _TS,
     "first_attempt_at": _TS, "created_at": _TS, "last_updated": _TS,
     "conversion_started_at": _TS, "conversion_completed_at": _TS,
     "generated_artifacts": T.ArrayType(_S), "error_message": _S, "status_message": _S},
)
LEGACY_ATTEMPTS = _table(
    {"attempt_id": _S, "flow_name": _S},
    {"job_id": _S, "job_name": _S, "status": _S, "started_at": _TS, "attempt_number": _I,
     "triggered_by": _S, "completed_at": _TS},
)
JOB_STATES = T.StructType([
    T.StructField("job_run_id", _S), T.StructField("life_cycle_state", _S),
    T.StructField("result_state", _S), T.StructField("state_message", _S),
    T.StructField("start_time", _L), T.StructField("end_time", _L),
    T.StructField("tasks", T.ArrayType(T.StructType([
        T.StructField("task_key", _S), T.StructField("artifact_path", _S),
        T.StructField("life_cycle_state", _S), T.StructField("state_message", _S),
        T.StructField("start_time", _L), T.StructField("end_time", _L),
    ]))),
])

TABLES = {
    "flows": FLOWS, "runs": RUNS, "events": EVENTS, "artifacts": ARTIFACTS,
    "scans": SCANS, "executions": EXECUTIONS, "requests": REQUESTS,
}

# Keys as declared. Events are an append-only trail, so several rows may share
# (run_id, iteration_num); EVENT_ORDER makes "latest" total.
KEYS = {
    "flows": ["flow_id"],
    "runs": ["run_id"],
    "events": ["run_id", "iteration_num"],
    "artifacts": ["run_id", "iteration_num", "artifact_ref"],
    "scans": ["run_id", "iteration_num", "artifact_ref"],
    "executions": ["run_id", "iteration_num", "job_type"],
    "requests": ["run_id", "iteration_num"],
}
EVENT_ORDER = ["iteration_num", "ts", "event_seq"]

# Order of rows in compacted files: rows of a run lie together, so that reads by
# run skip files and "latest per run" meets each run in one or two splits.
LAYOUT = {
    "flows": ["flow_id"],
    "runs": ["run_id"],
    "events": ["run_id", *EVENT_ORDER],
    "artifacts": ["run_id", "iteration_num", "artifact_ref", "ts"],
    "scans": ["run_id", "iteration_num", "artifact_ref", "ts"],
    "executions": ["run_id", "iteration_num", "job_type", "ts"],
    "requests": ["run_id", "iteration_num", "ts"],
}

# child table, child column, parent table, parent column
LINKS = [
    ("runs", "flow_id", "flows", "flow_id"),
    ("events", "run_id", "runs", "run_id"),
    ("artifacts", "run_id", "runs", "run_id"),
    ("scans", "run_id", "runs", "run_id"),
    ("executions", "run_id", "runs", "run_id"),
    ("requests", "run_id", "runs", "run_id"),
    ("flows", "current_run_id", "runs", "run_id"),
]

# ---------------------------------------------------------------- fixed values
DOMAINS = {
    ("flows", "status"): ["NOT_STARTED", "RUNNING", "NEEDS_HUMAN", "FAILED", "DONE", "STOPPED"],
    ("flows", "priority"): ["P0", "P1", "P2"],
    ("runs", "status"): ["CREATING", "QUEUED", "RUNNING", "SUCCESS", "FAILED", "CANCELLED"],
    ("events", "step_status"): ["RUNNING", "COMPLETED", "FAILED"],
    ("scans", "scan_status"): ["PENDING", "SCANNING", "PASSED", "BLOCKED"],
    ("executions", "status"): ["SUCCESS", "FAILED", "TIMEOUT"],
    ("executions", "job_type"): ["flow_job", "validation_job", "notebook_execution"],
    ("requests", "status"): ["PENDING", "RESOLVED", "IGNORED"],
}
TERMINAL_RUN = ["SUCCESS", "FAILED", "CANCELLED"]
STARTABLE = ["NOT_STARTED", "NEEDS_HUMAN", "NEEDS_ATTENTION", "FAILED", "STOPPED"]
ACTIVE_JOB = ["PENDING", "RUNNING", "TERMINATING"]

MAX_ITERATIONS = 5
EXECUTION_LIMIT_S = 3600
AGENT_LIMIT_S = 7200
KEEP_LATEST = 3
HISTORY_ROWS = 20
PREVIEW_LINES = 50

INTENTS = {
    "ingestion": ["GetFile", "GetHTTP", "GetSFTP", "GetFTP", "GetDatabase", "ConsumeKafka",
                  "ConsumeKafka_2_0", "ListS3", "FetchS3Object", "GetJMSQueue"],
    "transformation": ["UpdateAttribute", "ExecuteStreamCommand", "ExecuteScript",
                       "ExecuteProcess", "JoltTransformJSON", "ConvertRecord",
                       "ConvertJSONToSQL", "ReplaceText", "ModifyBytes", "SplitText",
                       "MergeContent"],
    "routing": ["RouteOnAttribute", "RouteOnContent", "DistributeLoad", "RouteText"],
    "flow_control": ["ControlRate", "Wait", "Notify", "MonitorActivity"],
    "output": ["PutFile", "PutHDFS", "PutS3Object", "PutDatabase", "PutDatabaseRecord",
               "PutKafka", "PutEmail", "PutFTP", "PutSFTP"],
    "monitoring": ["LogMessage", "LogAttribute"],
}
DEFINITION_ROOTS = ["flowController", "template", "templateDTO"]

LEGACY_FLOW_STATUS = {
    "NOT_STARTED": "NOT_STARTED", "CONVERTING": "RUNNING", "DONE": "DONE",
    "NEEDS_ATTENTION": "NEEDS_HUMAN", "FAILED": "FAILED",
}
LEGACY_RUN_STATUS = ["CREATING", "RUNNING", "SUCCESS", "FAILED", "CANCELLED"]
STATUS_BADGES = {
    "NOT_STARTED": ("Not Started", "gray"),
    "RUNNING": ("Running", "blue"),
    "DONE": ("Done", "green"),
    "NEEDS_HUMAN": ("Needs Human", "red"),
    "FAILED": ("Failed", "red"),
    "STOPPED": ("Stopped", "yellow"),
    "CONVERTING": ("Running", "blue"),
    "NEEDS_ATTENTION": ("Needs Human", "red"),
}
