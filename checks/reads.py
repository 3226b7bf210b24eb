"""Lookups, joins, totals, rankings and ordered reads."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import check
from ledgerline.functions.status import badge, progress_text
from ledgerline.functions.text import record_json
from ledgerline.operators import joins, latest, lookup, totals
from ledgerline.operators.rules import admit
from ledgerline.schemas import FLOWS, LEGACY_FLOWS
from ledgerline.session import new_dir
from ledgerline.sources.tables import LEGACY_DEFAULTS, conform, keep_by_key, read_table

LAST = """
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id
  ORDER BY iteration_num DESC, ts DESC, event_seq DESC) AS rn FROM b_iterations) q WHERE rn = 1)"""

SNAPSHOT = f"""{LAST},
snap AS (SELECT f.*, r.status AS run_status,
  CASE WHEN r.run_id IS NOT NULL THEN e.step END AS current_step,
  CASE WHEN r.run_id IS NOT NULL THEN e.summary END AS current_summary,
  CASE WHEN r.run_id IS NOT NULL THEN e.iteration_num END AS current_iteration,
  CASE WHEN r.status NOT IN ('SUCCESS','FAILED','CANCELLED') THEN e.step_status END AS step_status,
  CASE WHEN r.status NOT IN ('SUCCESS','FAILED','CANCELLED') THEN nullif(e.error, '') END AS error
  FROM b_flows f LEFT JOIN b_runs r ON r.run_id = f.current_run_id AND r.job_run_id IS NOT NULL
  LEFT JOIN last e ON e.run_id = r.run_id)"""

KNOWN = """
known AS (SELECT q.pos, q.identifier, coalesce(a.flow_id, b.flow_id) AS flow_id
  FROM b_requests q LEFT JOIN b_flows a ON a.flow_id = q.identifier
  LEFT JOIN (SELECT flow_name, min(flow_id) AS flow_id FROM b_flows GROUP BY flow_name) b
    ON b.flow_name = q.identifier)"""


def snapshot(i) -> DataFrame:
    return joins.status_snapshot(i("b_flows"), i("b_runs"), i("b_iterations"))


# ------------------------------------------------------------------- scans
@check("s3_full_scan", "SELECT * FROM b_flows")
def full_scan(i):
    return i("b_flows")


@check("s3_read_table", "SELECT * FROM customer")
def whole_table(i):
    return read_table(i.spark, f"{i.folder}/customer.parquet")


@check("s3_read_limited", "SELECT least(7, count(*)) AS rows FROM customer")
def limited_table(i):
    return read_table(i.spark, f"{i.folder}/customer.parquet", 7).agg(F.count("*").alias("rows"))


# ----------------------------------------------------------------- lookups
@check("f1_flow_of_each_run", """
SELECT r.run_id, r.flow_id, f.flow_name, f.status AS flow_status
FROM b_runs r JOIN b_flows f ON f.flow_id = r.flow_id""")
def flow_of_each_run(i):
    flows = i("b_flows").select("flow_id", "flow_name", F.col("status").alias("flow_status"))
    return i("b_runs").select("run_id", "flow_id").join(flows, "flow_id").select(
        "run_id", "flow_id", "flow_name", "flow_status")


@check("f1_by_id", "SELECT * FROM b_flows WHERE flow_id = '7'")
def by_id(i):
    return lookup.by_id(i("b_flows"), "flow_id", "7")


@check("f2_by_name", """
SELECT name AS flow_name, min(id) AS flow_id FROM b_processors WHERE name = (SELECT min(name) FROM b_processors) GROUP BY name""")
def by_name(i):
    named = i("b_processors").select(F.col("name").alias("flow_name"), F.col("id").alias("flow_id"))
    return lookup.by_name(named, named.agg(F.min("flow_name")).first()[0])


@check("f2_first_per_name", """
SELECT name AS flow_name, min(id) AS flow_id FROM b_processors GROUP BY name""")
def first_per_name(i):
    named = i("b_processors").select(F.col("name").alias("flow_name"), F.col("id").alias("flow_id"))
    return lookup.first_per_name(named)


@check("f3_resolved", f"WITH {KNOWN} SELECT * FROM known WHERE flow_id IS NOT NULL")
def resolved(i):
    return lookup.resolved(i("b_requests"), i("b_flows")).select("pos", "identifier", "flow_id")


@check("f3_unresolved", f"WITH {KNOWN} SELECT pos, identifier FROM known WHERE flow_id IS NULL")
def unresolved(i):
    return lookup.unresolved(i("b_requests"), i("b_flows")).select("pos", "identifier")


@check("f4_search", """
SELECT 'name' AS terms, flow_id, flow_name, status, server FROM b_flows WHERE flow_name LIKE '%00_1%'
UNION ALL SELECT 'status', flow_id, flow_name, status, server FROM b_flows WHERE status = 'DONE'
UNION ALL SELECT 'all', flow_id, flow_name, status, server FROM b_flows
  WHERE flow_name LIKE '%7%' AND status = 'RUNNING' AND server = 'NATION_3'
UNION ALL SELECT 'none', flow_id, flow_name, status, server FROM b_flows""")
def search(i):
    flows = i("b_flows").select("flow_id", "flow_name", "status", "server")
    found = {
        "name": lookup.search(flows, "00_1"),
        "status": lookup.search(flows, status="DONE"),
        "all": lookup.search(flows, "7", "RUNNING", "NATION_3"),
        "none": lookup.search(flows, "", None, ""),
    }
    return reduce(DataFrame.unionByName,
                  [df.select(F.lit(t).alias("terms"), "*") for t, df in found.items()])


@check("f5_in_list", """
SELECT flow_id, server FROM b_flows WHERE server IN ('NATION_1', 'NATION_7', 'NATION_20')""")
def in_list(i):
    return lookup.among(i("b_flows").select("flow_id", "server"), "server",
                        ["NATION_1", "NATION_7", "NATION_20"])


@check("f5_in_table", """
SELECT flow_id, status FROM b_flows WHERE flow_name IN (SELECT identifier FROM b_requests)""")
def in_table(i):
    names = i("b_requests").select(F.col("identifier").alias("flow_name"))
    return lookup.among(i("b_flows"), "flow_name", names).select("flow_id", "status")


@check("f6_free_text", f"""WITH {SNAPSHOT}
SELECT flow_id, status, current_summary FROM snap
WHERE lower(concat_ws(' ', flow_name, coalesce(server,'N/A'), coalesce(owner,'N/A'), status,
  coalesce(nullif(current_summary,''), nullif(current_step,''), 'Waiting to start'),
  CAST(coalesce(current_iteration, 0) AS VARCHAR), coalesce(step_status,'-'))) LIKE '%supplier 1%'""")
def free_text(i):
    return lookup.free_text(snapshot(i), "Supplier 1").select(
        "flow_id", "status", "current_summary")


@check("f7_startable", """
SELECT flow_id, status, status IN ('NOT_STARTED','NEEDS_HUMAN','NEEDS_ATTENTION','FAILED','STOPPED') AS can_start,
  CASE WHEN status IN ('NOT_STARTED','NEEDS_HUMAN','NEEDS_ATTENTION','FAILED','STOPPED') THEN 'Start'
       WHEN status = 'RUNNING' THEN 'Stop' ELSE 'View' END AS action FROM b_flows""")
def startable(i):
    return lookup.startable(i("b_flows"))


@check("f8_artifacts_of_latest_iteration", f"""WITH {LAST}
SELECT p.run_id, p.iteration_num, p.artifact_ref FROM b_patches p
JOIN last l ON l.run_id = p.run_id AND l.iteration_num = p.iteration_num""")
def artifacts_of_latest(i):
    wanted = latest.latest_events(i("b_iterations"))
    return lookup.artifacts_of_iteration(i("b_patches"), wanted).select(
        "run_id", "iteration_num", "artifact_ref")


@check("f9_conformed_flows", """
SELECT flow_id, flow_name, 'NOT_STARTED' AS status, current_run_id, server, source_path,
  CAST(NULL AS VARCHAR) AS description, priority, CAST(NULL AS VARCHAR) AS owner FROM b_flows""")
def conformed(i):
    partial = i("b_flows").drop("status", "description", "owner", "updated_ts")
    return conform(partial, FLOWS, {"status": "NOT_STARTED"}).drop("updated_ts")


@check("f9_conformed_legacy", """
SELECT flow_name, server, status, 0 AS total_attempts, 0 AS iterations, 0 AS n_artifacts,
  CAST(NULL AS VARCHAR) AS error_message FROM b_legacy_flows""")
def conformed_legacy(i):
    full = conform(i("b_legacy_flows"), LEGACY_FLOWS, LEGACY_DEFAULTS)
    return full.select("flow_name", "server", "status", "total_attempts", "iterations",
                       F.size("generated_artifacts").alias("n_artifacts"), "error_message")


@check("f10_record_json", """
SELECT run_id, '{"run_id":"' || run_id || '","flow_id":"' || flow_id || '","job_run_id":' ||
  coalesce('"' || job_run_id || '"', 'null') || ',"start_ts":"' || strftime(start_ts, '%Y-%m-%dT%H:%M:%S')
  || '","end_ts":' || coalesce('"' || strftime(end_ts, '%Y-%m-%dT%H:%M:%S') || '"', 'null')
  || ',"status":"' || status || '"}' AS record FROM b_runs""")
def as_json(i):
    runs = i("b_runs")
    return runs.select("run_id", record_json(runs).alias("record"))


# ------------------------------------------------------------------- joins
@check("j1_status_snapshot", f"WITH {SNAPSHOT} SELECT * FROM snap")
def status_list(i):
    return snapshot(i)


@check("j2_current_attempts", """
SELECT f.flow_name, a.run_id AS attempt_id, a.job_run_id AS job_id, a.status
FROM b_flows f JOIN b_runs a ON a.run_id = f.current_run_id""")
def current_attempts(i):
    return joins.current_attempts(i("b_legacy_flows"), i("b_attempts")).select(
        "flow_name", "attempt_id", "job_id", "status")


@check("j3_current_artifacts", """
SELECT f.flow_id, p.run_id, p.iteration_num, p.artifact_ref
FROM b_flows f JOIN b_patches p ON p.run_id = f.current_run_id""")
def current_artifacts(i):
    return joins.current_artifacts(i("b_flows"), i("b_patches"))


@check("j4_orphans", """
SELECT 'events' AS child, count(*) AS orphan_count FROM b_iterations
WHERE run_id NOT IN (SELECT run_id FROM b_runs WHERE status NOT IN ('CREATING','QUEUED','RUNNING'))
UNION ALL
SELECT 'runs', count(*) FROM b_runs
WHERE flow_id NOT IN (SELECT flow_id FROM b_flows WHERE status <> 'DONE')""")
def orphan_counts(i):
    finished = i("b_runs").filter(~F.col("status").isin("CREATING", "QUEUED", "RUNNING"))
    open_flows = i("b_flows").filter("status <> 'DONE'")
    events = joins.count_orphans(i("b_iterations"), finished, "run_id", "run_id")
    runs = joins.count_orphans(i("b_runs"), open_flows, "flow_id", "flow_id")
    return events.select(F.lit("events").alias("child"), "orphan_count").unionByName(
        runs.select(F.lit("runs").alias("child"), "orphan_count"))


HISTORY = """
named AS (SELECT flow_name, min(flow_id) AS flow_id FROM b_flows GROUP BY flow_name),
hist AS (SELECT a.attempt_id, a.flow_name, n.flow_id, a.status
  FROM b_legacy_attempts a LEFT JOIN named n ON n.flow_name = a.flow_name)"""


def history(i):
    return joins.by_flow_name(i("b_legacy_attempts"), lookup.first_per_name(i("b_flows"))).select(
        "attempt_id", "flow_name", "flow_id", "status")


@check("j5_history_by_name", f"WITH {HISTORY} SELECT * FROM hist WHERE flow_id IS NOT NULL")
def history_matched(i):
    return history(i).filter("flow_id IS NOT NULL")


@check("j5_history_left_out",
       f"WITH {HISTORY} SELECT attempt_id, flow_name FROM hist WHERE flow_id IS NULL")
def history_left_out(i):
    return history(i).filter("flow_id IS NULL").select("attempt_id", "flow_name")


@check("j6_events_with_run", """
SELECT i.run_id, i.iteration_num, i.step, i.event_seq, r.flow_id, r.status AS run_status
FROM b_iterations i JOIN b_runs r ON r.run_id = i.run_id""")
def events_with_run(i):
    return latest.details_with_run(i("b_iterations"), i("b_runs")).select(
        "run_id", "iteration_num", "step", "event_seq", "flow_id", "run_status")


def kept_by_run(i, *names):
    """Tables of the ledger bucketed by run id, in the shared folder."""
    tables, own = i.ledger(), uuid.uuid4().hex
    return [keep_by_key(tables[n], f"{n}_{own}", new_dir(i.spark, n), buckets=16) for n in names]


@check("j6_events_with_run_in_buckets", """
SELECT i.run_id, i.iteration_num, i.step, i.event_seq, r.flow_id, r.status AS run_status
FROM b_iterations i JOIN b_runs r ON r.run_id = i.run_id""")
def events_with_run_in_buckets(i):
    """The same between tables that are bucketed by run: no shuffle."""
    events, runs = kept_by_run(i, "events", "runs")
    return latest.details_with_run(events, runs).select(
        "run_id", "iteration_num", "step", "event_seq", "flow_id", "run_status")


@check("j3_current_artifacts_in_buckets", """
SELECT f.flow_id, p.run_id, p.iteration_num, p.artifact_ref
FROM b_flows f JOIN b_patches p ON p.run_id = f.current_run_id""")
def current_artifacts_in_buckets(i):
    """Only the pointers of the flows are shuffled."""
    return joins.current_artifacts(i("b_flows"), *kept_by_run(i, "artifacts"))


@check("w1_latest_in_buckets", """
SELECT run_id, iteration_num, step, event_seq FROM (SELECT *, row_number() OVER (
  PARTITION BY run_id ORDER BY iteration_num DESC, ts DESC, event_seq DESC) AS rn FROM b_iterations) q WHERE rn = 1""")
def latest_in_buckets(i):
    """Events of a run are ranked where they lie."""
    return latest.latest_events(*kept_by_run(i, "events")).select("run_id", "iteration_num", "step", "event_seq")


@check("j6_all_details_with_run", """
SELECT r.flow_id, d.detail, count(*) AS rows FROM (
  SELECT run_id, 'events' AS detail FROM b_iterations UNION ALL
  SELECT run_id, 'artifacts' FROM b_patches UNION ALL SELECT run_id, 'scans' FROM b_scans UNION ALL
  SELECT run_id, 'executions' FROM b_exec UNION ALL SELECT run_id, 'requests' FROM b_human) d
JOIN b_runs r ON r.run_id = d.run_id GROUP BY r.flow_id, d.detail""")
def all_details(i):
    tables = i.ledger()
    parts = [tables[t].groupBy("run_id").agg(F.count("*").alias("n"))
             .select("run_id", "n", F.lit(t).alias("detail")) for t in latest.DETAIL_ORDER]
    every = reduce(DataFrame.unionByName, parts)
    return latest.details_with_run(every, tables["runs"]).groupBy("flow_id", "detail").agg(
        F.sum("n").alias("rows"))


# ------------------------------------------------------------------ totals
@check("a1_row_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS rows FROM {v}" for t, v in [
        ("flows", "b_flows"), ("runs", "b_runs"), ("events", "b_iterations"),
        ("artifacts", "b_patches"), ("scans", "b_scans"), ("executions", "b_exec"),
        ("requests", "b_human")]))
def row_counts(i):
    return totals.row_counts(i.ledger())


@check("a1_old_against_new", """
SELECT 'flows' AS table_name, (SELECT count(*) FROM b_legacy_flows) AS old_rows,
  (SELECT count(*) FROM b_flows) AS new_rows
UNION ALL SELECT 'runs', (SELECT count(*) FROM b_legacy_attempts), (SELECT count(*) FROM b_runs)""")
def old_against_new(i):
    return totals.old_against_new({
        "flows": (i("b_legacy_flows"), i("b_flows")),
        "runs": (i("b_legacy_attempts"), i("b_runs"))})


@check("a2_flow_status", "SELECT status, count(*) AS count FROM b_flows GROUP BY status")
def flow_status(i):
    return totals.status_distribution(i("b_flows"))


@check("a2_run_status", "SELECT status, count(*) AS count FROM b_runs GROUP BY status")
def run_status(i):
    return totals.status_distribution(i("b_runs"))


@check("a3_dashboard_totals", """
SELECT count(*) AS total, count(*) FILTER (status = 'NOT_STARTED') AS not_started,
  count(*) FILTER (status = 'RUNNING') AS converting, count(*) FILTER (status = 'DONE') AS done,
  count(*) FILTER (status IN ('NEEDS_HUMAN','NEEDS_ATTENTION')) AS needs_attention FROM b_flows""")
def dashboard(i):
    return totals.dashboard_totals(i("b_flows"))


INTENT = """
CASE split_part(type, '.', -1) WHEN 'GetFile' THEN 'ingestion' WHEN 'ReplaceText' THEN 'transformation'
  WHEN 'RouteOnAttribute' THEN 'routing' WHEN 'PutFile' THEN 'output'
  WHEN 'LogMessage' THEN 'monitoring' ELSE 'other' END"""


@check("a4_intent_counts", f"""
SELECT flow_id, {INTENT} AS intent, count(*) AS processors FROM b_processors GROUP BY ALL""")
def intent_counts(i):
    return totals.intent_counts(i("b_processors"))


@check("a5_intents_of_flow", f"SELECT DISTINCT flow_id, {INTENT} AS intent FROM b_processors")
def intents(i):
    return totals.intents_of_flow(i("b_processors"))


@check("a7_any_running", "SELECT bool_or(status = 'RUNNING') AS any_running FROM b_flows")
def any_running(i):
    return totals.any_running(i("b_flows"))


@check("a8_next_attempt", """
SELECT f.flow_id, count(r.run_id) + 1 AS attempt_number
FROM b_flows f LEFT JOIN b_runs r ON r.flow_id = f.flow_id GROUP BY f.flow_id""")
def next_attempt(i):
    return totals.next_attempt_numbers(i("b_flows"), i("b_runs"))


@check("a10_attempt_totals", """
SELECT flow_id, count(*) AS total_attempts, count(*) FILTER (status = 'SUCCESS') AS successful_conversions,
  min(start_ts) AS first_attempt_at, max(start_ts) AS last_attempt_at FROM b_runs GROUP BY flow_id""")
def attempt_totals(i):
    return totals.attempt_totals(i("b_runs"))


# ---------------------------------------------------------------- rankings
LAST_COLUMNS = "run_id, iteration_num, step, step_status, ts, summary, error, event_seq"


@check("w1_latest_event", f"WITH {LAST} SELECT {LAST_COLUMNS} FROM last")
def latest_event(i):
    return latest.latest_events(i("b_iterations"))


@check("w1_latest_event_aggregated", f"WITH {LAST} SELECT {LAST_COLUMNS} FROM last")
def latest_event_aggregated(i):
    return latest.latest_events_aggregated(i("b_iterations"))


@check("w2_run_history", """
SELECT run_id, flow_id, start_ts, status, place FROM (SELECT *, CAST(row_number() OVER (
  PARTITION BY flow_id ORDER BY start_ts DESC, run_id DESC) AS INT) AS place FROM b_runs) q
WHERE place <= 20""")
def run_history(i):
    return latest.run_history(i("b_runs")).select(
        "run_id", "flow_id", "start_ts", "status", "place")


@check("w3_attempt_history", """
SELECT attempt_id, flow_name, status, place FROM (SELECT *, CAST(row_number() OVER (
  PARTITION BY flow_name ORDER BY started_at DESC, attempt_id DESC) AS INT) AS place FROM b_attempts) q
WHERE place <= 10""")
def attempt_history(i):
    return latest.attempt_history(i("b_attempts")).select(
        "attempt_id", "flow_name", "status", "place")


@check("w4_surplus_runs", """
SELECT run_id, flow_id, start_ts FROM (SELECT *, row_number() OVER (
  PARTITION BY flow_id ORDER BY start_ts DESC, run_id DESC) AS place FROM b_runs) q
WHERE place > 3""")
def surplus(i):
    return latest.surplus_runs(i("b_runs")).select("run_id", "flow_id", "start_ts")


@check("w5_execution_tasks", """
SELECT run_id, iteration_num, task_index, artifact_ref,
  'execute_' || name || '_' || CAST(task_index AS VARCHAR) AS task_key,
  '/vol/logs/' || run_id || '/iter' || CAST(iteration_num AS VARCHAR) || '/' || name || '.log' AS log_path
FROM (SELECT *, row_number() OVER (PARTITION BY run_id, iteration_num ORDER BY artifact_ref, ts) - 1 AS task_index,
  replace(split_part(artifact_ref, '/', -1), '.py', '') AS name FROM b_patches) q""")
def execution_tasks(i):
    return latest.execution_tasks(i("b_patches"), "/vol/logs")


@check("w5_deployment_tasks", """
SELECT flow_id, task_index, artifact_ref, split_part(artifact_ref, '/', -1) AS name,
  'task_' || CAST(task_index AS VARCHAR) || '_' || flow_id AS task_key,
  'nb_' || CAST(task_index AS VARCHAR) AS artifact_id
FROM (SELECT f.flow_id, p.artifact_ref, row_number() OVER (PARTITION BY f.flow_id
  ORDER BY p.iteration_num, p.artifact_ref) - 1 AS task_index
  FROM b_flows f JOIN b_patches p ON p.run_id = f.current_run_id) q""")
def deployment_tasks(i):
    listing = joins.current_artifacts(i("b_flows"), i("b_patches"))
    return latest.deployment_tasks(listing, ["iteration_num", "artifact_ref"])


@check("w6_next_iteration", """
SELECT r.run_id, coalesce(max(i.iteration_num), 0) + 1 AS next_iteration
FROM b_runs r LEFT JOIN b_iterations i ON i.run_id = r.run_id GROUP BY r.run_id""")
def next_iteration(i):
    return latest.next_iteration(i("b_runs"), i("b_iterations"))


@check("w7_last_written", """
SELECT artifact_ref, run_id, iteration_num, patch_summary, ts FROM (SELECT *, row_number() OVER (
  PARTITION BY artifact_ref ORDER BY ts DESC, run_id DESC, iteration_num DESC, patch_summary DESC) AS rn
  FROM b_patches) q WHERE rn = 1""")
def last_written(i):
    return latest.last_written(i("b_patches"), ["run_id", "iteration_num", "patch_summary"]).select(
        "artifact_ref", "run_id", "iteration_num", "patch_summary", "ts")


@check("w8_stale_pointers", """
SELECT f.flow_id, f.current_run_id, n.run_id AS newest_run_id FROM b_flows f
LEFT JOIN (SELECT flow_id, run_id, row_number() OVER (
  PARTITION BY flow_id ORDER BY start_ts DESC, run_id DESC) AS rn FROM b_runs) n
  ON n.flow_id = f.flow_id AND n.rn = 1
WHERE f.current_run_id IS DISTINCT FROM n.run_id""")
def stale_pointers(i):
    return latest.stale_pointers(i("b_flows"), i("b_runs"))


for _table, _view in [("events", "b_iterations"), ("artifacts", "b_patches"), ("scans", "b_scans"),
                      ("executions", "b_exec"), ("requests", "b_human")]:
    @check(f"w9_{_table}_in_order", f"SELECT * FROM {_view}")
    def details(i, table=_table, view=_view):
        return latest.run_details(i(view), table)


# ----------------------------------------------------------------- display
@check("c14_status_badges", """
SELECT status AS old_status, CASE status WHEN 'NOT_STARTED' THEN 'Not Started' WHEN 'CONVERTING' THEN 'Running'
  WHEN 'DONE' THEN 'Done' WHEN 'NEEDS_ATTENTION' THEN 'Needs Human' WHEN 'FAILED' THEN 'Failed'
  WHEN 'STOPPED' THEN 'Stopped' ELSE 'Unknown' END AS label,
  CASE status WHEN 'NOT_STARTED' THEN 'gray' WHEN 'CONVERTING' THEN 'blue' WHEN 'DONE' THEN 'green'
  WHEN 'NEEDS_ATTENTION' THEN 'red' WHEN 'FAILED' THEN 'red' WHEN 'STOPPED' THEN 'yellow' ELSE 'gray' END AS colour,
  flow_name FROM b_legacy_flows""")
def badges(i):
    return i("b_legacy_flows").withColumn("b", badge(F.col("status"))).select(
        F.col("status").alias("old_status"), "b.label", "b.colour", "flow_name")


@check("c15_progress_text", f"""WITH {SNAPSHOT}
SELECT flow_id, coalesce(nullif(current_summary,''), nullif(current_step,''), 'Waiting to start') AS progress,
  coalesce(current_iteration, 0) AS iteration FROM snap""")
def progress(i):
    return snapshot(i).select(
        "flow_id", progress_text(F.col("current_summary"), F.col("current_step")).alias("progress"),
        F.coalesce("current_iteration", F.lit(0)).alias("iteration"))


ADMITTED = f"""{KNOWN},
judged AS (SELECT k.pos, k.identifier, f.flow_id, f.current_run_id,
  CASE WHEN f.flow_id IS NULL THEN 'Flow not found' WHEN f.status = 'RUNNING' THEN 'Conversion already in progress'
       WHEN coalesce(f.source_path,'') = '' THEN 'XML path not configured for this flow' END AS refusal
  FROM known k LEFT JOIN b_flows f ON f.flow_id = k.flow_id),
admitted AS (SELECT *, refusal IS NULL AND row_number() OVER (PARTITION BY flow_id, refusal IS NULL ORDER BY pos) = 1
  AS accepted FROM judged)"""


@check("a6_start_summary", f"""WITH {ADMITTED}
SELECT count(*) FILTER (accepted) AS started, count(*) FILTER (NOT accepted) AS failed FROM admitted""")
def start_summary(i):
    return totals.start_summary(admit(i("b_requests"), i("b_flows")))
