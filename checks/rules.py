"""Writes, workflow rules, integrity and change rows."""

from pyspark.sql import functions as F

from checks.inputs import AS_OF
from checks.reads import ADMITTED, LAST
from checks.registry import check
from checks.texts import as_of
from ledgerline.operators import changes, quality, rules, totals, upkeep
from ledgerline.plans import ingest, limits, migrate, poll
from ledgerline.schemas import TABLES
from ledgerline.session import new_dir
from ledgerline.sources import buckets
from ledgerline.sources.store import Store

# ------------------------------------------------------------------ writes
APPENDED = "SELECT * FROM b_iterations"


def halves(table):
    """Old rows and new rows of a table, by date."""
    early = F.col("ts") < F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'")
    return table.filter(early), table.filter(~early)


@check("u1_appended_events", APPENDED)
def appended(i):
    old, new = halves(i("b_iterations"))
    return changes.append(old, new)


@check("u1_appended_versions", APPENDED)
def appended_versions(i):
    """Two commits to a stored table: the first rows, then the added ones."""
    store = Store(i.spark, new_dir(i.spark, "ledger"))
    old, new = halves(i("b_iterations"))
    store.commit(replace={"events": old})
    store.commit(append={"events": new})
    return store.read("events")


SOURCE = """
src AS (SELECT CAST(CAST(flow_id AS BIGINT) + (SELECT count(*) FROM b_flows) // 2 AS VARCHAR) AS flow_id,
  'new ' || flow_name AS flow_name, 'NOT_STARTED' AS status, server, source_path, description, priority, owner
  FROM b_flows)"""


def moved_flows(i):
    """Source rows of which half are known flows and half are new."""
    flows = i("b_flows")
    total = flows.count()
    return flows.select(
        (F.col("flow_id").cast("long") + total // 2).cast("string").alias("flow_id"),
        F.concat(F.lit("new "), F.col("flow_name")).alias("flow_name"),
        F.lit("NOT_STARTED").alias("status"), "server", "source_path", "description",
        "priority", "owner")


@check("u2_upsert_ingest", f"""WITH {SOURCE}
SELECT coalesce(t.flow_id, s.flow_id) AS flow_id, coalesce(s.flow_name, t.flow_name) AS flow_name,
  coalesce(s.status, t.status) AS status, t.current_run_id,
  CASE WHEN s.flow_id IS NOT NULL THEN {AS_OF} ELSE t.updated_ts END AS updated_ts,
  CASE WHEN s.flow_id IS NOT NULL THEN s.server ELSE t.server END AS server,
  CASE WHEN s.flow_id IS NOT NULL THEN s.source_path ELSE t.source_path END AS source_path,
  CASE WHEN s.flow_id IS NOT NULL THEN s.description ELSE t.description END AS description,
  CASE WHEN s.flow_id IS NOT NULL THEN s.priority ELSE t.priority END AS priority,
  CASE WHEN s.flow_id IS NOT NULL THEN s.owner ELSE t.owner END AS owner
FROM b_flows t FULL OUTER JOIN src s ON s.flow_id = t.flow_id""")
def upsert_ingest(i):
    return changes.upsert(i("b_flows"), moved_flows(i), ["flow_id"], ingest.INGEST_UPDATE,
                          ingest.INGEST_UPDATE, {"updated_ts": as_of()})


@check("u2_upsert_migration", f"""WITH {SOURCE}
SELECT coalesce(t.flow_id, s.flow_id) AS flow_id, coalesce(s.flow_name, t.flow_name) AS flow_name,
  CASE WHEN t.flow_id IS NULL THEN 'run of ' || s.flow_id ELSE t.current_run_id END AS current_run_id
FROM b_flows t FULL OUTER JOIN src s ON s.flow_id = t.flow_id""")
def upsert_migration(i):
    """The other column lists: a new row brings its run, a known row keeps its own."""
    source = moved_flows(i).withColumn(
        "current_run_id", F.concat(F.lit("run of "), F.col("flow_id")))
    return changes.upsert(i("b_flows"), source, ["flow_id"], migrate.MIGRATION_UPDATE,
                          migrate.MIGRATION_INSERT, {"updated_ts": as_of()}).select(
        "flow_id", "flow_name", "current_run_id")


@check("u2_ingested_definitions", f"""
SELECT flow_id, replace(split_part(path, '/', -1), '.xml', '') AS flow_name, 'NOT_STARTED' AS status,
  CAST(NULL AS VARCHAR) AS current_run_id, {AS_OF} AS updated_ts, path AS source_path
FROM b_paths WHERE form <> 'broken'
UNION ALL SELECT flow_id, flow_name, status, current_run_id, updated_ts, source_path FROM b_flows""")
def ingested(i):
    found = ingest.catalogue(i.definitions(), "defs")
    return ingest.ingest(i("b_flows"), found, as_of()).select(
        "flow_id", "flow_name", "status", "current_run_id", "updated_ts", "source_path")


@check("u3_keyed_update", f"""
SELECT r.run_id, r.flow_id, r.job_run_id, r.start_ts, CASE WHEN s.result_state IS NOT NULL THEN {AS_OF} ELSE r.end_ts END AS end_ts,
  CASE WHEN s.run_id IS NOT NULL THEN s.life_cycle_state ELSE r.status END AS status
FROM b_runs r LEFT JOIN b_job_state s ON s.run_id = r.run_id""")
def keyed_update(i):
    """Run status from the job state; the end time only where one is given."""
    updates = i("b_job_state").select(
        "run_id", F.col("life_cycle_state").alias("status"),
        F.when(F.col("result_state").isNotNull(), as_of()).alias("end_ts"))
    return changes.keyed_update(i("b_runs"), updates, "run_id", when_given=["end_ts"])


@check("u3_update_with_null", f"""
SELECT f.flow_id, CASE WHEN f.status = 'RUNNING' THEN NULL ELSE f.current_run_id END AS current_run_id,
  CASE WHEN f.status = 'RUNNING' THEN {AS_OF} ELSE f.updated_ts END AS updated_ts FROM b_flows f""")
def update_with_null(i):
    updates = i("b_flows").filter("status = 'RUNNING'").select(
        "flow_id", F.lit(None).cast("string").alias("current_run_id"))
    return changes.keyed_update(i("b_flows"), updates, "flow_id", {"updated_ts": as_of()}).select(
        "flow_id", "current_run_id", "updated_ts")


BULK = f"""
bulk AS (SELECT flow_id, flow_name, CASE WHEN hit THEN 'STOPPED' ELSE status END AS status,
  CASE WHEN hit THEN {AS_OF} ELSE updated_ts END AS updated_ts, status AS old_status, updated_ts AS old_ts
  FROM (SELECT *, flow_name IN (SELECT identifier FROM b_requests) AS hit FROM b_flows) q)"""


def bulk(i):
    chosen = i("b_requests").select(F.col("identifier").alias("flow_name"))
    return changes.bulk_set(i("b_flows"), chosen, "flow_name",
                            {"status": F.lit("STOPPED"), "updated_ts": as_of()})


@check("u4_bulk_status", f"WITH {BULK} SELECT flow_id, flow_name, status, updated_ts FROM bulk")
def bulk_status(i):
    return bulk(i).select("flow_id", "flow_name", "status", "updated_ts")


@check("cdc1_changes", f"""WITH {BULK},
moved AS (SELECT * FROM bulk WHERE status <> old_status OR updated_ts IS DISTINCT FROM old_ts)
SELECT 'update_preimage' AS change_type, flow_id, old_status AS status, old_ts AS updated_ts
FROM moved WHERE old_status <> 'DONE'
UNION ALL SELECT 'update_postimage', flow_id, status, updated_ts FROM moved WHERE old_status <> 'DONE'
UNION ALL SELECT 'insert', flow_id, status, updated_ts FROM bulk WHERE old_status = 'DONE'
UNION ALL SELECT 'delete', 'gone-' || flow_id, old_status, old_ts FROM bulk WHERE old_status = 'NOT_STARTED'""")
def change_rows(i):
    """Changes of a bulk update, with flows that come and flows that go."""
    columns = ["flow_id", "status", "updated_ts"]
    flows = i("b_flows").select(*columns)
    gone = flows.filter("status = 'NOT_STARTED'").withColumn(
        "flow_id", F.concat(F.lit("gone-"), F.col("flow_id")))
    old = flows.filter("status <> 'DONE'").unionByName(gone)
    return changes.changes_between(old, bulk(i).select(*columns), ["flow_id"])


@check("cdc1_applied", f"WITH {BULK} SELECT flow_id, status, updated_ts FROM bulk")
def changes_applied(i):
    columns = ["flow_id", "status", "updated_ts"]
    old, new = i("b_flows").select(*columns), bulk(i).select(*columns)
    found = changes.changes_between(old, new, ["flow_id"])
    return changes.apply_changes(old, found, ["flow_id"])


def bulk_versions(i):
    columns = ["flow_id", "status", "updated_ts"]
    flows = i("b_flows").select(*columns)
    gone = flows.filter("status = 'NOT_STARTED'").withColumn("flow_id", F.concat(F.lit("gone-"), F.col("flow_id")))
    return flows.filter("status <> 'DONE'").unionByName(gone), bulk(i).select(*columns)


CHANGED = f"""WITH {BULK},
moved AS (SELECT * FROM bulk WHERE status <> old_status OR updated_ts IS DISTINCT FROM old_ts)
SELECT 'update_preimage' AS change_type, flow_id, old_status AS status, old_ts AS updated_ts
FROM moved WHERE old_status <> 'DONE'
UNION ALL SELECT 'update_postimage', flow_id, status, updated_ts FROM moved WHERE old_status <> 'DONE'
UNION ALL SELECT 'insert', flow_id, status, updated_ts FROM bulk WHERE old_status = 'DONE'
UNION ALL SELECT 'delete', 'gone-' || flow_id, old_status, old_ts FROM bulk WHERE old_status = 'NOT_STARTED'"""


@check("cdc1_changes_by_digest", CHANGED)
def change_rows_by_digest(i):
    """The same changes, joining only the buckets whose digests differ."""
    return changes.changes_by_digest(*bulk_versions(i), ["flow_id"])


@check("cdc1_changes_of_versions", CHANGED)
def change_rows_of_versions(i):
    """The same between two versions in a store, reading only the buckets that were written anew."""
    old, new = bulk_versions(i)
    store = Store(i.spark, new_dir(i.spark, "versions"))
    first = store.commit(parts={"flows": buckets.whole(old, ["flow_id"], 32)})
    news = store.materialize(changes.changes_between(old, new, ["flow_id"]))
    store.commit(parts={"flows": buckets.changed(
        store, "flows", news, ["flow_id"], lambda rows: changes.apply_changes(rows, news, ["flow_id"]))})
    return buckets.changes_of(store, "flows", ["flow_id"], first)


# three versions of the runs: up to 1996, then all with some of them ended, then without every seventh
def run_versions(i):
    columns = ["run_id", "flow_id", "status", "start_ts"]
    every = i("b_runs").select(*columns)
    ended = every.withColumn("status", F.when(F.col("status") == "RUNNING", "SUCCESS").otherwise(F.col("status")))
    return [every.filter("start_ts < TIMESTAMP_NTZ '1996-01-01 00:00:00'"), ended,
            ended.filter("CAST(run_id AS BIGINT) % 7 <> 0")]


RUNS_AFTER = """
after AS (SELECT run_id, flow_id, start_ts, CASE status WHEN 'RUNNING' THEN 'SUCCESS' ELSE status END AS status
  FROM b_runs WHERE CAST(run_id AS BIGINT) % 7 <> 0)"""


@check("a2_status_kept_from_changes", f"WITH {RUNS_AFTER} SELECT status, count(*) AS count FROM after GROUP BY status")
def status_kept(i):
    """Runs per status after three versions, from the first count and two sets of change rows."""
    versions = run_versions(i)
    counts = totals.status_distribution(versions[0])
    for old, new in zip(versions, versions[1:]):
        counts = upkeep.status_counts_after(counts, changes.changes_between(old, new, ["run_id"]))
    return counts


@check("a3_dashboard_kept_from_changes", f"""WITH {BULK}
SELECT count(*) AS total, count(*) FILTER (status = 'NOT_STARTED') AS not_started,
  count(*) FILTER (status = 'RUNNING') AS converting, count(*) FILTER (status = 'DONE') AS done,
  count(*) FILTER (status IN ('NEEDS_HUMAN','NEEDS_ATTENTION')) AS needs_attention FROM bulk""")
def dashboard_kept(i):
    old, new = bulk_versions(i)
    counts = upkeep.status_counts_after(
        totals.status_distribution(old), changes.changes_between(old, new, ["flow_id"]))
    return upkeep.dashboard_of_counts(counts)


@check("a10_attempts_kept_from_changes", f"""WITH {RUNS_AFTER}
SELECT flow_id, count(*) AS total_attempts, count(*) FILTER (status = 'SUCCESS') AS successful_conversions,
  min(start_ts) AS first_attempt_at, max(start_ts) AS last_attempt_at FROM after GROUP BY flow_id""")
def attempts_kept(i):
    versions = run_versions(i)
    kept = totals.attempt_totals(versions[0])
    for old, new in zip(versions, versions[1:]):
        kept = upkeep.attempt_totals_after(kept, changes.changes_between(old, new, ["run_id"]), new)
    return kept


# --------------------------------------------------------------- migration
MIGRATED = """
moved AS (SELECT md5(coalesce(replace(split_part(source_path, '/', -1), '.xml', ''), flow_name)) AS flow_id, flow_name,
  CASE status WHEN 'CONVERTING' THEN 'RUNNING' WHEN 'NEEDS_ATTENTION' THEN 'NEEDS_HUMAN' ELSE status END AS status,
  server, source_path FROM b_legacy_flows),
moved_runs AS (SELECT a.attempt_id AS run_id, m.flow_id, a.job_id AS job_run_id, a.started_at AS start_ts,
  a.completed_at AS end_ts, CASE WHEN a.status IN ('CREATING','RUNNING','SUCCESS','FAILED','CANCELLED') THEN a.status
  ELSE 'FAILED' END AS status, a.flow_name FROM b_legacy_attempts a LEFT JOIN moved m ON m.flow_name = a.flow_name)"""


def migration(i):
    """Into a ledger that is still empty."""
    empty = [i(view).filter("false") for view in ("b_flows", "b_runs", "b_iterations")]
    return migrate.migrate(*empty, i("b_legacy_flows"), i("b_legacy_attempts"), as_of())


@check("u7_migrated_flows", f"""WITH {MIGRATED}
SELECT flow_id, flow_name, status, server, source_path, {AS_OF} AS updated_ts FROM moved""")
def migrated_flows(i):
    return migration(i)["flows"].select(
        "flow_id", "flow_name", "status", "server", "source_path", "updated_ts")


@check("u7_migrated_runs", f"""WITH {MIGRATED}
SELECT run_id, flow_id, job_run_id, start_ts, end_ts, status FROM moved_runs WHERE flow_id IS NOT NULL""")
def migrated_runs(i):
    return migration(i)["runs"]


@check("u7_migrated_events", f"""WITH {MIGRATED}
SELECT run_id, 1 AS iteration_num, 'migration_placeholder' AS step,
  CASE WHEN status IN ('FAILED','RUNNING') THEN status ELSE 'COMPLETED' END AS step_status, {AS_OF} AS ts,
  'Conversion ' || CASE status WHEN 'SUCCESS' THEN 'completed' WHEN 'FAILED' THEN 'failed'
    WHEN 'RUNNING' THEN 'in progress' ELSE lower(status) END || ' (migrated from old schema)' AS summary
FROM moved_runs WHERE flow_id IS NOT NULL""")
def migrated_events(i):
    return migration(i)["events"].select(
        "run_id", "iteration_num", "step", "step_status", "ts", "summary")


def merged(i):
    """Into a ledger that has half of the flows and all runs, with the ids that the files state."""
    catalogued = i("b_legacy_flows").filter("source_path IS NOT NULL").select(
        F.col("source_path").alias("path"), F.col("old_id").alias("flow_id"))
    flows = i("b_flows").filter("CAST(flow_id AS BIGINT) % 2 = 0")
    history = i("b_legacy_attempts").withColumn("attempt_id", F.concat(F.lit("old-"), F.col("attempt_id")))
    return migrate.migrate(flows, i("b_runs"), i("b_iterations"), i("b_legacy_flows"), history, as_of(), catalogued)


MERGED = """
ids AS (SELECT *, CASE WHEN source_path IS NOT NULL THEN old_id ELSE md5(flow_name) END AS new_id,
  CASE status WHEN 'CONVERTING' THEN 'RUNNING' WHEN 'NEEDS_ATTENTION' THEN 'NEEDS_HUMAN' ELSE status END AS new_status FROM b_legacy_flows),
held AS (SELECT * FROM b_flows WHERE CAST(flow_id AS BIGINT) % 2 = 0)"""


@check("u7_merged_flows", f"""WITH {MERGED}
SELECT coalesce(i.new_id, h.flow_id) AS flow_id, coalesce(i.flow_name, h.flow_name) AS flow_name, coalesce(i.new_status, h.status) AS status,
  h.current_run_id, CASE WHEN i.new_id IS NOT NULL THEN {AS_OF} ELSE h.updated_ts END AS updated_ts
FROM held h FULL OUTER JOIN ids i ON i.new_id = h.flow_id""")
def merged_flows(i):
    return merged(i)["flows"].select("flow_id", "flow_name", "status", "current_run_id", "updated_ts")


@check("u7_merged_runs", f"""WITH {MERGED}
SELECT run_id, flow_id, job_run_id, status FROM b_runs
UNION ALL SELECT 'old-' || a.attempt_id, i.new_id, a.job_id, CASE WHEN a.status IN ('CREATING','RUNNING','SUCCESS','FAILED','CANCELLED') THEN a.status
  ELSE 'FAILED' END FROM b_legacy_attempts a JOIN ids i ON i.flow_name = a.flow_name""")
def merged_runs(i):
    return merged(i)["runs"].select("run_id", "flow_id", "job_run_id", "status")


@check("u7_merged_events", f"""WITH {MERGED}
SELECT run_id, iteration_num, step FROM b_iterations
UNION ALL SELECT 'old-' || a.attempt_id, 1, 'migration_placeholder' FROM b_legacy_attempts a JOIN ids i ON i.flow_name = a.flow_name""")
def merged_events(i):
    return merged(i)["events"].select("run_id", "iteration_num", "step")


@check("u7_left_out", f"""WITH {MIGRATED}
SELECT run_id AS attempt_id, flow_name FROM moved_runs WHERE flow_id IS NULL""")
def migration_left_out(i):
    return migration(i)["left_out"]


# --------------------------------------------------------------- admission
@check("d1_admission", f"""WITH {ADMITTED}
SELECT pos, identifier, flow_id, accepted, CASE WHEN refusal IS NULL AND NOT accepted
  THEN 'Conversion already in progress' ELSE refusal END AS error,
  CASE WHEN refusal = 'Conversion already in progress' THEN current_run_id END AS current_run_id FROM admitted""")
def admission(i):
    return rules.admit(i("b_requests"), i("b_flows")).select(
        "pos", "identifier", "flow_id", "accepted", "error", "current_run_id")


STARTED = f"""{ADMITTED},
starts AS (SELECT a.flow_id, a.flow_id || '_run_' || CAST(CAST(epoch({AS_OF}) AS BIGINT) AS VARCHAR) AS run_id,
  CASE WHEN CAST(a.flow_id AS BIGINT) % 4 <> 0 THEN 'job-' || a.flow_id END AS job_run_id FROM admitted a WHERE accepted)"""


def starts(i):
    """Accepted starts; every fourth flow has no job, as if starting it had failed."""
    admitted = rules.admit(i("b_requests"), i("b_flows"))
    launches = i("b_flows").select(
        "flow_id", F.when(F.col("flow_id").cast("long") % 4 != 0,
                          F.concat(F.lit("job-"), F.col("flow_id"))).alias("job_run_id"),
        F.when(F.col("flow_id").cast("long") % 4 == 0, "no cluster").alias("error"))
    return rules.start_rows(admitted, as_of(), launches)


@check("d2_started_runs", f"""WITH {STARTED}
SELECT run_id, flow_id, job_run_id, {AS_OF} AS start_ts, CAST(NULL AS TIMESTAMP) AS end_ts,
  CASE WHEN job_run_id IS NULL THEN 'FAILED' ELSE 'QUEUED' END AS status FROM starts""")
def started_runs(i):
    return starts(i)["runs"]


@check("d2_started_events", f"""WITH {STARTED}
SELECT run_id, 1 AS iteration_num, CASE WHEN job_run_id IS NULL THEN 'job_creation' ELSE 'agent_generate' END AS step,
  CASE WHEN job_run_id IS NULL THEN 'FAILED' ELSE 'RUNNING' END AS step_status, {AS_OF} AS ts,
  CASE WHEN job_run_id IS NOT NULL THEN 'Agent generating notebooks (iteration 1)...' END AS summary,
  CASE WHEN job_run_id IS NULL THEN 'no cluster' END AS error, CAST(1 AS BIGINT) AS event_seq FROM starts""")
def started_events(i):
    return starts(i)["events"]


@check("d2_started_flows", f"""WITH {STARTED}
SELECT f.flow_id, CASE WHEN s.flow_id IS NULL THEN f.status WHEN s.job_run_id IS NULL THEN 'NEEDS_HUMAN' ELSE 'RUNNING' END AS status,
  coalesce(s.run_id, f.current_run_id) AS current_run_id,
  CASE WHEN s.flow_id IS NULL THEN f.updated_ts ELSE {AS_OF} END AS updated_ts
FROM b_flows f LEFT JOIN starts s ON s.flow_id = f.flow_id""")
def started_flows(i):
    return poll.update_flows(i("b_flows"), starts(i)["flows"], as_of()).select(
        "flow_id", "status", "current_run_id", "updated_ts")


@check("u5_new_attempts", f"""WITH {ADMITTED},
done AS (SELECT flow_id, count(*) AS n, min(start_ts) AS first_ts FROM b_runs GROUP BY flow_id)
SELECT f.flow_name || '_attempt_' || CAST(CAST(epoch({AS_OF}) AS BIGINT) AS VARCHAR) AS attempt_id, f.flow_name,
  'CREATING' AS status, {AS_OF} AS started_at, coalesce(d.n, 0) + 1 AS attempt_number, 'user' AS triggered_by,
  coalesce(d.first_ts, {AS_OF}) AS first_attempt_at
FROM admitted a JOIN b_flows f ON f.flow_id = a.flow_id LEFT JOIN done d ON d.flow_id = f.flow_id WHERE a.accepted""")
def new_attempts(i):
    accepted = rules.admit(i("b_requests"), i("b_flows")).filter("accepted")
    return rules.new_attempts(accepted, i("b_runs"), as_of()).select(
        "attempt_id", "flow_name", "status", "started_at", "attempt_number", "triggered_by",
        "first_attempt_at")


@check("u5_flows", f"""WITH {ADMITTED},
done AS (SELECT flow_id, count(*) AS n, min(start_ts) AS first_ts FROM b_runs GROUP BY flow_id),
old AS (SELECT f.flow_id, f.flow_name, f.status, f.current_run_id, d.n, CASE WHEN CAST(f.flow_id AS BIGINT) % 2 = 0 THEN d.first_ts END AS first_ts
  FROM b_flows f LEFT JOIN done d ON d.flow_id = f.flow_id)
SELECT o.flow_name, CASE WHEN a.flow_id IS NOT NULL THEN 'CONVERTING' ELSE o.status END AS status,
  CASE WHEN a.flow_id IS NOT NULL THEN o.flow_name || '_attempt_' || CAST(CAST(epoch({AS_OF}) AS BIGINT) AS VARCHAR) ELSE o.current_run_id END AS current_attempt_id,
  CASE WHEN a.flow_id IS NOT NULL THEN coalesce(o.n, 0) + 1 ELSE coalesce(o.n, 0) END AS total_attempts,
  CASE WHEN a.flow_id IS NOT NULL THEN coalesce(o.first_ts, {AS_OF}) ELSE o.first_ts END AS first_attempt_at,
  CASE WHEN a.flow_id IS NOT NULL THEN {AS_OF} END AS last_attempt_at,
  CASE WHEN a.flow_id IS NOT NULL THEN {AS_OF} END AS last_updated
FROM old o LEFT JOIN admitted a ON a.flow_id = o.flow_id AND a.accepted""")
def attempted_flows(i):
    """Old-style flows, half of them with a first attempt, after the accepted starts."""
    so_far = i("b_runs").groupBy("flow_id").agg(F.count("*").alias("n"), F.min("start_ts").alias("first"))
    none = F.lit(None).cast("timestamp_ntz")
    flows = i("b_flows").join(so_far, "flow_id", "left").select(
        "flow_name", "status", F.col("current_run_id").alias("current_attempt_id"),
        F.coalesce("n", F.lit(0)).alias("total_attempts"),
        F.when(F.col("flow_id").cast("long") % 2 == 0, F.col("first")).alias("first_attempt_at"),
        none.alias("last_attempt_at"), none.alias("last_updated"))
    accepted = rules.admit(i("b_requests"), i("b_flows")).filter("accepted")
    return rules.attempted_flows(flows, rules.new_attempts(accepted, i("b_runs"), as_of()), as_of())


# -------------------------------------------------------------- next action
DECIDED = f"""{LAST},
arts AS (SELECT run_id, iteration_num, count(*) AS n FROM b_patches GROUP BY ALL),
outs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, iteration_num
  ORDER BY ts DESC, job_type DESC, runtime_s DESC, error DESC NULLS LAST) AS rn FROM b_exec) q WHERE rn = 1),
acted AS (SELECT r.run_id, r.flow_id, r.status, l.step, l.iteration_num, s.state_message,
  CASE WHEN r.job_run_id IS NULL THEN 'FLOW_ONLY' WHEN r.status IN ('SUCCESS','FAILED','CANCELLED') THEN 'CACHED'
   WHEN s.life_cycle_state = 'RUNNING' AND r.status <> 'RUNNING' THEN 'MARK_RUNNING'
   WHEN s.life_cycle_state <> 'TERMINATED' THEN 'NONE'
   WHEN s.result_state = 'SUCCESS' AND l.step = 'agent_generate' THEN 'EXECUTE_GENERATED'
   WHEN s.result_state = 'SUCCESS' AND l.step = 'agent_fix_errors' THEN 'EXECUTE_FIXED'
   WHEN s.result_state = 'SUCCESS' AND l.step = 'execute_notebooks' AND l.step_status = 'RUNNING' THEN 'CHECK_EXECUTION'
   WHEN s.result_state = 'SUCCESS' THEN 'NONE' WHEN s.result_state = 'FAILED' THEN 'FAIL_NEEDS_HUMAN'
   ELSE 'CANCEL_STOP' END AS action
  FROM b_runs r LEFT JOIN b_job_state s ON s.job_run_id = r.job_run_id LEFT JOIN last l ON l.run_id = r.run_id),
placed AS (SELECT *, CASE action WHEN 'EXECUTE_GENERATED' THEN 1 WHEN 'EXECUTE_FIXED' THEN iteration_num
   WHEN 'CHECK_EXECUTION' THEN iteration_num END AS exec_iteration FROM acted),
decided AS (SELECT p.*, coalesce(a.n, 0) AS n_artifacts, CASE WHEN a.n IS NOT NULL THEN o.status END AS outcome,
  CASE WHEN a.n IS NOT NULL THEN o.error END AS outcome_error, CASE WHEN a.n IS NOT NULL THEN o.logs_ref END AS logs_ref,
  CASE WHEN exec_iteration IS NULL THEN NULL WHEN a.n IS NULL THEN 'NO_ARTIFACTS' WHEN o.run_id IS NULL THEN 'AWAIT'
   WHEN o.status = 'SUCCESS' THEN 'FINISH' WHEN exec_iteration >= 5 AND (action = 'EXECUTE_FIXED' OR action = 'CHECK_EXECUTION' AND exec_iteration > 1) THEN 'HAND_OFF'
   ELSE 'NEXT_ITERATION' END AS follow_up
  FROM placed p LEFT JOIN arts a ON a.run_id = p.run_id AND a.iteration_num = p.exec_iteration
  LEFT JOIN outs o ON o.run_id = p.run_id AND o.iteration_num = p.exec_iteration)"""

CURRENT = f"""{DECIDED},
cur AS (SELECT * FROM decided WHERE run_id IN (SELECT current_run_id FROM b_flows WHERE current_run_id IS NOT NULL))"""


def decided(i):
    return rules.next_actions(i("b_runs"), i("b_job_state"), rules.latest_of(i("b_iterations")),
                              i("b_patches"), i("b_exec"))


def current_decisions(i):
    return poll.decide(i.ledger(), i("b_job_state"))


@check("d3_next_actions", f"""WITH {DECIDED}
SELECT run_id, flow_id, action, step, iteration_num, exec_iteration, n_artifacts, outcome, follow_up FROM decided""")
def next_actions(i):
    return decided(i).select("run_id", "flow_id", "action", "step", "iteration_num",
                             "exec_iteration", "n_artifacts", "outcome", "follow_up")


@check("d3_action_counts", f"""WITH {DECIDED}
SELECT action, coalesce(follow_up, '-') AS follow_up, count(*) AS runs FROM decided GROUP BY ALL""")
def action_counts(i):
    return decided(i).groupBy("action", F.coalesce("follow_up", F.lit("-")).alias("follow_up")).agg(
        F.count("*").alias("runs"))


@check("d8_iteration_gate", f"""WITH {DECIDED}
SELECT run_id, exec_iteration, follow_up, CASE WHEN follow_up = 'NEXT_ITERATION' THEN exec_iteration + 1 END AS next_iteration
FROM decided WHERE follow_up IN ('HAND_OFF','NEXT_ITERATION')""")
def gate(i):
    return rules.iteration_gate(decided(i))


STEP_EVENTS = """
ev AS (
  SELECT run_id, 1 AS o, iteration_num, CASE action WHEN 'EXECUTE_GENERATED' THEN 'agent_generate'
      WHEN 'EXECUTE_FIXED' THEN 'agent_fix_errors' ELSE step END AS step,
    CASE WHEN action = 'FAIL_NEEDS_HUMAN' THEN 'FAILED' ELSE 'COMPLETED' END AS step_status,
    CASE action WHEN 'EXECUTE_GENERATED' THEN 'Agent completed notebook generation'
      WHEN 'EXECUTE_FIXED' THEN 'Agent completed error fixing (iteration ' || CAST(iteration_num AS VARCHAR) || ')' END AS summary,
    CASE WHEN action = 'FAIL_NEEDS_HUMAN' THEN coalesce(state_message, 'Job failed') END AS error
  FROM cur WHERE action IN ('EXECUTE_GENERATED','EXECUTE_FIXED') OR (action = 'FAIL_NEEDS_HUMAN' AND iteration_num IS NOT NULL)
  UNION ALL SELECT run_id, 2, exec_iteration, 'execute_notebooks', 'RUNNING',
    'Executing ' || CAST(n_artifacts AS VARCHAR) || ' notebooks...', NULL
  FROM cur WHERE follow_up IN ('AWAIT','FINISH','NEXT_ITERATION','HAND_OFF') AND action <> 'CHECK_EXECUTION'
  UNION ALL SELECT run_id, 3, exec_iteration, 'execute_notebooks', CASE WHEN follow_up = 'FINISH' THEN 'COMPLETED' ELSE 'FAILED' END,
    CASE WHEN follow_up = 'FINISH' THEN 'All notebooks executed successfully' END,
    CASE WHEN follow_up <> 'FINISH' THEN coalesce(nullif(outcome_error, ''), 'Execution failed') END
  FROM cur WHERE follow_up IN ('FINISH','NEXT_ITERATION','HAND_OFF')
  UNION ALL SELECT run_id, 4, exec_iteration + 1, 'agent_fix_errors', 'RUNNING',
    'Agent analyzing logs and fixing errors (iteration ' || CAST(exec_iteration + 1 AS VARCHAR) || ')...', NULL
  FROM cur WHERE follow_up = 'NEXT_ITERATION'),
handed AS (SELECT run_id, flow_id, coalesce(iteration_num, 1) AS iteration_num,
  CASE WHEN action = 'FAIL_NEEDS_HUMAN' THEN 'agent_job_failed' ELSE 'max_iterations_reached' END AS reason,
  CASE WHEN action = 'FAIL_NEEDS_HUMAN' THEN 'Agent job failed: ' || coalesce(state_message, 'Job failed')
    ELSE 'Agent tried 5 iterations but could not fix errors. Review logs at ' || logs_ref END AS instructions
  FROM cur WHERE action = 'FAIL_NEEDS_HUMAN' OR follow_up = 'HAND_OFF')"""


SECOND = f"""{CURRENT},
waited AS (SELECT run_id, exec_iteration, CAST(run_id AS BIGINT) % 2 = 0 AS went_well,
  CASE WHEN iteration_num = exec_iteration THEN 'CHECK_EXECUTION' ELSE action END AS action FROM cur WHERE follow_up = 'AWAIT'),
second AS (SELECT *, CASE WHEN went_well THEN 'FINISH' WHEN exec_iteration > 1 AND exec_iteration >= 5 AND action <> 'EXECUTE_GENERATED'
    THEN 'HAND_OFF' ELSE 'NEXT_ITERATION' END AS follow_up FROM waited)"""


def second_poll(i):
    """Tables after a first poll, the jobs that its waiting runs had running, and the results these gave."""
    tables = i.ledger()
    store = Store(i.spark, new_dir(i.spark, "polls"))
    decisions = store.materialize(poll.decide(tables, i("b_job_state")))
    result = poll.apply(tables, decisions, as_of(), stored=True)
    store.commit(replace={"flows": result["flows"], "runs": result["runs"]}, append={"events": result["events"]})
    jobs = decisions.filter("follow_up = 'AWAIT'").select(
        "run_id", F.col("exec_iteration").alias("iteration_num"), "n_artifacts",
        F.lit("TERMINATED").alias("life_cycle_state"),
        F.when(F.col("run_id").cast("long") % 2 == 0, "SUCCESS").otherwise("FAILED").alias("result_state"),
        F.lit("lost").alias("state_message"), (F.col("run_id").cast("long") % 90).cast("int").alias("runtime_s"))
    found = poll.record(jobs, as_of(), "/vol/logs")["executions"]
    events = tables["events"].unionByName(store.read("events"), allowMissingColumns=True)
    after = {**tables, **{name: store.read(name) for name in ("flows", "runs")}, "events": events,
             "executions": tables["executions"].unionByName(found)}
    waited = store.materialize(jobs.select("run_id"))
    return after, waited


@check("d3_second_poll", f"""WITH {SECOND}
SELECT run_id, action, exec_iteration, CASE WHEN went_well THEN 'SUCCESS' ELSE 'FAILED' END AS outcome,
  CAST(run_id AS BIGINT) % 90 AS runtime_s, CASE WHEN NOT went_well THEN 'lost' END AS outcome_error,
  '/vol/logs/' || run_id || '/iter' || CAST(exec_iteration AS VARCHAR) AS logs_ref, follow_up FROM second""")
def decided_again(i):
    """Results that arrive after the poll that asked for them are found by the next one."""
    after, waited = second_poll(i)
    return poll.decide(after, i("b_job_state")).join(waited, "run_id", "left_semi").select(
        "run_id", "action", "exec_iteration", "outcome", F.col("runtime_s").cast("long").alias("runtime_s"),
        "outcome_error", "logs_ref", "follow_up")


@check("d4_second_poll_runs", f"""WITH {SECOND}
SELECT r.run_id, CASE s.follow_up WHEN 'FINISH' THEN 'SUCCESS' WHEN 'HAND_OFF' THEN 'FAILED' ELSE r.status END AS status,
  CASE WHEN s.follow_up = 'NEXT_ITERATION' THEN 'fix-' || r.run_id || '-' || CAST(s.exec_iteration + 1 AS VARCHAR)
    WHEN s.follow_up = 'HAND_OFF' THEN NULL ELSE r.job_run_id END AS job_run_id
FROM second s JOIN b_runs r ON r.run_id = s.run_id""")
def moved_again(i):
    """No run that waited stays as it was: it ends, or has a new job."""
    after, waited = second_poll(i)
    rows = rules.transition_rows(poll.decide(after, i("b_job_state")), as_of(), jobs_started(i))["runs"]
    runs = poll.update_runs(after["runs"], rows).join(waited, "run_id", "left_semi")
    handed = rows.filter("status = 'FAILED'").select("run_id", F.lit(True).alias("_handed"))
    return runs.join(handed, "run_id", "left").select(
        "run_id", "status", F.when(F.col("_handed").isNull(), F.col("job_run_id")).alias("job_run_id"))


def lost_jobs(i):
    """Polls that fail: every job of a run with an even number."""
    return i("b_job_state").withColumn("poll_error", F.when(
        F.col("run_id").cast("long") % 2 == 0, F.concat(F.lit("no answer for "), F.col("job_run_id"))))


@check("d3_poll_errors", f"""WITH {LAST}
SELECT r.run_id, r.flow_id, coalesce(l.iteration_num, 1) AS iteration_num, 'orchestration_error' AS reason,
  'Error during orchestration: no answer for ' || r.job_run_id AS instructions
FROM b_runs r JOIN b_flows f ON f.current_run_id = r.run_id LEFT JOIN last l ON l.run_id = r.run_id
WHERE r.job_run_id IS NOT NULL AND r.status NOT IN ('SUCCESS','FAILED','CANCELLED') AND CAST(r.run_id AS BIGINT) % 2 = 0""")
def poll_errors(i):
    decisions = poll.decide(i.ledger(), lost_jobs(i))
    return rules.hand_offs(decisions.filter("action = 'ERROR'"))


@check("d4_events", f"""WITH {CURRENT}, {STEP_EVENTS}
SELECT run_id, iteration_num, step, step_status, {AS_OF} AS ts, summary, error,
  row_number() OVER (PARTITION BY run_id ORDER BY o) AS event_seq FROM ev
UNION ALL SELECT run_id, iteration_num + 1, 'needs_human', 'COMPLETED', {AS_OF},
  'Marked as NEEDS_HUMAN: ' || reason, NULL, 100 FROM handed""")
def transition_events(i):
    return rules.transition_rows(current_decisions(i), as_of())["events"]


RUN_STATUS = """
CASE WHEN action = 'MARK_RUNNING' THEN 'RUNNING' WHEN action = 'CANCEL_STOP' THEN 'CANCELLED'
  WHEN action = 'FAIL_NEEDS_HUMAN' OR follow_up = 'HAND_OFF' THEN 'FAILED' WHEN follow_up = 'FINISH' THEN 'SUCCESS'
  WHEN follow_up = 'NEXT_ITERATION' THEN status END"""


def jobs_started(i):
    """Jobs of new iterations: one per run and iteration that an event names."""
    return i("b_iterations").select("run_id").distinct().select(
        "run_id", F.explode(F.sequence(F.lit(2), F.lit(8))).alias("iteration_num")).withColumn(
        "job_run_id", F.concat(F.lit("fix-"), F.col("run_id"), F.lit("-"),
                               F.col("iteration_num").cast("string")))


@check("d4_runs", f"""WITH {CURRENT},
upd AS (SELECT run_id, {RUN_STATUS} AS new_status, follow_up, exec_iteration FROM cur)
SELECT r.run_id, r.flow_id, CASE WHEN u.follow_up = 'NEXT_ITERATION'
    THEN 'fix-' || r.run_id || '-' || CAST(u.exec_iteration + 1 AS VARCHAR) ELSE r.job_run_id END AS job_run_id,
  r.start_ts, CASE WHEN u.new_status IN ('SUCCESS','FAILED','CANCELLED') THEN {AS_OF} ELSE r.end_ts END AS end_ts,
  coalesce(u.new_status, r.status) AS status FROM b_runs r LEFT JOIN upd u ON u.run_id = r.run_id""")
def transition_runs(i):
    tables = i.ledger()
    decisions = poll.decide(tables, i("b_job_state"))
    return poll.apply(tables, decisions, as_of(), jobs_started(i))["runs"]


def jobs_lost(i):
    """Jobs of new iterations of which a third failed to start and a third never came."""
    number = F.floor(F.col("run_id").cast("long") / 6) % 3
    return jobs_started(i).filter(number < 2).withColumns({
        "job_run_id": F.when(number == 0, F.col("job_run_id")), "error": F.when(number == 1, "no cluster")})


LOST = f"""{DECIDED},
lost AS (SELECT *, CASE WHEN CAST(run_id AS BIGINT) // 6 % 3 = 1 THEN 'no cluster' ELSE 'job was not created' END AS why
  FROM decided WHERE follow_up = 'NEXT_ITERATION' AND CAST(run_id AS BIGINT) // 6 % 3 > 0)"""


@check("d4_lost_launches", f"""WITH {LOST}
SELECT run_id, exec_iteration + 1 AS iteration_num, 'agent_fix_errors' AS step, 'FAILED' AS step_status, CAST(NULL AS VARCHAR) AS summary, why AS error FROM lost
UNION ALL SELECT run_id, exec_iteration + 2, 'needs_human', 'COMPLETED', 'Marked as NEEDS_HUMAN: orchestration_error', NULL FROM lost
UNION ALL SELECT run_id, exec_iteration + 1, 'agent_fix_errors', 'RUNNING',
  'Agent analyzing logs and fixing errors (iteration ' || CAST(exec_iteration + 1 AS VARCHAR) || ')...', NULL
FROM decided WHERE follow_up = 'NEXT_ITERATION' AND CAST(run_id AS BIGINT) // 6 % 3 = 0""")
def lost_launch_events(i):
    decisions = decided(i)
    rows = rules.transition_rows(decisions, as_of(), jobs_lost(i))["events"]
    following = decisions.filter("follow_up = 'NEXT_ITERATION'").select("run_id")
    return rows.join(following, "run_id", "left_semi").filter("step <> 'execute_notebooks' AND (summary IS NULL OR summary NOT LIKE '%completed%')").select(
        "run_id", "iteration_num", "step", "step_status", "summary", "error")


@check("d4_lost_launch_requests", f"""WITH {LOST}
SELECT l.run_id, r.status AS before, 'FAILED' AS status, l.exec_iteration + 1 AS iteration_num, 'orchestration_error' AS reason,
  'Error during orchestration: ' || why AS instructions FROM lost l JOIN b_runs r ON r.run_id = l.run_id""")
def lost_launch_requests(i):
    """The request and the status of every run whose next iteration did not start."""
    result = rules.transition_rows(decided(i), as_of(), jobs_lost(i))
    asked = result["requests"].filter("reason = 'orchestration_error'")
    before = i("b_runs").select("run_id", F.col("status").alias("before"))
    after = poll.update_runs(i("b_runs"), result["runs"]).select("run_id", "status")
    return asked.drop("status", "ts").join(after, "run_id").join(before, "run_id").select(
        "run_id", "before", "status", "iteration_num", "reason", "instructions")


FLOW_STATUS = """
CASE WHEN action = 'MARK_RUNNING' THEN 'RUNNING' WHEN action = 'CANCEL_STOP' THEN 'STOPPED'
  WHEN action = 'FAIL_NEEDS_HUMAN' OR follow_up = 'HAND_OFF' THEN 'NEEDS_HUMAN' WHEN follow_up = 'FINISH' THEN 'DONE' END"""


@check("d4_flows", f"""WITH {CURRENT},
upd AS (SELECT flow_id, {FLOW_STATUS} AS new_status FROM cur)
SELECT f.flow_id, coalesce(u.new_status, f.status) AS status, f.current_run_id,
  CASE WHEN u.new_status IS NOT NULL THEN {AS_OF} ELSE f.updated_ts END AS updated_ts
FROM b_flows f LEFT JOIN upd u ON u.flow_id = f.flow_id""")
def transition_flows(i):
    tables = i.ledger()
    decisions = poll.decide(tables, i("b_job_state"))
    return poll.apply(tables, decisions, as_of())["flows"].select(
        "flow_id", "status", "current_run_id", "updated_ts")


@check("d4_snapshot_after", f"""WITH {CURRENT}, {STEP_EVENTS},
added AS (SELECT run_id, iteration_num, step, summary, o AS seq FROM ev UNION ALL
  SELECT run_id, iteration_num + 1, 'needs_human', 'Marked as NEEDS_HUMAN: ' || reason, 100 FROM handed),
every AS (SELECT run_id, iteration_num, step, summary, ts, event_seq FROM b_iterations UNION ALL
  SELECT run_id, iteration_num, step, summary, {AS_OF}, seq FROM added),
fin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id
  ORDER BY iteration_num DESC, ts DESC, event_seq DESC) AS k FROM every) q WHERE k = 1)
SELECT f.flow_id, coalesce({FLOW_STATUS}, f.status) AS status, coalesce({RUN_STATUS.replace('THEN status', 'THEN cur.status')}, r.status) AS run_status,
  CASE WHEN r.run_id IS NOT NULL THEN fin.step END AS current_step,
  CASE WHEN r.run_id IS NOT NULL THEN fin.summary END AS current_summary
FROM b_flows f LEFT JOIN b_runs r ON r.run_id = f.current_run_id AND r.job_run_id IS NOT NULL
LEFT JOIN cur ON cur.run_id = f.current_run_id LEFT JOIN fin ON fin.run_id = r.run_id""")
def snapshot_after(i):
    """The status list once the rows of a whole poll are written to a store."""
    tables = i.ledger()
    store = Store(i.spark, new_dir(i.spark, "poll"))
    decisions = store.materialize(poll.decide(tables, i("b_job_state")))
    result = poll.apply(tables, decisions, as_of(), stored=True)
    store.commit(replace={"flows": result["flows"], "runs": result["runs"]},
                 append={"events": result["events"], "requests": result["requests"]})
    written = {name: store.read(name) for name in ("flows", "runs", "events")}
    return poll.snapshot_after(tables, written).select(
        "flow_id", "status", "run_status", "current_step", "current_summary")


@check("d5_requests", f"""WITH {CURRENT}, {STEP_EVENTS}
SELECT run_id, iteration_num, reason, instructions, 'PENDING' AS status, {AS_OF} AS ts FROM handed""")
def hand_off_requests(i):
    return rules.transition_rows(current_decisions(i), as_of())["requests"]


@check("d5_hand_offs_all_runs", f"""WITH {DECIDED},
cur AS (SELECT * FROM decided), {STEP_EVENTS}
SELECT run_id, flow_id, iteration_num, reason, instructions FROM handed""")
def all_hand_offs(i):
    return rules.hand_offs(decided(i))


# -------------------------------------------------------------------- stop
STOPS = f"""{LAST},
asked AS (SELECT DISTINCT coalesce(a.flow_id, b.flow_id, q.identifier) AS flow_id FROM b_requests q
  LEFT JOIN b_flows a ON a.flow_id = q.identifier LEFT JOIN b_flows b ON b.flow_name = q.identifier),
stops AS (SELECT k.flow_id, r.run_id, r.run_id IS NOT NULL AS accepted,
  CASE WHEN r.run_id IS NOT NULL THEN coalesce(l.iteration_num, 0) + 1 END AS next_iteration,
  CASE WHEN r.run_id IS NULL THEN 'No running job found' END AS error
  FROM asked k LEFT JOIN b_flows f ON f.flow_id = k.flow_id
  LEFT JOIN b_runs r ON r.run_id = f.current_run_id AND r.job_run_id IS NOT NULL LEFT JOIN last l ON l.run_id = r.run_id)"""


def stops(i):
    return rules.stop_requests(i("b_requests"), i("b_flows"), i("b_runs"),
                               rules.latest_of(i("b_iterations")))


@check("d6_stop_requests", f"WITH {STOPS} SELECT * FROM stops")
def stop_requests(i):
    return stops(i)


@check("d6_stop_events", f"""WITH {STOPS}
SELECT run_id, next_iteration AS iteration_num, 'user_cancellation' AS step, 'COMPLETED' AS step_status, {AS_OF} AS ts,
  'Cancelled by user' AS summary, CAST(NULL AS VARCHAR) AS error, CAST(1 AS BIGINT) AS event_seq FROM stops WHERE accepted""")
def stop_events(i):
    return rules.stop_rows(stops(i), as_of())["events"]


@check("d6_stopped_runs", f"""WITH {STOPS}
SELECT r.run_id, CASE WHEN s.run_id IS NOT NULL THEN 'CANCELLED' ELSE r.status END AS status,
  CASE WHEN s.run_id IS NOT NULL THEN {AS_OF} ELSE r.end_ts END AS end_ts
FROM b_runs r LEFT JOIN stops s ON s.run_id = r.run_id""")
def stopped_runs(i):
    return poll.update_runs(i("b_runs"), rules.stop_rows(stops(i), as_of())["runs"]).select(
        "run_id", "status", "end_ts")


# ------------------------------------------------- limits, scans, hand-offs
@check("d7_overdue_runs", """
SELECT run_id, flow_id, status, CAST(epoch(TIMESTAMP '1998-01-01 00:00:00') AS BIGINT) - CAST(epoch(start_ts) AS BIGINT) - 7200 AS overdue_s
FROM b_runs WHERE end_ts IS NULL AND status NOT IN ('SUCCESS','FAILED','CANCELLED')
  AND CAST(epoch(TIMESTAMP '1998-01-01 00:00:00') AS BIGINT) - CAST(epoch(start_ts) AS BIGINT) > 7200""")
def overdue(i):
    return rules.overdue_runs(i("b_runs"), F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'"))


@check("d7_timed_out", """
SELECT run_id, iteration_num, job_type, runtime_s, CASE WHEN runtime_s > 3600 THEN 'TIMEOUT' ELSE status END AS status, ts FROM b_exec""")
def timeouts(i):
    return rules.timed_out(i("b_exec")).select(
        "run_id", "iteration_num", "job_type", "runtime_s", "status", "ts")


ENFORCED = """
late AS (SELECT r.* FROM b_runs r JOIN b_flows f ON f.current_run_id = r.run_id
  WHERE r.end_ts IS NULL AND r.status NOT IN ('SUCCESS','FAILED','CANCELLED') AND r.job_run_id IS NOT NULL
  AND CAST(epoch(TIMESTAMP '1998-01-01 00:00:00') AS BIGINT) - CAST(epoch(r.start_ts) AS BIGINT) > 7200)"""


def enforced(i):
    return limits.enforce(i.ledger(), F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'"))


@check("d7_enforced_runs", f"""WITH {ENFORCED}
SELECT r.run_id, CASE WHEN l.run_id IS NULL THEN r.status ELSE 'CANCELLED' END AS status,
  CASE WHEN l.run_id IS NULL THEN r.end_ts ELSE TIMESTAMP '1998-01-01 00:00:00' END AS end_ts
FROM b_runs r LEFT JOIN late l ON l.run_id = r.run_id""")
def enforced_runs(i):
    """Current runs over the limit, whose jobs were ended, are cancelled."""
    return enforced(i)["runs"].select("run_id", "status", "end_ts")


@check("d7_enforced_flows", f"""WITH {ENFORCED}
SELECT f.flow_id, CASE WHEN l.run_id IS NULL THEN f.status ELSE 'STOPPED' END AS status
FROM b_flows f LEFT JOIN late l ON l.flow_id = f.flow_id""")
def enforced_flows(i):
    return enforced(i)["flows"].select("flow_id", "status")


@check("d7_enforced_executions", """
SELECT run_id, iteration_num, job_type, CASE WHEN runtime_s > 3600 THEN 'TIMEOUT' ELSE status END AS status, runtime_s FROM b_exec""")
def enforced_executions(i):
    return enforced(i)["executions"].select("run_id", "iteration_num", "job_type", "status", "runtime_s")


GATE = """
gate AS (SELECT run_id, iteration_num, count(*) FILTER (scan_status = 'BLOCKED') AS blocked_scans,
  max(CASE WHEN scan_status = 'BLOCKED' THEN CAST(json_extract(findings_json, '$.severity') AS INT) END) AS worst_severity,
  'sast_blocked' AS reason FROM b_scans GROUP BY run_id, iteration_num HAVING bool_or(scan_status = 'BLOCKED'))"""


@check("d9_scan_gate", f"WITH {GATE} SELECT * FROM gate")
def scan_gate(i):
    return rules.scan_gate(i("b_scans"))


@check("d9_scan_requests", f"""WITH {GATE}
SELECT g.run_id, max(g.iteration_num) AS iteration_num, 'sast_blocked' AS reason,
  'Review logs and execution results for ' || g.run_id AS instructions, 'PENDING' AS status, {AS_OF} AS ts
FROM gate g JOIN b_runs r ON r.run_id = g.run_id GROUP BY g.run_id""")
def scan_requests(i):
    asked = rules.scan_hand_offs(i("b_scans"), i("b_runs"))
    return rules.human_rows(asked, as_of())["requests"]


@check("d9_gate_runs", f"""WITH {GATE},
stopped AS (SELECT g.run_id, max(g.iteration_num) AS n FROM gate g JOIN b_runs r ON r.run_id = g.run_id
  JOIN b_flows f ON f.current_run_id = r.run_id
  WHERE r.status NOT IN ('SUCCESS','FAILED','CANCELLED') GROUP BY g.run_id HAVING max(g.iteration_num) % 2 = 0)
SELECT r.run_id, CASE WHEN s.run_id IS NOT NULL THEN 'FAILED' ELSE r.status END AS status, s.n AS asked
FROM b_runs r LEFT JOIN stopped s ON s.run_id = r.run_id""")
def gate_runs(i):
    """Open current runs with a blocked scan stop; odd iterations were asked about before."""
    tables = i.ledger()
    before = i("b_scans").filter("iteration_num % 2 = 1").select(
        "run_id", "iteration_num", F.lit("sast_blocked").alias("reason"), F.lit("seen").alias("instructions"),
        F.lit("RESOLVED").alias("status"), "ts").distinct()
    result = poll.security_gate({**tables, "requests": before}, as_of())
    asked = result["requests"].select("run_id", F.col("iteration_num").alias("asked"))
    return result["runs"].select("run_id", "status").join(asked, "run_id", "left")


@check("d10_agent_calls", """
SELECT run_id, iteration_num, event_seq, CASE
  WHEN coalesce(run_id,'') = '' OR coalesce(flow_id,'') = '' OR coalesce(flow_name,'') = ''
    THEN 'Missing required parameters: run_id, flow_id, and flow_name are required.'
  WHEN iteration_num = 1 AND coalesce(source_path,'') = '' THEN 'source_path is required for iteration 1 (generation)'
  WHEN iteration_num > 1 AND coalesce(logs_path,'') = '' THEN 'logs_path is required for iteration 2+ (error fixing)' END AS message
FROM b_calls""")
def agent_calls(i):
    return rules.agent_call_check(i("b_calls")).select(
        "run_id", "iteration_num", "event_seq", "message")


EXECUTED = """
jobs AS (SELECT s.run_id, CAST(1 AS INT) AS iteration_num, count(p.run_id) AS n_artifacts, s.life_cycle_state, s.result_state, s.state_message
  FROM b_job_state s LEFT JOIN b_patches p ON p.run_id = s.run_id GROUP BY ALL)"""


def executed(i):
    counted = i("b_patches").groupBy("run_id").agg(F.count("*").alias("n_artifacts"))
    return i("b_job_state").join(counted, "run_id", "left").withColumns({
        "n_artifacts": F.coalesce("n_artifacts", F.lit(0)), "iteration_num": F.lit(1),
        "runtime_s": F.lit(60)})


@check("d11_execution_rows", f"""WITH {EXECUTED}
SELECT run_id, iteration_num, 'notebook_execution' AS job_type,
  CASE WHEN result_state = 'SUCCESS' THEN 'SUCCESS' ELSE 'FAILED' END AS status, 60 AS runtime_s,
  CASE WHEN result_state IS DISTINCT FROM 'SUCCESS' THEN coalesce(nullif(state_message,''), 'Execution failed') END AS error,
  '/vol/logs/' || run_id || '/iter1' AS logs_ref, {AS_OF} AS ts FROM jobs WHERE life_cycle_state = 'TERMINATED'""")
def execution_rows(i):
    return rules.execution_rows(executed(i), as_of(), "/vol/logs")


@check("d11_execution_events", f"""WITH {EXECUTED}
SELECT run_id, iteration_num, 'execute_notebooks' AS step, 'RUNNING' AS step_status,
  'Executing ' || CAST(n_artifacts AS VARCHAR) || ' notebooks...' AS summary, CAST(NULL AS VARCHAR) AS error,
  {AS_OF} AS ts, CAST(1 AS BIGINT) AS event_seq FROM jobs
UNION ALL SELECT run_id, iteration_num, 'execute_notebooks',
  CASE WHEN result_state = 'SUCCESS' THEN 'COMPLETED' ELSE 'FAILED' END,
  CASE WHEN result_state = 'SUCCESS' THEN 'All notebooks executed successfully' END,
  CASE WHEN result_state IS DISTINCT FROM 'SUCCESS' THEN coalesce(nullif(state_message,''), 'Execution failed') END,
  {AS_OF}, 2 FROM jobs WHERE life_cycle_state = 'TERMINATED'""")
def execution_events(i):
    return rules.execution_events(executed(i), as_of())


@check("d12_open_requests", """
SELECT h.run_id, h.iteration_num, h.reason, h.instructions, h.ts, r.flow_id, f.flow_name
FROM b_human h JOIN b_runs r ON r.run_id = h.run_id JOIN b_flows f ON f.flow_id = r.flow_id WHERE h.status = 'PENDING'""")
def open_requests(i):
    return rules.open_requests(i("b_human"), i("b_runs"), i("b_flows")).select(
        "run_id", "iteration_num", "reason", "instructions", "ts", "flow_id", "flow_name")


@check("d12_resolved_requests", """
SELECT h.run_id, h.iteration_num, h.reason, h.instructions, h.ts,
  CASE WHEN l.run_id IS NOT NULL THEN 'RESOLVED' ELSE h.status END AS status
FROM b_human h LEFT JOIN (SELECT DISTINCT run_id, iteration_num FROM b_scans) l
  ON l.run_id = h.run_id AND l.iteration_num = h.iteration_num""")
def resolved_requests(i):
    answers = i("b_scans").select("run_id", "iteration_num").distinct().withColumn(
        "status", F.lit("RESOLVED"))
    return rules.resolve_requests(i("b_human"), answers)


# --------------------------------------------------------------- integrity
@check("dq1_duplicate_keys", """
SELECT run_id, iteration_num, count(*) AS count FROM b_iterations GROUP BY run_id, iteration_num HAVING count(*) > 1""")
def duplicate_keys(i):
    return quality.duplicate_keys(i("b_iterations"), ["run_id", "iteration_num"])


KEYED = [("flows", "b_flows", "flow_id"), ("runs", "b_runs", "run_id"),
         ("events", "b_iterations", "run_id, iteration_num"),
         ("artifacts", "b_patches", "run_id, iteration_num, artifact_ref"),
         ("scans", "b_scans", "run_id, iteration_num, artifact_ref"),
         ("executions", "b_exec", "run_id, iteration_num, job_type"),
         ("requests", "b_human", "run_id, iteration_num")]


@check("dq1_duplicate_report", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS duplicate_keys, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus_rows "
    f"FROM (SELECT count(*) AS n FROM {v} GROUP BY {k} HAVING count(*) > 1) q" for t, v, k in KEYED))
def duplicate_report(i):
    return quality.duplicate_report(i.ledger())


@check("dq2_domain_violations", """
SELECT 'flows' AS table_name, 'status' AS column_name, status AS value, count(*) AS rows FROM b_legacy_flows
WHERE status NOT IN ('NOT_STARTED','RUNNING','NEEDS_HUMAN','FAILED','DONE','STOPPED') GROUP BY status
UNION ALL SELECT 'events', 'step_status', step, count(*) FROM b_iterations GROUP BY step""")
def domain_violations(i):
    """Old flow statuses and step names in place of step statuses: both break the lists."""
    tables = i.ledger()
    tables["flows"] = i("b_legacy_flows")
    tables["events"] = tables["events"].withColumn("step_status", F.col("step"))
    return quality.domain_violations(tables)


@check("dq3_null_report", """
SELECT 'flows' AS table_name, 'flow_id' AS column_name, count(*) FILTER (current_run_id IS NULL) AS null_rows FROM b_flows
UNION ALL SELECT 'flows', 'flow_name', count(*) FILTER (source_path IS NULL) FROM b_flows
UNION ALL SELECT 'flows', 'status', count(*) FILTER (status IS NULL) FROM b_flows
UNION ALL SELECT 'runs', 'run_id', count(*) FILTER (run_id IS NULL) FROM b_runs
UNION ALL SELECT 'runs', 'flow_id', count(*) FILTER (end_ts IS NULL) FROM b_runs""")
def null_report(i):
    """Columns with NULLs stand in for required ones, so that there is something to find."""
    flows = i("b_flows").withColumns({"flow_id": F.col("current_run_id"),
                                      "flow_name": F.col("source_path")})
    runs = i("b_runs").withColumn("flow_id", F.col("end_ts").cast("string"))
    return quality.null_report({"flows": flows, "runs": runs})


LEDGER_VIEWS = {t: v for t, v, _ in KEYED}


@check("dq3_null_report_of_all_tables", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{f.name}' AS column_name, count(*) FILTER ({f.name} IS NULL) AS null_rows FROM {v}"
    for t, v in LEDGER_VIEWS.items() for f in TABLES[t].fields if not f.nullable))
def null_report_of_all_tables(i):
    return quality.null_report(i.ledger())


@check("dq4_link_report", """
WITH fin AS (SELECT * FROM b_runs WHERE status IN ('SUCCESS','FAILED','CANCELLED'))
SELECT 'runs' AS child, 'flow_id' AS child_column, 'flows' AS parent, count(*) AS orphan_count FROM fin WHERE flow_id NOT IN (SELECT flow_id FROM b_flows)
UNION ALL SELECT 'events', 'run_id', 'runs', count(*) FROM b_iterations WHERE run_id NOT IN (SELECT run_id FROM fin)
UNION ALL SELECT 'artifacts', 'run_id', 'runs', count(*) FROM b_patches WHERE run_id NOT IN (SELECT run_id FROM fin)
UNION ALL SELECT 'scans', 'run_id', 'runs', count(*) FROM b_scans WHERE run_id NOT IN (SELECT run_id FROM fin)
UNION ALL SELECT 'executions', 'run_id', 'runs', count(*) FROM b_exec WHERE run_id NOT IN (SELECT run_id FROM fin)
UNION ALL SELECT 'requests', 'run_id', 'runs', count(*) FROM b_human WHERE run_id NOT IN (SELECT run_id FROM fin)
UNION ALL SELECT 'flows', 'current_run_id', 'runs', count(*) FROM b_flows
  WHERE current_run_id IS NOT NULL AND current_run_id NOT IN (SELECT run_id FROM fin)""")
def link_report(i):
    tables = i.ledger()
    tables["runs"] = tables["runs"].filter(F.col("status").isin("SUCCESS", "FAILED", "CANCELLED"))
    return quality.link_report(tables)
