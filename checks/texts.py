"""Files, definitions, generated artifacts, text, time and JSON expressions."""

from pyspark.sql import functions as F

from checks.inputs import AS_OF
from checks.registry import check
from ledgerline.functions import definition, text, timing
from ledgerline.functions.definition import validity
from ledgerline.functions.status import legacy_flow_status, legacy_run_status, placeholder_event
from ledgerline.operators import joins
from ledgerline.operators.totals import ingest_report
from ledgerline.plans import ingest, migrate, records
from ledgerline.session import new_dir
from ledgerline.sources import files, jobs, polls
from ledgerline.streaming import events as streams



def as_of():
    return F.expr(AS_OF.replace("TIMESTAMP", "TIMESTAMP_NTZ"))


# One definition document per flow, as the Spark side builds it.
DOCUMENTS = """
bodies AS (SELECT flow_id, string_agg('<processor><id>' || id || '</id><name>' || name || '</name><class>'
  || type || '</class></processor>', '' ORDER BY CAST(id AS BIGINT)) AS body FROM b_processors GROUP BY flow_id),
docs AS (SELECT p.flow_id, p.path, p.form, CASE p.form
  WHEN 'broken' THEN '<template><groupId>' || p.flow_id || '</template>'
  WHEN 'controller' THEN '<flowController><rootGroup id="' || p.flow_id || '"><processGroup id="g-' || p.flow_id
    || '"><name>group ' || p.flow_id || '</name>' || b.body
    || '</processGroup><processGroup><name/></processGroup></rootGroup></flowController>'
  ELSE '<template><description>defs of ' || p.flow_id || '</description><groupId> ' || p.flow_id
    || ' </groupId><snippet>' || b.body || '</snippet></template>' END AS content
  FROM b_paths p JOIN bodies b ON b.flow_id = p.flow_id)"""

SERVER = """
CASE WHEN path LIKE '/vol/defs/prod/%' THEN 'prod' WHEN path LIKE '/vol/defs/dev/%' THEN 'dev' ELSE 'default' END"""


def written_definitions(i, label):
    """The definition documents as files in the shared folder; where they are."""
    base = new_dir(i.spark, label)
    named = i.definitions().select(F.substring("path", 2, 1 << 20).alias("name"), "content")
    files.write_files(named, base)
    return base


def below(path, base):
    return F.concat(F.lit("/"), F.substring_index(path, base.rsplit("/", 1)[1] + "/", -1))


# ------------------------------------------------------------------- files
@check("s1_scan_definitions", f"WITH {DOCUMENTS} SELECT path, strlen(content) AS length FROM docs")
def scan_definitions(i):
    base = written_definitions(i, "definitions")
    found = files.scan_files(i.spark, base)
    return found.select(below(F.col("path"), base).alias("path"), "length")


@check("s2_read_definitions", f"WITH {DOCUMENTS} SELECT path, md5(content) AS digest FROM docs")
def read_definitions(i):
    base = written_definitions(i, "definitions")
    texts = files.read_texts(i.spark, base)
    return texts.select(below(F.col("path"), base).alias("path"),
                        F.md5(F.col("content").cast("binary")).alias("digest"))


@check("s1_scan_report", f"""WITH {DOCUMENTS},
bad AS (SELECT count(*) AS n FROM docs WHERE form = 'broken')
SELECT 'text' AS state, count(*) AS files, CAST(sum(strlen(content)) AS BIGINT) AS bytes FROM docs
UNION ALL SELECT 'not text', n, 3 * n FROM bad WHERE n > 0 UNION ALL SELECT 'empty', n, 0 FROM bad WHERE n > 0
UNION ALL SELECT 'hidden', n, 2 * n FROM bad WHERE n > 0""")
def scan_report(i):
    """For each broken document also a file of bytes, an empty one and a hidden one."""
    return files.scan_report(i.spark, odd_files(i)).groupBy("state").agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes"))


def odd_files(i):
    base = written_definitions(i, "reported")
    broken = i.definitions().filter("form = 'broken'").select(F.substring("path", 2, 1 << 20).alias("name"))
    more = F.array(
        F.struct(F.lit(".bytes.xml").alias("ending"), F.lit(bytes([255, 254, 0])).alias("content")),
        F.struct(F.lit(".empty.xml").alias("ending"), F.lit(b"").alias("content")),
        F.struct(F.lit("/_hidden.xml").alias("ending"), F.lit(b"ok").alias("content")))
    each = broken.select("name", F.inline(more))
    files.write_files(each.select(F.concat(F.regexp_replace("name", "[.]xml$", ""), "ending").alias("name"), "content"), base)
    return base


@check("s4_log_counts", """
SELECT '/logs/run-' || CAST(CAST(floor(doc_id / 20) AS BIGINT) AS VARCHAR) AS folder, count(*) AS log_files
FROM documents WHERE doc_id % 3 <> 0 GROUP BY ALL""")
def log_counts(i):
    base = new_dir(i.spark, "logs")
    ending = F.when(F.col("doc_id") % 3 != 0, ".log").otherwise(".txt")
    run = F.floor(F.col("doc_id") / 20).cast("string")
    named = i("documents").select(
        F.concat(F.lit("logs/run-"), run, F.lit("/"), F.col("doc_id").cast("string"), ending)
        .alias("name"), F.col("text").alias("content"))
    files.write_files(named, base)
    counted = files.log_counts(i.spark, f"{base}/logs/*")
    return counted.select(below(F.col("folder"), base).alias("folder"), "log_files")


@check("s5_fetch_artifacts", """
SELECT p.run_id, p.artifact_ref, d.doc_id IS NOT NULL AS found,
  md5(coalesce(d.text, '# Notebook not yet available' || chr(10) || '# ' || p.artifact_ref || ' not found')) AS digest
FROM b_patches p LEFT JOIN documents d ON '/vol/out/part_' || CAST(d.doc_id AS VARCHAR) || '.py' = p.artifact_ref""")
def fetch(i):
    stored = i("documents").select(
        F.concat(F.lit("/vol/out/part_"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
        F.col("text").alias("content"))
    wanted = i("b_patches").select("run_id", F.col("artifact_ref").alias("path"))
    return joins.fetch_artifacts(wanted, stored).select(
        "run_id", F.col("path").alias("artifact_ref"), "found",
        F.md5(F.col("content").cast("binary")).alias("digest"))


SNAPSHOTS = """
snaps AS (SELECT job_run_id, CAST(run_id AS BIGINT) AS k,
  CASE WHEN CAST(run_id AS BIGINT) % 17 = 0 THEN NULL ELSE epoch_ms(start_ts) + CAST(run_id AS BIGINT) % 1000 END AS start_time,
  epoch_ms(end_ts) + 500 AS end_time, status FROM b_runs WHERE job_run_id IS NOT NULL),
tasks AS (
  SELECT job_run_id, 'task_0' AS task_key, '/vol/out/' || job_run_id || '.py' AS artifact_path,
    'TERMINATED' AS state, start_time, end_time, CASE WHEN status = 'FAILED' THEN 'task failed' END AS error
  FROM snaps WHERE k % 3 <> 0
  UNION ALL SELECT job_run_id, 'task_1', '', 'UNKNOWN', start_time, NULL, NULL FROM snaps WHERE k % 3 = 2)"""


def snapshots(i):
    """One JSON document per job: its state and a list of no, one or two tasks."""
    k = F.col("run_id").cast("long")
    start = F.when(k % 17 != 0, F.unix_millis(F.col("start_ts").cast("timestamp")) + k % 1000)
    end = F.unix_millis(F.col("end_ts").cast("timestamp")) + 500
    none = F.lit(None).cast("string")

    def task(key, path, state, message, finish):
        return F.struct(
            F.lit(key).alias("task_key"), path.alias("artifact_path"),
            state.alias("life_cycle_state"), message.alias("state_message"),
            start.alias("start_time"), finish.alias("end_time"))

    path = F.concat(F.lit("/vol/out/"), F.col("job_run_id"), F.lit(".py"))
    failed = F.when(F.col("status") == "FAILED", "task failed").otherwise("")
    first = task("task_0", path, F.lit("TERMINATED"), failed, end)
    second = task("task_1", none, none, none, F.lit(None).cast("long"))
    tasks = F.slice(F.array(first, second), 1, (k % 3).cast("int"))
    state = F.when(F.col("status") != "CREATING", F.col("status"))
    document = F.struct(
        "job_run_id", state.alias("life_cycle_state"), start.alias("start_time"),
        end.alias("end_time"), tasks.alias("tasks"))
    texts = i("b_runs").filter("job_run_id IS NOT NULL").select(
        F.to_json(document).alias("snapshot"))
    return jobs.read_snapshots(texts)


MS = "CAST(make_timestamp({} * 1000) AS TIMESTAMP)"


@check("s6_job_runs", f"""WITH {SNAPSHOTS}
SELECT job_run_id, CASE WHEN status = 'CREATING' THEN 'UNKNOWN' ELSE status END AS state,
  coalesce({MS.format('start_time')}, {AS_OF}) AS start_ts, {MS.format('end_time')} AS end_ts,
  coalesce(CAST(floor((end_time - start_time) / 1000) AS BIGINT), 0) AS duration_s FROM snaps""")
def job_runs(i):
    now = F.expr(AS_OF)
    return jobs.job_runs(snapshots(i), now).select(
        "job_run_id", "state", F.col("start_ts").cast("timestamp_ntz").alias("start_ts"),
        F.col("end_ts").cast("timestamp_ntz").alias("end_ts"), "duration_s")


POLLED = " UNION ALL ".join(f"""
SELECT {poll} AS poll, job_run_id, CASE WHEN status = 'CREATING' THEN 'UNKNOWN' ELSE status END AS state,
  {MS.format('end_time')} AS end_ts, coalesce(CAST(floor((end_time - start_time) / 1000) AS BIGINT), 0) AS duration_s
FROM snaps WHERE {which}""" for poll, which in enumerate((
    "CAST(job_run_id AS BIGINT) % 2 = 0", "CAST(job_run_id AS BIGINT) % 2 = 1", "CAST(job_run_id AS BIGINT) % 5 = 0")))


@check("s6_streamed_job_runs", f"WITH {SNAPSHOTS} {POLLED}")
def streamed_job_runs(i):
    """Three polls through the stream, the last after a restart from the offset of the others."""
    base, every = new_dir(i.spark, "polls"), snapshots(i)
    number = F.col("job_run_id").cast("long")
    parts = [every.filter(number % 2 == 0), every.filter(number % 2 == 1), every.filter(number % 5 == 0)]
    for poll, part in enumerate(parts):
        polls.write_poll(part, f"{base}/polls", poll)
        if poll:
            streams.run_available(polls.poll_stream(i.spark, f"{base}/polls"),
                                  streams.append_batches(f"{base}/seen"), f"{base}/checkpoint")
    seen = i.spark.read.parquet(f"{base}/seen")
    numbered = jobs.job_runs(seen.withColumn("job_run_id", F.concat_ws("/", "poll", "job_run_id")), F.expr(AS_OF))
    return numbered.select(
        F.substring_index("job_run_id", "/", 1).cast("int").alias("poll"),
        F.substring_index("job_run_id", "/", -1).alias("job_run_id"), "state",
        F.col("end_ts").cast("timestamp_ntz").alias("end_ts"), "duration_s")


@check("s6_job_tasks", f"""WITH {SNAPSHOTS}
SELECT job_run_id, task_key, artifact_path, state, error, {MS.format('start_time')} AS start_ts,
  CAST(floor((end_time - start_time) / 1000) AS BIGINT) AS duration_s FROM tasks""")
def job_tasks(i):
    return jobs.job_tasks(snapshots(i)).select(
        "job_run_id", "task_key", "artifact_path", "state", "error",
        F.col("start_ts").cast("timestamp_ntz").alias("start_ts"), "duration_s")


# ------------------------------------------------------------- definitions
@check("c1_definition_catalogue", f"""
SELECT path, CASE WHEN form <> 'broken' THEN flow_id END AS flow_id,
  replace(split_part(path, '/', -1), '.xml', '') AS flow_name, {SERVER} AS server,
  CASE WHEN form = 'template' THEN 'defs of ' || flow_id END AS description,
  form <> 'broken' AS valid,
  CASE WHEN form = 'broken' THEN 'Invalid XML' ELSE 'Valid definition XML file' END AS message
FROM b_paths""")
def definition_catalogue(i):
    found = ingest.catalogue(i.definitions(), "defs")
    return found.select("path", "flow_id", "flow_name", "server", "description", "valid",
                        F.substring_index("message", ":", 1).alias("message"))


@check("c1_definition_files_catalogue", f"""
SELECT path, CASE WHEN form <> 'broken' THEN flow_id END AS flow_id, {SERVER} AS server FROM b_paths""")
def definition_files(i):
    base = written_definitions(i, "definitions")
    found = ingest.catalogue(files.read_texts(i.spark, base), "defs")
    return found.select(below(F.col("path"), base).alias("path"), "flow_id", "server")


@check("c2_descriptions", """
SELECT path, CASE WHEN form = 'template' THEN 'defs of ' || flow_id END AS description FROM b_paths""")
def descriptions(i):
    parsed = ingest.parsed_files(i.definitions())
    return parsed.select("path", F.col("parsed.description").alias("description"))


@check("c3_validity", """
SELECT path, form <> 'broken' AS valid, CASE form WHEN 'controller' THEN 'flowController'
  WHEN 'template' THEN 'template' END AS root FROM b_paths
UNION ALL SELECT 'page ' || CAST(page_id AS VARCHAR), false, NULL FROM pages
UNION ALL SELECT 'wrapped ' || CAST(page_id AS VARCHAR), false, 'page' FROM pages""")
def validity_of_files(i):
    return judged_files(i).select("path", "valid", "root")


@check("c3_messages", """
SELECT path, CASE WHEN form = 'broken' THEN 'Invalid XML: ' ELSE 'Valid definition XML file' END AS message FROM b_paths
UNION ALL SELECT 'page ' || CAST(page_id AS VARCHAR), 'Invalid XML: ' FROM pages
UNION ALL SELECT 'wrapped ' || CAST(page_id AS VARCHAR), 'Not a valid definition XML file' FROM pages""")
def messages_of_files(i):
    """Messages; of a parser's own words only what stands before them."""
    return judged_files(i).select("path", F.regexp_replace("message", "(?s)^(Invalid XML: ).*", "$1").alias("message"))


def judged_files(i):
    """Definitions, web pages (not well formed) and well-formed text with another root."""
    pages = i("pages").select(
        F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("path"),
        F.concat(F.lit("<"), F.col("html")).alias("content"))
    wrapped = i("pages").select(
        F.concat(F.lit("wrapped "), F.col("page_id").cast("string")).alias("path"),
        F.concat(F.lit("<page><![CDATA["), F.col("html"), F.lit("]]></page>")).alias("content"))
    every = i.definitions().select("path", "content").unionByName(pages).unionByName(wrapped)
    parsed, check = ingest.parsed_files(every), validity(F.col("parsed"))
    return parsed.select("path", check["valid"].alias("valid"), check["message"].alias("message"),
                         F.col("parsed.root").alias("root"))


@check("c4_process_groups", """
SELECT path, 0 AS place, CASE WHEN form = 'controller' THEN 'g-' || flow_id ELSE 'main_flow' END AS group_id,
  CASE WHEN form = 'controller' THEN 'group ' || flow_id ELSE 'Main Flow' END AS group_name
FROM b_paths WHERE form <> 'broken'
UNION ALL SELECT path, 1, 'flow_1', NULL FROM b_paths WHERE form = 'controller'""")
def process_groups(i):
    return ingest.groups(i.definitions()).select("path", "place", "group_id", "group_name")


@check("c4_process_groups_in_sql", """
SELECT path, 0 AS place, CASE WHEN form = 'controller' THEN 'g-' || flow_id ELSE 'main_flow' END AS group_id,
  CASE WHEN form = 'controller' THEN 'group ' || flow_id ELSE 'Main Flow' END AS group_name
FROM b_paths WHERE form <> 'broken'
UNION ALL SELECT path, 1, 'flow_1', NULL FROM b_paths WHERE form = 'controller'""")
def process_groups_in_sql(i):
    definition.register(i.spark)
    i.definitions().createOrReplaceTempView("definition_files")
    return i.spark.sql("SELECT f.path, g.place, g.id AS group_id, g.name AS group_name "
                       "FROM definition_files f, LATERAL process_groups(f.content) g")


INTENT = """
CASE split_part(type, '.', -1) WHEN 'GetFile' THEN 'ingestion' WHEN 'ReplaceText' THEN 'transformation'
  WHEN 'RouteOnAttribute' THEN 'routing' WHEN 'PutFile' THEN 'output'
  WHEN 'LogMessage' THEN 'monitoring' ELSE 'other' END"""

GOOD = f"""
good AS (SELECT p.*, {INTENT} AS intent, b.path FROM b_processors p
  JOIN b_paths b ON b.flow_id = p.flow_id WHERE b.form <> 'broken')"""


@check("c5_processors", f"WITH {GOOD} SELECT path, flow_id, id, name, type, intent FROM good")
def processors(i):
    return ingest.processors(i.definitions())


@check("c5_processors_of_records", f"WITH {GOOD} SELECT path, flow_id, id, name, type, intent FROM good")
def processors_of_records(i):
    """From files that are parsed in a stream, none of them a value."""
    base = written_definitions(i, "records")
    found = records.processors(records.records(i.spark, base))
    return found.withColumn("path", below(F.col("path"), base))


@check("c4_groups_of_records", """
SELECT path, 0 AS place, CASE WHEN form = 'controller' THEN 'g-' || flow_id ELSE 'main_flow' END AS group_id,
  CASE WHEN form = 'controller' THEN 'group ' || flow_id ELSE 'Main Flow' END AS group_name
FROM b_paths WHERE form <> 'broken'
UNION ALL SELECT path, 1, 'flow_1', NULL FROM b_paths WHERE form = 'controller'""")
def groups_of_records(i):
    base = written_definitions(i, "records")
    return records.groups(records.records(i.spark, base)).withColumn("path", below(F.col("path"), base))


@check("c1_catalogue_of_records", f"""
SELECT path, CASE WHEN form <> 'broken' THEN flow_id END AS flow_id, replace(split_part(path, '/', -1), '.xml', '') AS flow_name,
  {SERVER} AS server, CASE WHEN form = 'template' THEN 'defs of ' || flow_id END AS description, form <> 'broken' AS valid FROM b_paths""")
def catalogue_of_records(i):
    base = written_definitions(i, "records")
    found = records.catalogue(records.records(i.spark, base), "defs")
    return found.withColumn("path", below(F.col("path"), base)).drop("error")


@check("c5_processors_in_sql", f"WITH {GOOD} SELECT path, flow_id, id, name, type FROM good")
def processors_in_sql(i):
    """The table function in a lateral join."""
    definition.register(i.spark)
    i.definitions().createOrReplaceTempView("definition_files")
    return i.spark.sql(
        "SELECT f.path, p.flow_id, p.id, p.name, p.type FROM definition_files f, LATERAL processors(f.content) p")


@check("c6_intents", f"SELECT id, type, {INTENT} AS intent FROM b_processors")
def intents(i):
    return i("b_processors").select("id", "type", text.intent_of(F.col("type")).alias("intent"))


@check("c7_server_of_path", """
SELECT flow_id, source_path, CASE WHEN source_path IS NULL THEN 'default' ELSE server END AS path_server
FROM b_flows""")
def server_of(i):
    return i("b_flows").select("flow_id", "source_path",
                               text.server_of(F.col("source_path"), "defs").alias("path_server"))


@check("c7_segment_of_url", """
SELECT page_id, CASE WHEN len(parts) > 4 THEN parts[4] ELSE 'default' END AS segment
FROM (SELECT page_id, string_split(url, '/') AS parts FROM pages) q""")
def segment_of_url(i):
    """The segment after the host, with the host in the place of the volume."""
    host = F.get(F.split("url", "/"), 2)
    marked = i("pages").withColumn("path", F.replace("url", host, F.lit("volume")))
    return marked.select("page_id", text.server_of(F.col("path"), "volume").alias("segment"))


@check("c8_flow_name", """
SELECT path, replace(split_part(path, '/', -1), '.xml', '') AS flow_name FROM b_paths
UNION ALL SELECT url, replace(split_part(url, '/', -1), '.xml', '') FROM pages""")
def flow_name(i):
    paths = i("b_paths").select("path").unionByName(i("pages").select(F.col("url").alias("path")))
    return paths.select("path", text.flow_name_of(F.col("path")).alias("flow_name"))


@check("a9_ingest_report", """
SELECT count(*) AS files_found, count(*) FILTER (form <> 'broken') AS parsed,
  count(*) FILTER (form = 'broken') AS failed FROM b_paths""")
def report(i):
    return ingest_report(ingest.catalogue(i.definitions(), "defs"))


@check("a9_scan_report", """
SELECT count(*) + 3 * count(*) FILTER (form = 'broken') AS files_found, count(*) FILTER (form <> 'broken') AS parsed,
  4 * count(*) FILTER (form = 'broken') AS failed FROM b_paths""")
def report_of_scan(i):
    """Found, parsed and failed among all files of a folder, those that cannot be read or have no text included."""
    return ingest_report(ingest.catalogue_scan(files.scan_all(i.spark, odd_files(i)), "defs"))


ARTIFACTS = r"""
SELECT flow_id, id, intent, '/vol/out/' || flow_id || '/' || intent || '/' || replace(replace(name, ' ', '_'), '/', '_') || '.py' AS artifact_ref,
  'Generated test notebook for ' || name || ' (' || intent || ')' AS patch_summary,
  md5(repeat('"', 3) || chr(10) || 'Flow: ' || flow_id || chr(10) || 'Processor: ' || name || chr(10) || 'Type: ' || type
   || chr(10) || 'Intent: ' || intent || chr(10) || repeat('"', 3) || chr(10) || chr(10) || chr(10)
   || 'def process_' || fn || '():' || chr(10) || '    print("' || flow_id || ': ' || name || '")' || chr(10)
   || '    return True' || chr(10) || chr(10) || chr(10) || 'result = process_' || fn || '()' || chr(10)) AS digest
FROM (SELECT *, replace(replace(name, ' ', '_'), '-', '_') AS fn FROM good) g"""


@check("c16_generated_artifacts", f"""WITH {GOOD}
SELECT flow_id, id, artifact_ref, patch_summary, digest FROM ({ARTIFACTS}) q""")
def generated(i):
    made = ingest.generated_artifacts(ingest.processors(i.definitions()), "/vol/out")
    return made.select("flow_id", "id", "artifact_ref", "patch_summary",
                       F.md5(F.col("content").cast("binary")).alias("digest"))


@check("u6_written_artifacts", f"""WITH {GOOD}
SELECT flow_id AS flow, intent, count(*) AS artifacts FROM good GROUP BY ALL""")
def written_artifacts(i):
    """Artifacts written as a table partitioned by flow, read back."""
    base = new_dir(i.spark, "artifacts")
    made = ingest.generated_artifacts(ingest.processors(i.definitions()), "/vol/out")
    files.write_artifacts(made.select(
        F.col("flow_id").alias("flow"), "intent", F.col("artifact_ref").alias("name"), "content"),
        base)
    return files.read_artifacts(i.spark, base).groupBy("flow", "intent").agg(
        F.count("*").alias("artifacts"))


@check("u6_artifact_contents", f"""WITH {GOOD}
SELECT flow_id AS flow, intent, artifact_ref AS name, digest FROM ({ARTIFACTS}) q""")
def artifact_contents(i):
    base = new_dir(i.spark, "artifacts")
    made = ingest.generated_artifacts(ingest.processors(i.definitions()), "/vol/out")
    files.write_artifacts(made.select(
        F.col("flow_id").alias("flow"), "intent", F.col("artifact_ref").alias("name"), "content"), base)
    return files.read_artifacts(i.spark, base).select(
        "flow", "intent", "name", F.md5(F.col("content").cast("binary")).alias("digest"))


# ------------------------------------------------------------------ legacy
@check("c9_legacy_flow_status", """
SELECT flow_name, CASE status WHEN 'CONVERTING' THEN 'RUNNING' WHEN 'NEEDS_ATTENTION' THEN 'NEEDS_HUMAN'
  ELSE status END AS status FROM b_legacy_flows""")
def flow_status(i):
    return i("b_legacy_flows").select("flow_name",
                                      legacy_flow_status(F.col("status")).alias("status"))


@check("c10_legacy_run_status", """
SELECT attempt_id, CASE WHEN status IN ('CREATING','RUNNING','SUCCESS','FAILED','CANCELLED') THEN status
  ELSE 'FAILED' END AS status FROM b_attempts""")
def run_status(i):
    return i("b_attempts").select("attempt_id", legacy_run_status(F.col("status")).alias("status"))


@check("c11_fallback_id", """
SELECT flow_name, md5(coalesce(replace(split_part(source_path, '/', -1), '.xml', ''), flow_name)) AS flow_id
FROM b_legacy_flows""")
def fallback(i):
    return i("b_legacy_flows").select("flow_name", migrate.fallback_id(
        F.col("source_path"), F.col("flow_name")).alias("flow_id"))


EPOCH = "CAST(CAST(epoch(start_ts) AS BIGINT) AS VARCHAR)"


@check("c12_keys_with_time", f"""
SELECT run_id, flow_id || '_run_' || {EPOCH} AS run_key, flow_id || '_attempt_' || {EPOCH} AS attempt_key,
  'Agent_' || flow_id || '_' || run_id || '_iter2_' || {EPOCH} AS agent_job,
  'Execute_' || flow_id || '_iter2_' || {EPOCH} AS execution_job,
  'Conversion_' || flow_id || '_' || {EPOCH} AS conversion_job FROM b_runs""")
def keys_with_time(i):
    flow, run, ts, two = F.col("flow_id"), F.col("run_id"), F.col("start_ts"), F.lit(2)
    return i("b_runs").select(
        "run_id", timing.run_key(flow, ts).alias("run_key"),
        timing.attempt_key(flow, ts).alias("attempt_key"),
        timing.agent_job_name(flow, run, two, ts).alias("agent_job"),
        timing.execution_job_name(flow, two, ts).alias("execution_job"),
        timing.conversion_job_name(flow, ts).alias("conversion_job"))


@check("c13_placeholder_event", """
SELECT run_id, 'Conversion ' || CASE status WHEN 'SUCCESS' THEN 'completed' WHEN 'FAILED' THEN 'failed'
    WHEN 'RUNNING' THEN 'in progress' ELSE lower(status) END || ' (migrated from old schema)' AS summary,
  CASE WHEN status IN ('FAILED','RUNNING') THEN status ELSE 'COMPLETED' END AS step_status,
  CASE WHEN status = 'FAILED' THEN 'Migrated from old schema - check original history for details' END AS error
FROM b_runs""")
def placeholder(i):
    return i("b_runs").select("run_id", placeholder_event(F.col("status")).alias("e")).select(
        "run_id", "e.*")


# --------------------------------------------------------------- text, time
@check("c16_safe_names", """
SELECT page_id, replace(replace(replace(url, ' ', '_'), '/', '_'), chr(92), '_') AS file_name,
  replace(replace(url, '-', '_'), ' ', '_') AS function_name FROM pages""")
def safe_names(i):
    return i("pages").select("page_id", text.safe_file_name(F.col("url")).alias("file_name"),
                             text.safe_function_name(F.col("url")).alias("function_name"))


@check("c17_paths", """
SELECT r.run_id, '/vol/logs/' || r.run_id || '/iter1' AS logs_path, '/vol/out/' || r.flow_id AS output_path
FROM b_runs r""")
def paths(i):
    return i("b_runs").select(
        "run_id", text.logs_path("/vol/logs", F.col("run_id"), F.lit(1)).alias("logs_path"),
        text.output_path("/vol/out", F.col("flow_id")).alias("output_path"))


@check("c18_comma_lists", """
SELECT doc_id, CAST(len(items) AS INT) AS items, md5(array_to_string(items, ',')) AS digest
FROM (SELECT doc_id, list_filter(list_transform(string_split(text, ','),
  lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS items FROM documents) q""")
def comma_lists(i):
    """Whole texts as comma lists: split, trimmed, without empty items, joined again."""
    listed = i("documents").select("doc_id", text.split_list(F.col("text")).alias("list"))
    return listed.select("doc_id", F.size("list").alias("items"),
                         F.md5(text.join_list(F.col("list")).cast("binary")).alias("digest"))


@check("c19_epoch_millis", """
SELECT event_id, ts AS moment FROM events""")
def epoch_millis(i):
    """Event times through epoch milliseconds and back, with the part below put back."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    back = timing.from_millis(F.floor(micros / 1000))
    exact = F.timestamp_micros(F.unix_micros(back) + micros % 1000)
    return i("events").select("event_id", exact.cast("timestamp_ntz").alias("moment"))


@check("c20_run_durations", """
SELECT run_id, CAST(epoch(end_ts) AS BIGINT) - CAST(epoch(start_ts) AS BIGINT) AS duration_s FROM b_runs""")
def durations(i):
    return i("b_runs").select(
        "run_id", timing.duration_seconds(F.col("start_ts"), F.col("end_ts")).alias("duration_s"))


@check("c21_history_texts", """
SELECT e.run_id, e.iteration_num, e.logs_ref, e.job_type, e.ts,
  CASE WHEN runtime_s IS NULL OR runtime_s = 0 THEN 'N/A'
    ELSE CAST(runtime_s // 60 AS VARCHAR) || 'm ' || CAST(runtime_s % 60 AS VARCHAR) || 's' END AS duration,
  coalesce(substr(nullif(error, ''), 1, 50), '-') AS error,
  coalesce(strftime(r.end_ts, '%Y-%m-%d %H:%M:%S'), 'In Progress') AS ended
FROM b_exec e JOIN b_runs r ON r.run_id = e.run_id""")
def history_texts(i):
    ends = i("b_runs").select("run_id", "end_ts")
    seconds = timing.duration_text(F.col("runtime_s"))
    return i("b_exec").join(ends, "run_id").select(
        "run_id", "iteration_num", "logs_ref", "job_type", "ts", seconds.alias("duration"),
        timing.short_error(F.col("error")).alias("error"),
        timing.time_text(F.col("end_ts"), "In Progress").alias("ended"))


@check("c21_run_duration_texts", """
SELECT run_id, CASE WHEN s IS NULL OR s = 0 THEN 'N/A'
  ELSE CAST(s // 60 AS VARCHAR) || 'm ' || CAST(s % 60 AS VARCHAR) || 's' END AS duration
FROM (SELECT run_id, CAST(epoch(end_ts) AS BIGINT) - CAST(epoch(start_ts) AS BIGINT) AS s FROM b_runs) q""")
def run_duration_texts(i):
    seconds = timing.duration_seconds(F.col("start_ts"), F.col("end_ts"))
    return i("b_runs").select("run_id", timing.duration_text(seconds).alias("duration"))


@check("c22_text_previews", """
SELECT doc_id, md5(CASE WHEN len(lines) > 50 THEN array_to_string(lines[1:50], chr(10)) || chr(10) || '... ('
  || CAST(len(lines) - 50 AS VARCHAR) || ' more lines)' ELSE text END) AS digest
FROM (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents) q""")
def previews(i):
    return i("documents").select(
        "doc_id", F.md5(text.preview(F.col("text")).cast("binary")).alias("digest"))


@check("c23_json_with_fallback", """
SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), -1) AS k FROM events""")
def json_values(i):
    fallback = F.struct(F.lit(-1).cast("long").alias("k"))
    parsed = text.parse_json(F.col("props"), "k bigint", fallback)
    return i("events").select("event_id", parsed["k"].alias("k"))


@check("c23_json_of_any_text", """
SELECT doc_id, -1 AS severity FROM documents
UNION ALL SELECT CAST(run_id AS BIGINT), CAST(json_extract(findings_json, '$.severity') AS INT) FROM b_scans""")
def json_of_any_text(i):
    """Findings and plain prose alike: prose is no JSON and takes the fallback."""
    every = i("documents").select("doc_id", "text").unionByName(
        i("b_scans").select(F.col("run_id").cast("long").alias("doc_id"),
                            F.col("findings_json").alias("text")))
    fallback = F.struct(F.lit(-1).alias("severity"))
    return every.select("doc_id", text.parse_json(
        F.col("text"), "severity int", fallback)["severity"].alias("severity"))
