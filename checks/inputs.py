"""Ledger tables derived from the given Parquet tables, for checks and the entry point.

Each view is one SQL text that runs on Spark and on DuckDB alike (``b_flows`` has a second form
of its newest run for Spark), so a query and its plain-SQL check start from the same rows.
Nothing is sampled or cut.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
       "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

AS_OF = "TIMESTAMP '2003-01-01 00:00:00'"

VIEWS = {
    "b_runs": """
SELECT CAST(o_orderkey AS STRING) AS run_id,
       CAST(o_custkey AS STRING) AS flow_id,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey + 1000000 AS STRING) END AS job_run_id,
       o_orderdate AS start_ts,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate + INTERVAL 1 SECOND * (o_orderkey % 9000) END AS end_ts,
       CASE o_orderstatus WHEN 'O' THEN 'SUCCESS' WHEN 'F' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'CANCELLED' ELSE 'FAILED' END
            ELSE CASE o_orderkey % 3 WHEN 0 THEN 'CREATING' WHEN 1 THEN 'QUEUED' ELSE 'RUNNING' END END AS status
FROM orders""",
    "b_flows": """
SELECT CAST(c.c_custkey AS STRING) AS flow_id,
       c.c_name AS flow_name,
       CASE c.c_mktsegment WHEN 'MACHINERY' THEN 'NOT_STARTED' WHEN 'BUILDING' THEN 'RUNNING'
            WHEN 'AUTOMOBILE' THEN 'NEEDS_HUMAN' WHEN 'FURNITURE' THEN 'DONE'
            ELSE CASE WHEN c.c_custkey % 2 = 0 THEN 'FAILED' ELSE 'STOPPED' END END AS status,
       CASE WHEN c.c_mktsegment = 'MACHINERY' THEN NULL ELSE r.run_id END AS current_run_id,
       r.start_ts AS updated_ts,
       n.n_name AS server,
       CASE WHEN c.c_custkey % 10 = 0 THEN NULL ELSE '/vol/defs/' || n.n_name || '/' || c.c_name || '.xml' END AS source_path,
       CASE WHEN c.c_custkey % 4 = 0 THEN NULL ELSE 'segment ' || c.c_mktsegment END AS description,
       CASE c.c_custkey % 4 WHEN 0 THEN 'P0' WHEN 1 THEN 'P1' WHEN 2 THEN 'P2' ELSE NULL END AS priority,
       c.c_mktsegment AS owner
FROM customer c
JOIN nation n ON n.n_nationkey = c.c_nationkey
LEFT JOIN (SELECT run_id, flow_id, start_ts,
                  row_number() OVER (PARTITION BY flow_id ORDER BY start_ts DESC, CAST(run_id AS BIGINT) DESC) AS rn
           FROM b_runs) r ON r.flow_id = CAST(c.c_custkey AS STRING) AND r.rn = 1""",
    "b_iterations": """
SELECT CAST(l_orderkey AS STRING) AS run_id,
       l_linenumber AS iteration_num,
       CASE l_returnflag WHEN 'A' THEN 'agent_generate' WHEN 'R' THEN 'agent_fix_errors' ELSE 'execute_notebooks' END AS step,
       CASE WHEN l_linestatus = 'O' THEN 'COMPLETED' WHEN l_partkey % 4 = 0 THEN 'RUNNING' ELSE 'FAILED' END AS step_status,
       l_shipdate AS ts,
       CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE 'supplier ' || CAST(l_suppkey AS STRING) END AS summary,
       CASE WHEN l_linestatus = 'F' AND l_partkey % 4 <> 0 THEN 'error on part ' || CAST(l_partkey AS STRING) END AS error,
       l_partkey * 100000 + l_suppkey AS event_seq
FROM lineitem""",
    "b_patches": """
SELECT CAST(l_orderkey AS STRING) AS run_id,
       l_linenumber AS iteration_num,
       '/vol/out/part_' || CAST(l_partkey AS STRING) || '.py' AS artifact_ref,
       'patched by ' || CAST(l_suppkey AS STRING) AS patch_summary,
       CAST(NULL AS STRING) AS diff_ref,
       l_shipdate AS ts
FROM lineitem WHERE l_returnflag <> 'N'""",
    "b_scans": """
SELECT CAST(l_orderkey AS STRING) AS run_id,
       l_linenumber AS iteration_num,
       '/vol/out/part_' || CAST(l_partkey AS STRING) || '.py' AS artifact_ref,
       CASE WHEN l_quantity < 5 THEN 'BLOCKED' WHEN l_quantity < 10 THEN 'SCANNING' WHEN l_quantity < 15 THEN 'PENDING' ELSE 'PASSED' END AS scan_status,
       '{"severity":' || CAST(CAST(l_quantity AS INT) AS STRING) || ',"rule":"R' || CAST(l_suppkey AS STRING) || '"}' AS findings_json,
       l_shipdate AS ts
FROM lineitem WHERE l_returnflag = 'R'""",
    "b_exec": """
SELECT CAST(l_orderkey AS STRING) AS run_id,
       l_linenumber AS iteration_num,
       CASE WHEN l_partkey % 2 = 0 THEN 'flow_job' ELSE 'validation_job' END AS job_type,
       CASE WHEN l_linestatus = 'O' THEN 'SUCCESS' WHEN l_quantity > 45 THEN 'TIMEOUT' ELSE 'FAILED' END AS status,
       CAST(l_quantity AS INT) * 100 AS runtime_s,
       CASE WHEN l_linestatus = 'F' THEN 'failed on part ' || CAST(l_partkey AS STRING) END AS error,
       '/vol/logs/' || CAST(l_orderkey AS STRING) || '/iter' || CAST(l_linenumber AS STRING) AS logs_ref,
       l_shipdate AS ts
FROM lineitem WHERE l_returnflag = 'N'""",
    "b_human": """
SELECT run_id, iteration_num,
       CASE step WHEN 'agent_generate' THEN 'agent_job_failed' WHEN 'agent_fix_errors' THEN 'max_iterations_reached' ELSE 'orchestration_error' END AS reason,
       'see ' || step AS instructions,
       CASE WHEN event_seq % 3 = 0 THEN 'RESOLVED' WHEN event_seq % 3 = 1 THEN 'IGNORED' ELSE 'PENDING' END AS status,
       ts
FROM b_iterations WHERE step_status = 'FAILED'""",
    "b_job_state": """
SELECT job_run_id, run_id,
       CASE CAST(run_id AS BIGINT) % 6 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'INTERNAL_ERROR' ELSE 'TERMINATED' END AS life_cycle_state,
       CASE CAST(run_id AS BIGINT) % 6 WHEN 3 THEN 'SUCCESS' WHEN 4 THEN 'FAILED' WHEN 5 THEN 'CANCELED' END AS result_state,
       CASE WHEN CAST(run_id AS BIGINT) % 6 = 4 AND CAST(run_id AS BIGINT) % 4 <> 0 THEN 'task failed in ' || run_id END AS state_message,
       CAST(NULL AS STRING) AS poll_error
FROM b_runs WHERE job_run_id IS NOT NULL""",
    # positions keep the list order without numbering all rows in one task
    "b_requests": """
SELECT k * 10 + kind AS pos, identifier
FROM (SELECT c_custkey AS k, 1 AS kind, CAST(c_custkey AS STRING) AS identifier FROM customer WHERE c_custkey % 3 = 0
      UNION ALL SELECT c_custkey, 2, c_name FROM customer WHERE c_custkey % 5 = 0
      UNION ALL SELECT c_custkey, 3, 'missing-' || CAST(c_custkey AS STRING) FROM customer WHERE c_custkey % 7 = 0
      UNION ALL SELECT c_custkey, 4, c_name FROM customer WHERE c_custkey % 15 = 0) q""",
    # forty processors a document, so a document stays small however many parts there are
    "b_processors": """
SELECT CAST(p_partkey AS STRING) AS id,
       p_name AS name,
       'org.x.' || CASE p_type WHEN 'ECONOMY' THEN 'GetFile' WHEN 'PROMO' THEN 'ReplaceText' WHEN 'MEDIUM' THEN 'RouteOnAttribute'
            WHEN 'SMALL' THEN 'PutFile' WHEN 'LARGE' THEN 'LogMessage' ELSE 'Custom' || CAST(p_size AS STRING) END AS type,
       'Def#' || CAST(CAST(floor(p_partkey / 40) AS BIGINT) AS STRING) AS flow_id
FROM part""",
    "b_paths": """
SELECT flow_id,
       '/vol/defs/' || CASE WHEN flow_id LIKE '%1' OR flow_id LIKE '%4' THEN 'prod/sub/' WHEN flow_id LIKE '%2' THEN 'dev/' ELSE '' END || flow_id || '.xml' AS path,
       CASE WHEN flow_id LIKE '%5' THEN 'broken' WHEN flow_id LIKE '%4' THEN 'controller' ELSE 'template' END AS form
FROM (SELECT DISTINCT flow_id FROM b_processors) d""",
    "b_legacy_flows": """
SELECT flow_name, server, source_path, description, priority, owner,
       CASE status WHEN 'RUNNING' THEN 'CONVERTING' WHEN 'NEEDS_HUMAN' THEN 'NEEDS_ATTENTION' ELSE status END AS status,
       current_run_id AS current_attempt_id, flow_id AS old_id
FROM b_flows""",
    "b_legacy_attempts": """
SELECT r.run_id AS attempt_id,
       CASE WHEN CAST(r.run_id AS BIGINT) % 13 = 0 THEN 'gone-' || r.run_id ELSE f.flow_name END AS flow_name,
       r.job_run_id AS job_id, r.status, r.start_ts AS started_at, r.end_ts AS completed_at
FROM b_runs r JOIN b_flows f ON f.flow_id = r.flow_id""",
    "b_attempts": """
SELECT run_id AS attempt_id, 'Customer#' || lpad(flow_id, 9, '0') AS flow_name,
       job_run_id AS job_id, status, start_ts AS started_at, end_ts AS completed_at
FROM b_runs""",
    "b_calls": """
SELECT i.run_id, r.flow_id, f.flow_name, f.source_path, i.iteration_num,
       CASE WHEN i.summary IS NULL THEN '' ELSE '/vol/logs/' || i.run_id END AS logs_path, i.event_seq
FROM b_iterations i
JOIN b_runs r ON r.run_id = i.run_id
LEFT JOIN b_flows f ON f.flow_id = r.flow_id AND f.status <> 'DONE'""",
    "b_events": """
SELECT CAST(user_id AS STRING) AS run_id, 1 AS iteration_num, event_type AS step,
       CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'RUNNING' ELSE 'COMPLETED' END AS step_status,
       ts, CAST(NULL AS STRING) AS summary, CAST(NULL AS STRING) AS error, event_id AS event_seq
FROM events""",
}

#: The window of b_flows reads all runs in order; Spark takes the newest of each flow by a grouping,
#: whose rows are told to be one a flow, so that a query without columns of the run needs no join.
_BY_ORDER = """(SELECT run_id, flow_id, start_ts,
                  row_number() OVER (PARTITION BY flow_id ORDER BY start_ts DESC, CAST(run_id AS BIGINT) DESC) AS rn
           FROM b_runs) r ON r.flow_id = CAST(c.c_custkey AS STRING) AND r.rn = 1"""
_BY_GROUP = """(SELECT flow_id, newest.run_id, newest.start_ts
           FROM (SELECT flow_id, max(struct(start_ts, CAST(run_id AS BIGINT) AS number, run_id)) AS newest
                 FROM b_runs GROUP BY flow_id) q) r ON r.flow_id = CAST(c.c_custkey AS STRING)"""
ON_SPARK = VIEWS | {"b_flows": VIEWS["b_flows"].replace(_BY_ORDER, _BY_GROUP)}

_NAMES = re.compile(r"\b(b_[a-z_]+)\b")


def closure(text: str) -> list[str]:
    """Views a text needs, those they need first."""
    wanted: list[str] = []

    def add(sql: str) -> None:
        for name in _NAMES.findall(sql):
            if name in VIEWS and name not in wanted:
                add(VIEWS[name])
                if name not in wanted:
                    wanted.append(name)

    add(text)
    return wanted


def with_views(body: str) -> str:
    """A DuckDB text with the views it needs in front; ``body`` may begin with WITH."""
    parts = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in closure(body))
    body = body.strip()
    if not parts:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {parts},\n{body[5:]}"
    return f"WITH {parts}\n{body}"


_raw: dict[tuple[str, str], DataFrame] = {}


def raw_table(spark: SparkSession, path: str) -> DataFrame:
    """A given table; its schema is read once per application."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _raw:
        _raw[key] = spark.read.parquet(path)
    return _raw[key]


class Inputs:
    """The given tables and the views over them in one session."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.folder = spark, folder
        self._known: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._known:
            self._known[name] = self._read(name)
        return self._known[name]

    def _read(self, name: str) -> DataFrame:
        if name in RAW:
            return raw_table(self.spark, f"{self.folder}/{name}.parquet")
        text = ON_SPARK[name]
        needed = [raw for raw in RAW if re.search(rf"\b{raw}\b", text)]
        for other in needed + [view for view in _NAMES.findall(text) if view in VIEWS]:
            self(other).createOrReplaceTempView(other)
        return self.spark.sql(text)

    def ledger(self) -> dict[str, DataFrame]:
        names = {"flows": "b_flows", "runs": "b_runs", "events": "b_iterations",
                 "artifacts": "b_patches", "scans": "b_scans", "executions": "b_exec",
                 "requests": "b_human"}
        return {table: self(view) for table, view in names.items()}

    def definitions(self) -> DataFrame:
        """Definition files (path, content): one document per forty processors."""
        element = F.concat(
            F.lit("<processor><id>"), F.col("id"), F.lit("</id><name>"), F.col("name"),
            F.lit("</name><class>"), F.col("type"), F.lit("</class></processor>"))
        bodies = self("b_processors").groupBy("flow_id").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(
                F.struct(F.col("id").cast("long").alias("k"), element.alias("x")))),
                lambda e: e["x"]), "").alias("body"))
        files = self("b_paths").join(bodies, "flow_id")
        key, body = F.col("flow_id"), F.col("body")
        content = (
            F.when(F.col("form") == "broken",
                   F.concat(F.lit("<template><groupId>"), key, F.lit("</template>")))
            .when(F.col("form") == "controller", F.concat(
                F.lit('<flowController><rootGroup id="'), key, F.lit('"><processGroup id="g-'),
                key, F.lit('"><name>group '), key, F.lit("</name>"), body,
                F.lit("</processGroup><processGroup><name/></processGroup>"
                      "</rootGroup></flowController>")))
            .otherwise(F.concat(
                F.lit("<template><description>defs of "), key, F.lit("</description><groupId> "),
                key, F.lit(" </groupId><snippet>"), body, F.lit("</snippet></template>")))
        )
        return files.select("flow_id", "path", content.alias("content"))
