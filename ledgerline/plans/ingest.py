"""Definition files to flows: catalogue, processors, generated artifacts, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.definition import parse_definition, process_groups, validity
from ledgerline.functions.text import (
    artifact_path, artifact_text, fill, flow_name_of, intent_of, server_of,
)
from ledgerline.operators.changes import upsert

# messages
PARSE_ERROR = "XML parse error: {error}"
NO_ID = "No groupId element or rootGroup id attribute found in XML"
GENERATED = "Generated test notebook for {name} ({intent})"

INGEST_UPDATE = ["flow_name", "status", "server", "source_path", "description", "priority",
                 "owner"]


def parsed_files(files: DataFrame) -> DataFrame:
    """Files (path, content) with the facts of one parse each."""
    return files.select("path", parse_definition(F.col("content")).alias("parsed"))


def catalogue(files: DataFrame, volume: str) -> DataFrame:
    """One row per file: id, name, server, description, validity; errors stay visible."""
    parsed = F.col("parsed")
    check = validity(parsed)
    return parsed_files(files).select(
        "path", parsed["flow_id"].alias("flow_id"), flow_name_of(F.col("path")).alias("flow_name"),
        server_of(F.col("path"), volume).alias("server"),
        parsed["description"].alias("description"),
        check["valid"].alias("valid"), check["message"].alias("message"),
        F.when(parsed["error"].isNotNull(), fill(PARSE_ERROR, error=parsed["error"]))
        .when(parsed["flow_id"].isNull(), NO_ID).alias("error"),
    )


def catalogue_scan(scanned: DataFrame, volume: str) -> DataFrame:
    """``catalogue`` of a scan (see ``files.scan_all``): what has no text has its state as error."""
    found = catalogue(scanned.filter("state = 'text'").select("path", "content"), volume)
    passed = scanned.filter("state <> 'text'").select(
        "path", F.lit(False).alias("valid"), F.concat_ws(": ", "state", "error").alias("error"))
    return found.unionByName(passed, allowMissingColumns=True)


def processors(files: DataFrame) -> DataFrame:
    """One row per processor with its intent; a document's id is its flow."""
    each = parsed_files(files).select(
        "path", F.col("parsed.flow_id").alias("flow_id"),
        F.explode("parsed.processors").alias("p"))
    return each.select("path", "flow_id", "p.id", F.nullif("p.name", F.lit("")).alias("name"),
                       "p.type", intent_of(F.col("p.type")).alias("intent"))


def groups(files: DataFrame) -> DataFrame:
    """Process groups of every readable file, in document order."""
    readable = parsed_files(files).filter(F.col("parsed.error").isNull())
    return readable.select(
        "path", F.posexplode(process_groups(F.col("parsed"))).alias("place", "g")).select(
        "path", "place", F.col("g.id").alias("group_id"), F.col("g.name").alias("group_name"),
        F.when(F.col("g.id") == "main_flow", "Main flow").otherwise(
            F.concat(F.lit("process group: "), F.col("g.id"))).alias("description"))


def new_flows(catalogued: DataFrame) -> DataFrame:
    """Catalogue rows with an id, as rows to register."""
    nothing = F.lit(None).cast("string")
    return catalogued.filter(F.col("flow_id").isNotNull()).select(
        "flow_id", "flow_name", F.lit("NOT_STARTED").alias("status"), "server",
        F.col("path").alias("source_path"), "description", nothing.alias("priority"),
        nothing.alias("owner"))


def ingest(flows: DataFrame, catalogued: DataFrame, as_of: Column,
           update: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Flows after registering the catalogue.

    By default a flow that is found again starts over (its status is among the
    updated columns) and keeps its current run; pass ``update`` to change that.
    Two files with one id are an error, unless ``order`` says which is last.
    """
    return upsert(flows, new_flows(catalogued), ["flow_id"], update or INGEST_UPDATE,
                  INGEST_UPDATE, {"updated_ts": as_of}, order)


def generated_artifacts(procs: DataFrame, base: str) -> DataFrame:
    """Path, text and summary of the artifact of every processor."""
    flow, name, kind, intent = (F.col(c) for c in ("flow_id", "name", "type", "intent"))
    return procs.select(
        "flow_id", "id", "intent",
        artifact_path(F.lit(base), flow, intent, name).alias("artifact_ref"),
        artifact_text(flow, name, kind, intent).alias("content"),
        fill(GENERATED, name=name, intent=intent).alias("patch_summary"))
