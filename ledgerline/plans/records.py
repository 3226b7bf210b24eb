"""Definition files of any size: parsed in a stream on the executors, a record for each part.

A file is never one value: a task reads it in blocks and hands on what has ended. For files
that fit a value ``plans.ingest`` does the same from their texts.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.records import Document
from ledgerline.functions.text import fill, flow_name_of, intent_of, server_of
from ledgerline.plans.ingest import NO_ID, PARSE_ERROR
from ledgerline.schemas import DEFINITION_ROOTS
from ledgerline.session import qualified, resolved
from ledgerline.sources.listing import hidden, listed_files, opened

# executors get these functions themselves, so they need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 1 << 20              # bytes of a file that are read at once
RECORDS = 1_000              # of one Arrow batch
RECORD = "path string, kind string, place long, id string, name string, type string, note string, error string"
_FIELDS = [pair.split()[0] for pair in RECORD.split(", ")]
_KIND = pa.schema([(n, pa.int64() if n == "place" else pa.string()) for n in _FIELDS])


def parts_of(path: str, source, block: int = BLOCK) -> Iterator[tuple]:
    """Records of one open file; the last, of kind ``document``, tells of the whole."""
    document, error = Document(), None
    try:
        while True:
            data = source.read(block)
            document.feed(data, not data)
            for kind, found in (("processor", document.processors), ("group", document.groups)):
                for place, key, name, *kind_of in found:
                    yield path, kind, place, key, name, kind_of[0] if kind_of else None, None, None
                found.clear()
            if not data:
                break
    except (ValueError, OSError) as problem:
        error = str(problem)
    yield path, "document", 0, document.flow_id if error is None else None, document.root, None, document.description, error


def records(spark: SparkSession, folder: str, ending: str = ".xml") -> DataFrame:
    """RECORD rows of every file below a folder whose name ends so, but for hidden and empty ones.

    Kind ``processor`` and ``group`` have ``place`` in their document, ``id``, ``name`` and ``type``;
    ``document`` has the flow id as ``id``, the root as ``name``, the description as ``note``, or the
    ``error`` that ended it: parts of such a file do not count. Files are dealt out one by one.
    """
    base, root = qualified(spark, folder).rstrip("/"), resolved(spark, folder).rstrip("/")
    listed = listed_files(spark, folder, ending).filter(
        (F.col("state") != "file") | ((F.col("length") > 0) & ~hidden(F.col("path"), base)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = opened(root)
        rows: list[tuple] = []
        for batch in batches:
            for path, state, error in zip(*(batch.column(c).to_pylist() for c in ("path", "state", "error"))):
                if state != "file":
                    rows.append((path, "document", 0, None, None, None, None, f"{state}: {error}"))
                    continue
                try:
                    with system.open_input_stream(top.rstrip("/") + path[len(base):]) as source:
                        for row in parts_of(path, source):
                            rows.append(row)
                            if len(rows) >= RECORDS:
                                yield _batch(rows)
                                rows = []
                except OSError as problem:
                    rows.append((path, "document", 0, None, None, None, None, f"unreadable: {problem}"))
        yield _batch(rows)

    spread = listed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("path", "length"))
    return spread.select("path", "state", "error").mapInArrow(read, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_KIND)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _KIND)], schema=_KIND)


def _of_read_documents(found: DataFrame, kind: str) -> DataFrame:
    """Parts of one kind with the flow id of their document, if that was read to its end."""
    whole = found.filter("kind = 'document' AND error IS NULL").select("path", F.col("id").alias("flow_id"))
    return found.filter(F.col("kind") == kind).select("path", "place", "id", "name", "type").join(whole, "path")


def processors(found: DataFrame) -> DataFrame:
    """The rows of ``ingest.processors``, from records."""
    return _of_read_documents(found, "processor").select(
        "path", "flow_id", "id", "name", "type", intent_of(F.col("type")).alias("intent"))


def groups(found: DataFrame) -> DataFrame:
    """Process groups of every file that could be read (path, place, group_id, group_name); one without any is one flow."""
    named = _of_read_documents(found, "group").select(
        "path", F.col("place").cast("int"), F.col("id").alias("group_id"), F.col("name").alias("group_name"))
    whole = found.filter("kind = 'document' AND error IS NULL").select("path").join(
        named.select("path"), "path", "left_anti")
    return named.unionByName(whole.select(
        "path", F.lit(0).alias("place"), F.lit("main_flow").alias("group_id"), F.lit("Main Flow").alias("group_name")))


def catalogue(found: DataFrame, volume: str) -> DataFrame:
    """One row per file: id, name, server, description, whether it is valid, and what is wrong."""
    error = F.when(F.col("error").isNotNull(), fill(PARSE_ERROR, error=F.col("error"))).when(F.col("id").isNull(), NO_ID)
    return found.filter("kind = 'document'").select(
        "path", F.col("id").alias("flow_id"), flow_name_of(F.col("path")).alias("flow_name"),
        server_of(F.col("path"), volume).alias("server"), F.col("note").alias("description"),
        (F.col("error").isNull() & F.coalesce(F.col("name").isin(DEFINITION_ROOTS), F.lit(False))).alias("valid"),
        error.alias("error"))
