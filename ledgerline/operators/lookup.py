"""Lookups, identifier resolution, searches and status predicates."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.status import allowed_action, can_start, progress_text


def by_id(table: DataFrame, key: str, value: str) -> DataFrame:
    return table.filter(F.col(key) == F.lit(value))


def by_name(flows: DataFrame, name: str) -> DataFrame:
    """The flow of that name; the lowest flow_id when names repeat."""
    return flows.filter(F.col("flow_name") == F.lit(name)).orderBy("flow_id").limit(1)


def first_per_name(flows: DataFrame) -> DataFrame:
    """flow_name → lowest flow_id, the set-wise form of ``by_name``."""
    return flows.groupBy("flow_name").agg(F.min("flow_id").alias("flow_id"))


def identifiers(flows: DataFrame, *facts: str) -> DataFrame:
    """Every text that names a flow, once, with the flow's id and the given columns.

    An id wins over a name; of equal names the lowest flow_id counts.
    """
    ways = F.array(F.struct(F.col("flow_id").alias("identifier"), F.lit(0).alias("_way")),
                   F.struct(F.col("flow_name").alias("identifier"), F.lit(1).alias("_way")))
    named = flows.select(F.struct("flow_id", *facts).alias("_flow"), F.inline(ways))
    picked = named.groupBy("identifier").agg(
        F.min_by("_flow", F.struct("_way", "_flow.flow_id")).alias("_flow"))
    return picked.select("identifier", "_flow.*")


def resolve(requests: DataFrame, flows: DataFrame) -> DataFrame:
    """Each requested identifier with its flow_id: as an id first, then as a name.

    Unresolved identifiers keep a NULL flow_id; repeats and positions stay.
    """
    return requests.join(identifiers(flows), "identifier", "left")


def resolved(requests: DataFrame, flows: DataFrame) -> DataFrame:
    """Only the identifiers that name a flow."""
    return resolve(requests, flows).filter(F.col("flow_id").isNotNull())


def unresolved(requests: DataFrame, flows: DataFrame) -> DataFrame:
    return resolve(requests, flows).filter(F.col("flow_id").isNull()).drop("flow_id")


def search(flows: DataFrame, query: str | None = None, status: str | None = None,
           server: str | None = None) -> DataFrame:
    """Name contains ``query`` (``%`` and ``_`` are wildcards) and status and server equal.

    Terms that are absent or empty drop out.
    """
    terms = [F.lit(True)]
    if query:
        terms.append(F.col("flow_name").like(f"%{query}%"))
    if status:
        terms.append(F.col("status") == status)
    if server:
        terms.append(F.col("server") == server)
    return flows.filter(reduce(and_, terms))


def among(table: DataFrame, key: str, values: Iterable[str] | DataFrame) -> DataFrame:
    """Rows whose key is in a short list, or in the key column of a table."""
    if isinstance(values, DataFrame):
        return table.join(values.select(key).distinct(), key, "left_semi")
    return table.filter(F.col(key).isin(list(values)))


def free_text(snapshot: DataFrame, query: str) -> DataFrame:
    """Rows of the status list whose shown text contains ``query``, any case."""
    shown = F.concat_ws(
        " ", "flow_name", F.coalesce("server", F.lit("N/A")), F.coalesce("owner", F.lit("N/A")),
        "status", progress_text(F.col("current_summary"), F.col("current_step")),
        F.coalesce("current_iteration", F.lit(0)).cast("string"),
        F.coalesce("step_status", F.lit("-")),
    )
    return snapshot.filter(F.contains(F.lower(shown), F.lit(query.lower())))


def startable(flows: DataFrame) -> DataFrame:
    return flows.select(
        "flow_id", "status", can_start(F.col("status")).alias("can_start"),
        allowed_action(F.col("status")).alias("action"))


def artifacts_of_iteration(artifacts: DataFrame, iterations: DataFrame) -> DataFrame:
    """Artifacts written in the given (run_id, iteration_num) pairs."""
    wanted = iterations.select("run_id", "iteration_num").distinct()
    return artifacts.join(wanted, ["run_id", "iteration_num"], "left_semi")
