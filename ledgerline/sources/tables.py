"""Reading tables and aligning them to their schemas."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, source: str, limit: int | None = None) -> DataFrame:
    """A whole table by catalog name or Parquet path; 0 or None means no limit."""
    df = spark.read.parquet(source) if "/" in source else spark.table(source)
    return df.limit(limit) if limit else df


def keep_by_key(df: DataFrame, name: str, path: str, key: str = "run_id", buckets: int = 64) -> DataFrame:
    """``df`` as a catalog table, bucketed and sorted by ``key``.

    Tables with one number of buckets meet by key without a shuffle, and rows of a key are ranked
    or grouped where they lie. One file a bucket: the rows are dealt as the buckets are.
    """
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
     .option("path", path).saveAsTable(name))
    return df.sparkSession.table(name)


def with_own_names(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename the columns of a ledger written elsewhere to the names used here.

    ``names`` is the caller's: their column to ours. Columns that are not there are
    passed over; a name that the table has already, or that two columns would get, is an error.
    """
    used = {theirs: own for theirs, own in names.items() if theirs in df.columns}
    result = [used.get(c, c) for c in df.columns]
    twice = sorted({c for c in result if result.count(c) > 1})
    if twice:
        raise ValueError(f"columns named twice: {', '.join(twice)}")
    return df.withColumnsRenamed(used)


def conform(df: DataFrame, schema: T.StructType, defaults: Mapping[str, object] | None = None
            ) -> DataFrame:
    """The columns of ``schema`` in order; an absent column gets its default.

    A column that is present keeps its NULLs.
    """
    defaults, have = defaults or {}, set(df.columns)
    columns = []
    for field in schema.fields:
        if field.name in have:
            value = F.col(field.name)
        elif isinstance(defaults.get(field.name), (list, tuple)):
            value = F.array(*[F.lit(v) for v in defaults[field.name]])
        else:
            value = F.lit(defaults.get(field.name))
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)


# Defaults of the old flow record
LEGACY_DEFAULTS = {
    "status": "NOT_STARTED", "progress_percentage": 0, "iterations": 0,
    "validation_percentage": 0, "total_attempts": 0, "successful_conversions": 0,
    "generated_artifacts": [],
}
