"""Numbering that stays even when one key, or one row, fills much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WRITTEN_TOGETHER = 100_000   # numbers that one row holds while copies are written out


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, start: int = 1,
    unique: bool = False,
) -> DataFrame:
    """Consecutive numbers per key in ``order`` (total but for equal rows).

    Equal rows are counted, the distinct ones are sorted by key and order over a
    fixed number of ranges, summed up within a range and shifted by the rows of their
    key in earlier ranges. So a key, whatever its share, is numbered by many tasks, and
    copies are written out in parts. NULL keys are keys like any other.

    ``unique``: the table has a key of its own, so no row is repeated by a share of all; then rows are
    not counted first. Rows that are equal after all get numbers of their own as well.

    Both uses of the ranges read one shuffle (Spark reuses the exchange; its number
    of partitions is given, so they are not merged differently).
    """
    keys, order = list(keys), list(order)
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*keys)
    counted = df if unique else df.groupBy(*df.columns).agg(F.count("*").alias("_copies"))
    ranges = (
        counted.repartitionByRange(partitions, *keys, *order)
        .withColumns({"_range": F.spark_partition_id(), "_key": key})
    )
    earlier = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_key", "_range").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    # a row per key and range: one, but for keys that reach over several ranges
    rows = F.count("*") if unique else F.sum("_copies")
    shifts = (
        ranges.groupBy("_key", "_range").agg(rows.alias("_rows"))
        .select("_key", "_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    )
    if unique:
        within = Window.partitionBy("_key", "_range").orderBy(*order)
        return ranges.withColumn("_inside", F.row_number().over(within)).join(shifts, ["_key", "_range"]).select(
            *df.columns, (F.col("_before") + F.col("_inside") + F.lit(start - 1)).cast("bigint").alias(name))
    last_part = F.floor((F.col("_copies") - 1) / WRITTEN_TOGETHER)
    parts = (
        ranges.withColumn("_inside", F.coalesce(F.sum("_copies").over(inside), F.lit(0)))
        .join(shifts, ["_key", "_range"])
        .withColumn("_first", F.col("_before") + F.col("_inside") + F.lit(start))
        .withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), last_part)))
    )
    begin = F.col("_first") + F.col("_part") * WRITTEN_TOGETHER
    end = F.least(begin + WRITTEN_TOGETHER, F.col("_first") + F.col("_copies")) - 1
    return parts.select(*df.columns, F.explode(F.sequence(begin, end)).alias(name))
