"""Integrity checks: what the declared keys, domains and links would forbid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.joins import count_orphans
from ledgerline.schemas import DOMAINS, KEYS, LINKS, TABLES


def duplicate_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.groupBy(*keys).agg(F.count("*").alias("count")).filter(F.col("count") > 1)


def duplicate_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table: keys used more than once and the rows beyond the first."""
    parts = [
        duplicate_keys(df, KEYS[name])
        .agg(F.count("*").alias("duplicate_keys"),
             F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("surplus_rows"))
        .select(F.lit(name).alias("table_name"), "duplicate_keys", "surplus_rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def domain_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Values outside the documented lists, with their counts."""
    parts = []
    for (name, column), allowed in DOMAINS.items():
        if name in tables:
            bad = tables[name].filter(~F.col(column).isin(allowed))
            parts.append(
                bad.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows"))
                .select(F.lit(name).alias("table_name"), F.lit(column).alias("column_name"),
                        "value", "rows"))
    return reduce(DataFrame.unionByName, parts)


def null_counts(table: DataFrame, name: str) -> DataFrame:
    """NULLs in each required column: one pass over the table, then one row per column."""
    required = [f.name for f in TABLES[name].fields if not f.nullable]
    counted = table.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    return counted.unpivot([], required, "column_name", "null_rows").select(
        F.lit(name).alias("table_name"), "column_name", "null_rows")


def null_report(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [null_counts(df, n) for n, df in tables.items()])


def link_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Child rows without a parent, for every link of the schema."""
    parts = [
        count_orphans(tables[child], tables[parent], key, parent_key).select(
            F.lit(child).alias("child"), F.lit(key).alias("child_column"),
            F.lit(parent).alias("parent"), "orphan_count")
        for child, key, parent, parent_key in LINKS if child in tables and parent in tables
    ]
    return reduce(DataFrame.unionByName, parts)
