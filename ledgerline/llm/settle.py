"""Intermediate tables."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from ledgerline.session import new_dir

ROWS_A_FILE = 250_000        # of a narrow table


def settled(df: DataFrame, label: str, rows: int | None = None, a_file: int = ROWS_A_FILE) -> DataFrame:
    """``df``, written once to the shared folder of the session and read again.

    Cuts the lineage: a lost executor costs no recomputation, and every later use reads
    the same rows, from a short plan. The folder lies below ``spark.checkpoint.dir``, whose owner
    clears it. For what is large, dear to make, made in a loop, or used a few times.

    ``rows``: a count that was taken and that a narrow table cannot exceed; it gets a file, and
    its last step a task, for every ``a_file`` of them at the fewest: less where that step reads more.
    """
    if rows is not None:
        df = df.coalesce(1 + rows // a_file)
    path = new_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def let_go(spark: SparkSession) -> None:
    """Have the driver give up what finished work left: plans, and with them broadcasts and shuffles.

    Spark's cleaner drops those of objects that the JVM has collected, and by itself asks for a
    collection every half hour only; a JVM object stays as long as Python holds it. For between
    the stages of a long job.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
