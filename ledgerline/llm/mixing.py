"""Mixing sources to target weights by distributed prefix sums over hash-random keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.settle import settled

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3              # a source is taken at most so many times
SEED = "mix-1"
BUCKETS_PER_PARTITION = 4    # ranges of keys for each shuffle partition


def n_words(text: str) -> Column:
    """Number of words of a text; 0 for a null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """``source``, ``source_size``, ``target`` from one row ``source, source_size`` per source.

    Sources weigh ``weights`` in turn, by code point, null last, and share the sum of all
    sizes; a target stops at ``most`` times its source's size and the excess is shared
    again by weight. That is one level L with target = least(weight * L, most * size): for
    sources in the order in which they reach their stops, L is the largest of what the
    rest would get a unit of weight if all before it had stopped. Sources are aggregates,
    one narrow row each; they alone meet in one window.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    rows = sizes.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("long"))
    every = Window.partitionBy()
    reached = Window.orderBy((F.col("source_size") * most / F.col("weight")), F.col("source").isNull(), "source")
    before = reached.rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0))
    weighed = F.coalesce(F.sum("weight").over(before), F.lit(0))
    rows = rows.withColumn(
        "level", (F.sum("source_size").over(every) - stopped) / (F.sum("weight").over(every) - weighed))
    target = F.least(F.max("level").over(every) * F.col("weight"), (F.col("source_size") * most).cast("double"))
    return rows.select("source", "source_size", target.alias("target"))


def _named(source: str) -> Column:
    """The source as a key that is never null."""
    return F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))


def mix(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id",
        weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """``id_col``, ``size``, ``source_size``, ``target``, ``copies``, ``taken`` of every row of ``docs``.

    A row's key is a hash of its id and ``seed``, so reruns agree. Within a source, rows
    in the order of their keys are taken up to the source's target: as many whole
    epochs as fit, then rows up to the budget that is left; the row on the cut is taken
    if that ends nearer to the budget. ``taken`` = ``copies`` * ``size`` words; no row has more
    than ``most`` copies.

    Keys are cut into ranges, words are summed up within a range and the sums of the
    ranges before it are added: no source meets in one task, whatever its share. A null
    text has size 0, a null source is a source of its own, null ids share one key (rows
    of one key are ordered by size); an empty table gives no rows; other columns of
    ``docs`` are not read.
    """
    session = docs.sparkSession
    ranges = BUCKETS_PER_PARTITION * int(session.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"), n_words(text).alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")).cast("binary")).alias("key"))
    rows = settled(rows, "mix-sizes")      # narrow; the texts are read once
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    share = F.ceil(F.col("n") * ranges / F.sum("n").over(Window.partitionBy()))
    plan = settled(sizes.withColumn("ranges", share).select(_named("source").alias("name"), "ranges").join(
        targets(sizes, weights, most).withColumn("name", _named("source")).drop("source"), "name"), "mix-sources")
    at = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    # sources of more than one range are fewer than ranges, and come to the rows; others hold few rows each
    rows = rows.withColumn("name", _named("source")).drop("source")
    large = F.broadcast(plan.filter("ranges > 1").withColumn("large", F.lit(True)))
    both = rows.join(large, "name", "left")
    dealt = (
        both.filter("large").drop("large").unionByName(
            both.filter("large is null").select(*rows.columns).join(plan.filter("ranges <= 1"), "name"))
        .withColumn("range", F.floor(at * F.col("ranges") / F.lit(1 << 32)))
    )
    earlier = Window.partitionBy("name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        dealt.groupBy("name", "range").agg(F.sum("size").alias("words"))
        .select("name", "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    )
    within = Window.partitionBy("name", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        dealt.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(bases, ["name", "range"]).withColumn("start", F.col("start") + F.col("base"))
    )
    budget = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    left = F.col("left") - F.col("start")
    # nothing is left of a source at its stop, also not for texts without a word
    more = (left > 0) & ((F.col("size") <= left) | (2 * left >= F.col("size")))
    return (
        placed.withColumn("whole", whole).withColumn("left", budget - F.col("whole") * F.col("source_size"))
        .withColumn("copies", F.col("whole") + more.cast("long"))
        .select(F.col("id").alias(id_col), "size", "source_size", "target", "copies",
                (F.col("copies") * F.col("size")).alias("taken"))
    )
