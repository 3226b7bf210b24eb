"""Next table states: append, upsert, keyed update, bulk update, change rows.

Plain Parquet has no row-level write, so each operator gives the next state of a
table from its present one; ``sources.store`` writes that as a new version.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators.sieve import apart
from ledgerline.sources.tables import conform


def append(table: DataFrame, rows: DataFrame, schema: T.StructType | None = None,
           stamp: Mapping[str, Column] | None = None) -> DataFrame:
    """The table with new rows, stamped with the given times."""
    new = rows.withColumns(dict(stamp)) if stamp else rows
    if schema is not None:
        new = conform(new, schema)
    return table.unionByName(new, allowMissingColumns=True)


def one_row_per_key(source: DataFrame, keys: Sequence[str],
                    order: Sequence[str] | None = None) -> DataFrame:
    """Source rows with unique keys: the last by ``order``, or an error on a repeat."""
    keys = list(keys)
    rest = [c for c in source.columns if c not in keys]
    row, count = F.struct(*rest), F.count("*").alias("_n")
    if order:
        picked = source.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_row"))
        return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
    picked = source.groupBy(*keys).agg(F.first(row).alias("_row"), count)
    message = F.concat(F.lit("several source rows for key "),
                       F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    first = F.when(F.col("_n") > 1, F.raise_error(message).cast(source.schema[keys[0]].dataType)
                   ).otherwise(F.col(keys[0])).alias(keys[0])
    return picked.select(first, *keys[1:], *[F.col(f"_row.{c}").alias(c) for c in rest])


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str],
           update: Sequence[str], insert: Sequence[str],
           stamp: Mapping[str, Column] | None = None,
           order: Sequence[str] | None = None, few: bool = False) -> DataFrame:
    """Merge by key: matched rows take ``update`` columns, new rows ``insert`` columns.

    ``stamp`` columns are set on both. Columns not listed keep the target value,
    and are NULL in new rows. ``few`` as in ``keyed_update``, for a single key.
    """
    if few:
        touched, others = apart(target, source, keys[0])
        return upsert(touched, source, keys, update, insert, stamp, order).unionByName(others)
    keys, stamp = list(keys), dict(stamp or {})
    fresh = one_row_per_key(source, keys, order)
    fresh = fresh.select(*keys, F.struct(*[c for c in fresh.columns if c not in keys]).alias("_s"),
                         F.lit(True).alias("_from"))
    old = target.select(*keys, F.struct(*[c for c in target.columns if c not in keys]).alias("_t"),
                        F.lit(True).alias("_had"))
    both = old.join(fresh, keys, "full_outer")
    came, had = F.col("_from").isNotNull(), F.col("_had").isNotNull()
    columns = []
    for name in target.columns:
        if name in keys:
            columns.append(F.col(name))
            continue
        kept = F.col(f"_t.{name}")
        if name in stamp:
            value = F.when(came, stamp[name]).otherwise(kept)
        else:
            value = F.when(had & came, F.col(f"_s.{name}") if name in update else kept)
            if name in insert:
                value = value.when(came, F.col(f"_s.{name}"))
            value = value.otherwise(kept)
        columns.append(value.alias(name))
    return both.select(*columns)


def keyed_update(target: DataFrame, updates: DataFrame, key: str,
                 stamp: Mapping[str, Column] | None = None,
                 when_given: Sequence[str] = (), order: Sequence[str] | None = None,
                 few: bool = False) -> DataFrame:
    """Set the columns of ``updates`` on the rows of its keys.

    A NULL sets NULL, except in ``when_given`` columns where NULL means "not
    given". Keys without a row, and NULL, change nothing. Of several updates for a key the
    last by ``order`` counts; without an order they are an error.

    ``few``: updates are few beside a target that is read twice without harm (a stored table); rows
    that no update can be for are not shuffled.
    """
    if few:
        touched, rest = apart(target, updates, key)
        return keyed_update(touched, updates, key, stamp, when_given, order).unionByName(rest)
    changed = [c for c in updates.columns if c != key]
    single = one_row_per_key(updates.filter(F.col(key).isNotNull()), [key], order)
    patch = single.select(key, F.struct(*changed).alias("_u"), F.lit(True).alias("_hit"))
    joined = target.join(patch, key, "left")
    hit, columns = F.col("_hit").isNotNull(), []
    for name in target.columns:
        value = F.col(name)
        if stamp and name in stamp:
            value = F.when(hit, stamp[name]).otherwise(value)
        elif name in changed:
            given = hit & F.col(f"_u.{name}").isNotNull() if name in when_given else hit
            value = F.when(given, F.col(f"_u.{name}")).otherwise(value)
        columns.append(value.alias(name))
    return joined.select(*columns)


def bulk_set(target: DataFrame, chosen: DataFrame, key: str, values: Mapping[str, Column]
             ) -> DataFrame:
    """The same values on every row whose key is among ``chosen``."""
    marks = chosen.select(key).distinct().withColumn("_hit", F.lit(True))
    hit = F.col("_hit").isNotNull()
    columns = [F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
               for c in target.columns]
    return target.join(marks, key, "left").select(*columns)


def changes_between(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Change rows between two versions: insert, delete, update_preimage, update_postimage."""
    keys = list(keys)
    rest = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*rest).alias("_a"))
    b = new.select(*keys, F.struct(*rest).alias("_b"))
    def image(kind, row):
        return F.struct(F.lit(kind).alias("kind"), row.alias("row"))

    both = a.join(b, keys, "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b")))
    images = (
        F.when(F.col("_a").isNull(), F.array(image("insert", F.col("_b"))))
        .when(F.col("_b").isNull(), F.array(image("delete", F.col("_a"))))
        .otherwise(F.array(image("update_preimage", F.col("_a")),
                           image("update_postimage", F.col("_b"))))
    )
    return both.select(*keys, F.explode(images).alias("_c")).select(
        F.col("_c.kind").alias("change_type"), *keys,
        *[F.col(f"_c.row.{c}").alias(c) for c in rest])


def digests(table: DataFrame, keys: Sequence[str], coarse: int = 256, fine: int = 64) -> DataFrame:
    """Rows and two sums of row hashes for each pair of bucket numbers (``_a``, ``_b``) of the key.

    Equal tables have equal digests, whatever the order of their rows; others have with a chance
    of about 2**-60 for each bucket. Each split is summed up by itself: a row for a bucket is shuffled.
    """
    columns = sorted(table.columns)
    return table.select(*_bucket_numbers(keys, coarse, fine), F.xxhash64(*columns).alias("_h"),
                        F.xxhash64(F.lit(1), *columns).alias("_g")).groupBy("_a", "_b").agg(
        F.count("*").alias("_rows"), F.sum(F.col("_h").cast("decimal(38,0)")).alias("_h"),
        F.bit_xor("_g").alias("_g"))


def _bucket_numbers(keys: Sequence[str], coarse: int, fine: int) -> list[Column]:
    h = F.xxhash64(*keys)
    return [F.pmod(h, F.lit(coarse)).alias("_a"), F.pmod(F.floor(h / coarse), F.lit(fine)).alias("_b")]


def changes_by_digest(old: DataFrame, new: DataFrame, keys: Sequence[str],
                      coarse: int = 256, fine: int = 64) -> DataFrame:
    """``changes_between``, joining only the buckets whose digests differ.

    A first scan of each table adds up digests, at most ``coarse`` * ``fine`` rows; only the rows of
    buckets that differ are shuffled and joined. For tables that few rows tell apart.
    """
    a, b = digests(old, keys, coarse, fine), digests(new, keys, coarse, fine)
    values = ["_rows", "_h", "_g"]
    both = a.select("_a", "_b", F.struct(*values).alias("_x")).join(
        b.select("_a", "_b", F.struct(*values).alias("_y")), ["_a", "_b"], "full_outer")
    # bounded by the number of buckets
    differ = F.broadcast(both.filter(~F.col("_x").eqNullSafe(F.col("_y"))).select("_a", "_b"))

    def rows_of(table: DataFrame) -> DataFrame:
        return table.select("*", *_bucket_numbers(keys, coarse, fine)).join(
            differ, ["_a", "_b"], "left_semi").select(*table.columns)

    return changes_between(rows_of(old), rows_of(new), keys)


def apply_changes(old: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The version that ``changes_between`` was taken to."""
    keys = list(keys)
    gone = changes.filter(F.col("change_type").isin("delete", "update_preimage")).select(*keys)
    came = changes.filter(F.col("change_type").isin("insert", "update_postimage"))
    return old.join(gone, keys, "left_anti").unionByName(came.drop("change_type"))
