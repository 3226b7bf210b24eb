"""Keyed tables of a store in hash buckets: a write replaces only the buckets it touches.

A bucket is a number made of the key, so old rows and changes meet by bucket: only the
folders of touched buckets are read, joined and written anew; the store's list goes on
naming the files of all others.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.changes import changes_by_digest
from ledgerline.sources.store import BUCKET, Store

BUCKETS = 64


@dataclass(frozen=True)
class Part:
    """New rows of some buckets (column BUCKET, of so many in all). Touched ones without a row become empty."""
    rows: DataFrame
    touched: Sequence[int]
    of: int


def bucket_of(keys: Sequence[str], of: int) -> Column:
    """Number of the bucket of a row: the same for equal keys, NULLs as well."""
    return F.pmod(F.xxhash64(*keys), F.lit(of)).cast("int")


def whole(rows: DataFrame, keys: Sequence[str], of: int = BUCKETS) -> Part:
    """All buckets of a table that is new."""
    return Part(rows.withColumn(BUCKET, bucket_of(keys, of)), range(of), of)


def touched_by(changes: DataFrame, keys: Sequence[str], of: int) -> list[int]:
    """Buckets that hold a key of ``changes``; at most ``of`` numbers."""
    return sorted(r[0] for r in changes.select(bucket_of(keys, of)).distinct().collect())


def changes_of(store: Store, table: str, keys: Sequence[str], since: int, upto: int | None = None) -> DataFrame:
    """Change rows between two versions of a table in buckets.

    A bucket whose folder both versions name holds the same rows and is not read; of the others
    those are joined whose digests differ.
    """
    old, new = store.bucket_folders(table, since), store.bucket_folders(table, upto)
    moved = sorted(b for b in {**old, **new} if old.get(b) != new.get(b))
    return changes_by_digest(store.read(table, moved, since), store.read(table, moved, upto), keys)


def changed(store: Store, table: str, changes: DataFrame, keys: Sequence[str],
            merge: Callable[[DataFrame], DataFrame]) -> Part:
    """The touched buckets after ``merge(old rows of these buckets)``.

    ``merge`` gives rows with the old columns, and no key of another bucket. ``changes`` is read for
    its keys, and once more where ``merge`` uses it; write it first (``Store.materialize``) if it is dear.
    """
    of = store.buckets(table)
    touched = touched_by(changes, keys, of)
    return Part(merge(store.read(table, touched)).withColumn(BUCKET, bucket_of(keys, of)), touched, of)
