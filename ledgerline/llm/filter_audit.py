"""How filters act on each other: what each removes in every order, from sorted lists of failing rows."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.settle import settled
from ledgerline.llm.words import distinct_in_rows, slices, words_of

FILTERS = "ABCDE"
LEAST_WORDS = 200
DISTINCT_PERCENT = 50
UPPER_PERCENT = 3
MARKS = b"#$%&*|"
LISTS = (*FILTERS, "good", "toxic")
HOT_KEYS = 1024              # a key with more than a 1024th of all rows is looked up by broadcast

_UPPER, _MARK = np.zeros((2, 256), dtype=bool)
_UPPER[0x41:0x5B] = True
_MARK[list(MARKS)] = True


def failing(column: pa.Array) -> np.ndarray:
    """Bits of the filters A to D that each text fails; a null counts as empty."""
    words = words_of(column)
    data, offsets = words.data, words.offsets
    _, distinct = distinct_in_rows(words.hashes(), words.first)

    def per_row(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])

    fails = [
        words.counts < LEAST_WORDS,
        100 * np.diff(distinct) < DISTINCT_PERCENT * words.counts,
        100 * per_row(_UPPER[data]) > UPPER_PERCENT * per_row((data & 0xC0) != 0x80),
        per_row(_MARK[data]) > 0,
    ]
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def _looked_up(rows: DataFrame, total: int, key: str, found: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``found``, which has one row for each ``key``; null if there is none.

    Keys, the null among them, with more than a 1024th of all rows are found by broadcast (so at
    most 1,024 rows of ``found``), and their rows stay where they are; the others meet by a join.
    """
    hot = rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") * HOT_KEYS > total).select(key)
    near = F.broadcast(hot.join(found, key, "left").select(F.col(key).alias("_key"), F.struct(
        *(c for c in found.columns if c != key)).alias("_found")))
    both = rows.join(near, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("_hot", F.col("_found").isNotNull())
    here = both.filter("_hot").select(*rows.columns, "_found.*")
    return here.unionByName(both.filter("not _hot").select(*rows.columns).join(found, key, "left"))


def failures(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id",
             part: str = "lang") -> DataFrame:
    """``id``, ``part``, ``bits``, ``good``, ``toxic`` of every row of ``docs``.

    Bit i of ``bits`` is set if the row fails the i-th of FILTERS; A to D by its own text, E if a
    smaller id has the same text (by SHA-256), wherever in the table. A null text is empty, a null
    part the empty string; a null id is neither smaller nor larger than another. Rows of one id
    count each. An id is good (toxic) if any of its rows in ``labels`` says so.
    """
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), piece.column(2), pa.array(failing(piece.column(3)), pa.int32())],
                    names=["id", "part", "digest", "bits"])

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest"), body.alias("text"))
    rows = settled(rows.mapInArrow(measure, "id long, part string, digest binary, bits int"), "audit-bits")
    total = rows.count()
    repeated = (
        rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"))
        .filter("first < last").drop("last")
    )
    again = F.coalesce(F.col("id") > F.col("first"), F.lit(False)).cast("int") * (1 << FILTERS.index("E"))
    whole = settled(
        _looked_up(rows, total, "digest", repeated).select("id", "part", (F.col("bits") + again).alias("bits")),
        "audit-repeats")
    marks = (
        labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
        .agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
        .filter("good or toxic")
    )
    flag = [F.coalesce(F.col(n), F.lit(False)).alias(n) for n in ("good", "toxic")]
    return _looked_up(whole, total, "id", marks).select("id", "part", "bits", *flag)


def posting_lists(rows: DataFrame) -> DataFrame:
    """``part``, ``ids`` and a list for each of LISTS: blocks of failing rows by ranges of ids.

    ``ids`` are those of the block's rows in order (null first, repeated ones as often as they are);
    a list holds ascending places in ``ids``. Rows are dealt by ranges of part, id and a number of
    their own, so that neither a part nor an id with many rows fills one task; a block is one
    part's share of an Arrow batch.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = settled(rows.withColumn("own", F.monotonically_increasing_id()), "audit-rows")
    order = ["part", "id", "own"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = np.array(batch.column(1).to_pylist(), dtype=object)
            starts = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]])) if len(parts) else []
            for a, b in zip(starts, [*starts[1:], len(parts)]):
                piece = batch.slice(a, b - a)
                bits = piece.column(2).to_numpy()
                flags = [bits >> i & 1 for i in range(len(FILTERS))]
                flags += [piece.column(i).to_numpy(zero_copy_only=False) for i in (3, 4)]
                lists = [pa.array([np.flatnonzero(f).astype(np.int32)], pa.list_(pa.int32())) for f in flags]
                ids = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), piece.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([parts[a]]), ids, *lists], names=["part", "ids", *LISTS])

    dealt = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order).drop("own")
    kinds = ", ".join(f"{name} array<int>" for name in LISTS)
    return dealt.mapInArrow(build, f"part string, ids array<bigint>, {kinds}")


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of two sorted lists without common entries; the stable sort gallops along the two runs."""
    return np.sort(np.concatenate([a, b]), kind="stable")


def _among(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which entries of sorted ``a`` are in sorted ``b``: a search that begins where the last ended."""
    if not len(b):
        return np.zeros(len(a), dtype=bool)
    at = np.searchsorted(b, a)
    return (b[np.minimum(at, len(b) - 1)] == a) & (at < len(b))


def block_sizes(lists: dict[str, np.ndarray]) -> Iterator[tuple[str, str, tuple[int, int, int]]]:
    """(filters before, filter, sizes) of a block, for every set of filters and each filter not in it.

    Sizes are those of the filter's list less the union of the lists before, and of what this has
    in common with the good and the toxic rows. With no filter (``""``): the size of the union.
    """
    unions = {"": np.zeros(0, np.int32)}
    for n in range(len(FILTERS) + 1):
        for before in map("".join, combinations(FILTERS, n)):
            yield before, "", (len(unions[before]), 0, 0)
            for name in FILTERS:
                if name in before:
                    continue
                left = lists[name][~_among(lists[name], unions[before])]
                yield before, name, (len(left), *(int(_among(left, lists[k]).sum()) for k in ("good", "toxic")))
                then = "".join(sorted(before + name))
                if then not in unions:
                    unions[then] = merged(unions[before], left)


def interactions(blocks: DataFrame) -> DataFrame:
    """``part``, ``filter_order``, ``step`` and the counts of what happens there, from posting lists.

    One row for each part, each of the 120 orders of FILTERS and each step, zeros included: ``kept``
    after the step, ``removed`` by its filter, ``redundant`` (it fails, but was removed before),
    ``unique_fails`` (it fails this filter only), ``good_lost`` and ``toxic_lost`` of the removed,
    ``shapley``: the filter's removed summed over all orders. A block gives 112 sizes, which
    are added up by part; no rows, no parts.
    """
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict = defaultdict(lambda: np.zeros(3, dtype=np.int64))
            for i, part in enumerate(batch.column(0).to_pylist()):
                lists = {name: batch.column(name)[i].values.to_numpy() for name in LISTS}
                sums[part, "rows"] += (len(batch.column(1)[i]), 0, 0)
                for before, name, sizes in block_sizes(lists):
                    sums[part, f"{before}|{name}"] += sizes
            values = np.array(list(sums.values())).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in sums], pa.string()), pa.array([k for _, k in sums], pa.string()),
                 *(pa.array(values[:, j]) for j in range(3))], names=["part", "key", "n", "good", "toxic"])

    sizes = (
        blocks.mapInArrow(measure, "part string, key string, n long, good long, toxic long")
        .groupBy("part", "key").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
        # at most 113 keys
        .groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("key", F.struct("n", "good", "toxic")))).alias("of"))
    )
    orders = F.explode(F.array(*(F.lit("".join(o)) for o in permutations(FILTERS))))
    steps = (
        sizes.withColumn("filter_order", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
        .withColumn("name", F.expr("substring(filter_order, step, 1)"))
        .withColumn("before", _sorted(F.expr("substring(filter_order, 1, step - 1)")))
        .withColumn("after", _sorted(F.expr("substring(filter_order, 1, step)")))
        .withColumn("others", F.regexp_replace(F.lit(FILTERS), F.col("name"), F.lit("")))
    )
    here = F.element_at("of", F.concat_ws("|", "before", "name"))
    removed = here["n"]
    counted = steps.select(
        "part", "filter_order", "step", "name",
        (F.element_at("of", F.lit("rows"))["n"] - F.element_at("of", F.concat("after", F.lit("|")))["n"]).alias("kept"),
        removed.alias("removed"),
        (F.element_at("of", F.concat(F.lit("|"), "name"))["n"] - removed).alias("redundant"),
        F.element_at("of", F.concat_ws("|", "others", "name"))["n"].alias("unique_fails"),
        here["good"].alias("good_lost"), here["toxic"].alias("toxic_lost"))
    return counted.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "name"))).drop("name")


def _sorted(letters: Column) -> Column:
    return F.array_join(F.array_sort(F.split(letters, "")), "")


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id",
          part: str = "lang") -> DataFrame:
    """``interactions`` of all rows of ``docs``; its own columns and those of ``failures`` never clash.

    Nulls, repeated rows and ties are as ``failures`` says; an empty table gives no rows; columns
    other than the named ones are not read.
    """
    return interactions(posting_lists(failures(docs, labels, text, id_col, part)))
