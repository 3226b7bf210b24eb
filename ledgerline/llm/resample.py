"""Importance resampling towards a target: hashed n-gram counts, gains of buckets, Gumbel draws."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.crc import crc32_spans
from ledgerline.llm.settle import settled
from ledgerline.llm.words import slices, words_of

LONGEST = 1                  # features are runs of 1 to so many words
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"

#: Bytes between words: ASCII that is neither letter nor digit.
_BETWEEN = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def buckets(column: pa.Array, longest: int = LONGEST, n_buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the features of every text (a null has none), their texts' ranges, and numbers of words."""
    words = words_of(column, _BETWEEN)
    sizes = words.ends - words.starts
    # the words alone, each with a space behind it: runs of words are spans of that
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    joined = np.full(len(words.data) + len(sizes) if len(sizes) else 0, 0x20, dtype=np.uint8)
    at = np.arange(int(sizes.sum()))
    behind = np.repeat(np.cumsum(sizes) - sizes, sizes)
    joined[np.repeat(starts, sizes) + at - behind] = _LOWER[words.data[np.repeat(words.starts, sizes) + at - behind]]
    rows = np.repeat(np.arange(len(words.counts)), words.counts)
    found, owners = [], []
    for n in range(1, longest + 1):
        firsts = np.arange(max(len(sizes) - n + 1, 0))
        firsts = firsts[rows[firsts] == rows[firsts + n - 1]]
        found.append(crc32_spans(joined, starts[firsts], ends[firsts + n - 1]) % np.uint32(n_buckets))
        owners.append(rows[firsts])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    edges = np.searchsorted(owner[order], np.arange(len(words.counts) + 1))
    return np.concatenate(found)[order].astype(np.int64), edges, words.counts


def bucket_counts(texts: DataFrame, text: str = "text", longest: int = LONGEST, n_buckets: int = BUCKETS) -> DataFrame:
    """``bucket``, ``n``: features of all texts, counted in tasks first, so at most ``n_buckets`` rows a task are shuffled."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, dtype=np.int64)
        for batch in batches:
            for piece in slices(batch, "text"):
                total += np.bincount(buckets(piece.column(0), longest, n_buckets)[0], minlength=n_buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], names=["bucket", "n"])

    rows = texts.select(F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, n_buckets: int = BUCKETS) -> DataFrame:
    """``bucket``, ``gain`` of every bucket: floor(1000 * log of smoothed target share over raw share).

    Both inputs are ``bucket, n``; a bucket in neither of them has counts of 0 too.
    """
    both = (
        raw.sparkSession.range(n_buckets).select(F.col("id").cast("int").alias("bucket"))
        .join(raw.select("bucket", F.col("n").alias("s")), "bucket", "left")
        .join(target.select("bucket", F.col("n").alias("t")), "bucket", "left")
        .select("bucket", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")))
    )
    every = {c: F.sum(c).over(Window.partitionBy()) for c in ("s", "t")}     # over n_buckets rows
    share = ((F.col("t") + 1) * (every["s"] + n_buckets)) / ((F.col("s") + 1) * (every["t"] + n_buckets))
    return both.select("bucket", F.floor(1000 * F.log(share)).cast("long").alias("gain"))


def weigh(docs: DataFrame, gained: np.ndarray, text: str = "text", id_col: str = "doc_id",
          longest: int = LONGEST) -> DataFrame:
    """``id``, ``n_words``, ``n_features``, ``weight`` of every row: the sum of its features' gains (none: 0)."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                found, edges, n_words = buckets(piece.column(1), longest, len(gained))
                sums = np.concatenate([[0], np.cumsum(gained[found])])
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), *(pa.array(v.astype(np.int64)) for v in (n_words, np.diff(edges), sums[edges[1:]] - sums[edges[:-1]]))],
                    names=["id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(measure, "id long, n_words long, n_features long, weight long")


def drawn(scored: DataFrame, most: int) -> DataFrame:
    """``own``, ``rank`` of the ``most`` rows of ``scored`` with the highest ``score``, ties to smaller ``id``.

    Rows are dealt by ranges of the whole order, a row number of their own last, so rows alike are
    dealt too; counts of the ranges before shift the number within a range. Only ranges that the
    draw reaches are numbered. Null ids come last; rows alike in score and id are ordered by
    features, weight and then by ``own``.
    """
    session = scored.sparkSession
    ranges = int(session.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features").asc(), F.col("own").asc()]
    dealt = scored.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id())
    dealt = settled(dealt, "resample-ranges")
    sizes = dealt.groupBy("range").agg(F.count("*").alias("n"))     # a row for each range
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).filter(F.col("base") < most)
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return (
        dealt.join(F.broadcast(shifts), "range")
        .select("own", (F.col("base") + inside).cast("long").alias("rank")).filter(F.col("rank") <= most)
    )


def resample(docs: DataFrame, target: DataFrame, text: str = "text", id_col: str = "doc_id", longest: int = LONGEST,
             n_buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """``id_col``, ``n_features``, ``weight``, ``score``, ``rank`` of every row of ``docs``.

    Features of a text, lower-cased in A-Z only, are its runs of 1 to ``longest`` words, each word a
    run of letters, digits and characters beyond ASCII; a feature's bucket is its CRC-32 modulo
    ``n_buckets``. A bucket gains by how much likelier it is in ``target`` than in ``docs``; a row's
    score is its sum of gains and a Gumbel number hashed from ``seed`` and id, so reruns agree.
    Of the rows with ``least_words`` words or more, ``percent`` in a hundred with the highest
    scores are drawn and ranked; others have a null rank.

    A null or empty text has no feature, weight 0 and no rank; a null id is hashed as the empty
    text and ranks after its ties; rows of one id count each. An empty table gives no rows, an
    empty target counts of 0. Other columns are not read. Texts are read twice, for the counts
    and for the weights; the driver takes the ``n_buckets`` gains.
    """
    every = gains(bucket_counts(docs, text, longest, n_buckets), bucket_counts(target, text, longest, n_buckets), n_buckets)
    gained = np.zeros(n_buckets, dtype=np.int64)
    for row in every.collect():            # a fixed number of rows
        gained[row["bucket"]] = row["gain"]
    salted = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(salted.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = settled(
        weigh(docs, gained, text, id_col, longest).withColumns(
            {"score": F.col("weight") + gumbel, "own": F.monotonically_increasing_id()}), "resample-scores")
    enough = scored.filter(F.col("n_words") >= least_words)
    ranks = drawn(enough, enough.count() * percent // 100)
    return scored.join(ranks, "own", "left").select(
        F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
