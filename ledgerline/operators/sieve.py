"""Rows of a large table by the keys of a smaller one, with few of the others shuffled.

The wanted keys are marked in bitmaps of a fixed size in all, which every task gets: a row without
a mark has no wanted key and goes no further. The join that decides comes after that, so marks that
keys share cost time and change no result, and a filter that is full lets all rows through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = 2_048               # bitmaps of 32,768 bits, 4 KB each: 8 MB at most
WORDS = 512                  # of 64 bits in a bitmap


def _places(key: str) -> tuple[Column, list[Column]]:
    """The block of a key and its two bits there, from one hash."""
    h = F.xxhash64(key)
    return h.bitwiseAND(F.lit(BLOCKS - 1)), [
        F.shiftright(h, shift).bitwiseAND(F.lit(64 * WORDS - 1)) for shift in (20, 40)]


def _marks(wanted: DataFrame, key: str) -> DataFrame:
    """The bitmaps as arrays of words; a block without a key has no row."""
    block, bits = _places(key)
    marked = wanted.select(block.alias("_sieve_block"), F.explode(F.array(*bits)).alias("_bit")).repartition(
        "_sieve_block").groupBy("_sieve_block").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    word = lambda i: F.conv(F.hex(F.substring(F.col("_bits"), i * 8 + 1, F.lit(8))), 16, -10).cast("long")
    return marked.select("_sieve_block", F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), word).alias("_sieve_words"))


def _by_marks(rows: DataFrame, wanted: DataFrame, key: str, how: str) -> DataFrame:
    block, bits = _places(key)
    # bytes of a word are read from the left, bits of a byte from the right
    set_ = [F.getbit(F.get("_sieve_words", F.shiftright(b, 6).cast("int")), b.bitwiseAND(F.lit(63)).bitwiseXOR(F.lit(56))) == 1
            for b in bits]
    same = (F.col("_sieve_at") == F.col("_sieve_block")) & set_[0] & set_[1]
    return rows.withColumn("_sieve_at", block).join(F.broadcast(_marks(wanted, key)), same, how).select(*rows.columns)


def _comparable(rows: DataFrame, wanted: DataFrame, key: str) -> bool:
    return rows.schema[key].dataType == wanted.schema[key].dataType


def sieved(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """All rows whose ``key`` is among those of ``wanted``, and few others. Nothing of ``rows`` is shuffled."""
    return _by_marks(rows, wanted, key, "left_semi") if _comparable(rows, wanted, key) else rows


def matching(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is among those of ``wanted``: a semi join of what is left by ``sieved``."""
    return sieved(rows, wanted, key).join(wanted.select(key), key, "left_semi").select(*rows.columns)


def apart(rows: DataFrame, wanted: DataFrame, key: str) -> Sequence[DataFrame]:
    """``sieved`` rows, and the rest: no wanted key is among the second. Each reads ``rows``."""
    if not _comparable(rows, wanted, key):
        return rows, rows.limit(0)
    return _by_marks(rows, wanted, key, "left_semi"), _by_marks(rows, wanted, key, "left_anti")
