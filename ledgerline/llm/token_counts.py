"""Token counts by a two-tier lookup on the map side; no pre-token is ever shuffled."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.tokenizers_io import (
    WORKER_PIECE_CHARS, WORKER_PIECES, byte_bpe, frequent_words, public_path)

BYTE_BPE = "byte_bpe_50k.json"


class _Lengths(dict):
    """Second tier: lengths of pieces a worker has met, encoded when first missed."""

    def __init__(self, encode):
        super().__init__()
        self._encode = encode

    def __missing__(self, piece: str) -> int:
        n = self._encode(piece)
        if len(piece) <= WORKER_PIECE_CHARS:
            if len(self) >= WORKER_PIECES:
                self.clear()
            self[piece] = n
        return n


@lru_cache(maxsize=2)
def _second_tier(path: str) -> _Lengths:
    return _Lengths(byte_bpe(path).piece_length)


def _count(text: str, bpe, first: dict[str, int], second: _Lengths) -> int:
    total, parts = 0, [text]
    for mark in bpe.special:
        if mark in text:
            found = [p.split(mark) for p in parts]
            total += sum(len(f) - 1 for f in found)
            parts = [p for f in found for p in f]
    for part in parts:
        found = list(map(first.get, pieces := bpe.split(part)))
        if None in found:
            found = [second[p] if n is None else n for p, n in zip(pieces, found)]
        total += sum(found)
    return total


def token_counts(docs: DataFrame, tokenizer: str = BYTE_BPE, text: str = "text", id_col: str = "doc_id",
                 path: str | None = None) -> DataFrame:
    """``id_col``, ``n_bytes`` and ``n_tokens`` of every text.

    First tier: a broadcast table of at most FREQUENT_WORDS frequent words (with their
    leading space) and their lengths in tokens. Second tier: each worker's own bounded
    cache of the pieces it missed. Texts of any script are cut into pieces and take both
    tiers. Rows stay in their partitions: nothing is shuffled.

    A null or empty text has 0 bytes and 0 tokens; null ids and repeated rows are kept
    as they are; an empty table gives none; other columns of ``docs`` are not read.
    Special strings inside a text count as one token each, as the library has them.
    ``path``: the vocabulary file, where all executors find it.
    """
    path = path or public_path(tokenizer)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            pieces = [f" {w}" for w in batch.column(0).to_pylist()]
            pieces = [p for p in pieces if bpe.split(p) == [p]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(pieces, pa.string()), pa.array(map(bpe.piece_length, pieces), pa.int32())], names=["piece", "n"])

    found = frequent_words(docs, text).mapInArrow(lengths, "piece string, n int").toArrow()
    known = dict(zip(found["piece"].to_pylist(), found["n"].to_pylist()))
    table = docs.sparkSession.sparkContext.broadcast(known)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, first = byte_bpe(path), table.value
        second = _second_tier(path)
        for batch in batches:
            texts = batch.column(1)
            sizes, counts = [], []
            for value in texts:
                value = value.as_py()
                sizes.append(len(value) if value.isascii() else len(value.encode()))
                counts.append(_count(value, bpe, first, second))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                names=["id", "n_bytes", "n_tokens"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(count, f"id {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("id", id_col)
