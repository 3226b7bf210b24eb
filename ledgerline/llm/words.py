"""Words of Arrow text columns as spans and 64-bit hashes, without a Python loop over words.

A word is a run of ``[^\\x20\\x09-\\x0D]``. These are single bytes in UTF-8, so words are
found in the bytes of the column. A hash is a polynomial over random byte values
modulo 2**64, taken from prefix sums and mixed; two different words share one with a
chance of about 2**-58, which the operators accept as identity of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 18        # bytes hashed at once
SLICE_BYTES = 2 << 20    # bytes of text in one slice of a batch, one text at least

_rng = np.random.default_rng(20240607)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[0x41:0x5B] = _BYTE[0x61:0x7B]
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over the whole value (a bijection)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _hash_segment(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = 1 << max(len(values), SEGMENT).bit_length()
    up, down = _powers(n)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hashes of the byte spans; ``fold`` reads A-Z as a-z. Spans must be in order."""
    table, out, at = _FOLDED if fold else _BYTE, np.empty(len(starts), dtype=np.uint64), 0
    while at < len(starts):
        first = starts[at]
        upto = max(at + 1, int(np.searchsorted(ends, first + SEGMENT, "right")))
        out[at:upto] = _hash_segment(
            table[data[first:ends[upto - 1]]], starts[at:upto] - first, ends[at:upto] - first)
        at = upto
    return mix(out ^ (ends - starts).astype(np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the n + 1 offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


@dataclass
class Words:
    """Words of a slice: byte spans, and for each row the range ``first[i]:first[i + 1]``."""
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, fold: bool = False) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends, fold)


def words_of(column: pa.Array, space: np.ndarray = SPACE) -> Words:
    """Words of every row; ``space`` tells which of the 256 bytes stand between words."""
    data, offsets = text_bytes(column)
    return words_in(data, offsets, space)


def words_in(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> Words:
    """Words of the rows that ``offsets`` cut ``data`` into."""
    solid = ~space[data]
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    stops[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] = solid[inner]           # a word ends with its row
    stops[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(begins)
    return Words(data, offsets, starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets))


def grams(hashes: np.ndarray, first: np.ndarray, n: int, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``n`` words that stand ``step`` apart in one row, and their rows' ranges."""
    counts = np.diff(first)
    whole = np.maximum(counts - (n - 1) * step, 0)
    upto = np.concatenate([[0], np.cumsum(whole)])
    at = np.arange(upto[-1]) + np.repeat(first[:-1] - upto[:-1], whole)
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(n):
        out = (out ^ hashes[at + k * step]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return mix(out + np.uint64(n * 64 + step)), upto


def row_order(values: np.ndarray, first: np.ndarray, lead: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``values`` by row, then by ``lead`` (bytes, if given), then by value; and which are new in it.

    Sorts one 64-bit key: as many high bits of a value as the row number leaves. With
    2,000 rows that is 53 bits, so two values of a row are mixed up with a chance of 2**-53.
    """
    n = len(first) - 1
    bits = np.uint64(max(1, int(n).bit_length()))
    key = np.repeat(np.arange(n, dtype=np.uint64), np.diff(first)) << (np.uint64(64) - bits)
    if lead is not None:
        key |= lead.astype(np.uint64) << (np.uint64(56) - bits)
        bits += np.uint64(8)
    key |= values >> bits
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    return order, new


def distinct_in_rows(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and their ranges."""
    order, new = row_order(values.astype(np.uint64, copy=False), first)
    upto = np.concatenate([[0], np.cumsum(new)])
    return values[order[new]], upto[first]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``limit`` bytes of ``column``, one row at least."""
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto
