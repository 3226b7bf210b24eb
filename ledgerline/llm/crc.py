"""CRC-32 of byte spans, vectorised over bytes: XOR of table entries by byte and distance from the end."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

REACH = 64                   # distances in the table; longer spans are folded block by block
_POLYNOMIAL = 0xEDB88320     # fixed value: reflected polynomial of CRC-32


def _tables(reach: int) -> np.ndarray:
    """``[distance, byte]``: what a byte leaves in an empty register after ``distance`` zero bytes."""
    table = np.zeros((reach, 256), dtype=np.uint32)
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = (first >> np.uint32(1)) ^ np.where(first & np.uint32(1), np.uint32(_POLYNOMIAL), np.uint32(0))
    table[0] = first
    for d in range(1, reach):
        table[d] = (table[d - 1] >> np.uint32(8)) ^ first[table[d - 1] & np.uint32(0xFF)]
    return table


_TABLE = _tables(REACH)
_FLAT = _TABLE.reshape(-1)


@lru_cache
def _pass_table(level: int) -> np.ndarray:
    """``[k, byte]``: what byte ``k`` of a register leaves after REACH * 2**level zero bytes."""
    if not level:
        return np.stack([_TABLE[REACH - 1 - k] for k in range(4)])
    half = _pass_table(level - 1)
    return _passed(half.reshape(-1), half).reshape(4, 256)


def _passed(register: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.zeros_like(register)
    for k in range(4):
        out ^= table[k][register >> np.uint32(8 * k) & np.uint32(0xFF)]
    return out


def _constants(reach: int) -> np.ndarray:
    """By length: what the register's start of all ones and the final inversion add."""
    register, first = np.uint32(0xFFFFFFFF), _TABLE[0]
    out = [np.uint32(0)]
    for _ in range(reach):
        register = (register >> np.uint32(8)) ^ first[register & np.uint32(0xFF)]
        out.append(register ^ np.uint32(0xFFFFFFFF))
    return np.array(out, dtype=np.uint32)


_CONSTANT = _constants(REACH)


def _raw(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Registers that spans of 1 to REACH bytes leave, begun with an empty one. Spans may overlap."""
    sizes = ends - starts
    firsts = np.cumsum(sizes) - sizes
    back = np.repeat(firsts + sizes - 1, sizes) - np.arange(int(sizes.sum()))
    at = np.repeat(ends - 1, sizes) - back
    return np.bitwise_xor.reduceat(_FLAT[(back << 8) | data[at]], firsts)


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32, as ``zlib.crc32`` gives it, of ``data[starts[i]:ends[i]]``.

    A span of up to REACH bytes is one segment of a ``reduceat`` over the contributions of all its
    bytes; a constant by length stands for the initial and the final inversion. Longer spans are
    folded from blocks of REACH. Empty spans give 0.
    """
    sizes = ends - starts
    out = np.zeros(len(starts), dtype=np.uint32)
    short = np.flatnonzero((sizes > 0) & (sizes <= REACH))
    if len(short):
        out[short] = _raw(data, starts[short], ends[short]) ^ _CONSTANT[sizes[short]]
    for i in np.flatnonzero(sizes > REACH):
        out[i] = _folded(data[starts[i]:ends[i]])
    return out


def _folded(span: np.ndarray) -> np.uint32:
    """CRC-32 of a span of more than REACH bytes.

    Blocks are cut from the end; neighbours are joined level by level: the left register is passed
    over the right one's bytes. A register of nothing before the first block changes nothing.
    """
    span = span.copy()
    span[:4] ^= np.uint8(0xFF)             # the register's start of all ones
    cuts = np.arange(len(span) % REACH or REACH, len(span) + 1, REACH)
    registers, level = _raw(span, np.concatenate([[0], cuts[:-1]]), cuts), 0
    while len(registers) > 1:
        if len(registers) % 2:
            registers = np.concatenate([np.zeros(1, np.uint32), registers])
        registers = _passed(registers[0::2], _pass_table(level)) ^ registers[1::2]
        level += 1
    return registers[0] ^ np.uint32(0xFFFFFFFF)
