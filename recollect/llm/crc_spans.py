"""CRC-32 of many spans of bytes at once, from a table of positions.

The checksum is affine: that of a span is the exclusive or of one contribution of each byte, which depends on
the byte and on its distance from the span's end alone, and of a constant of the span's length. So a batch of
spans takes one lookup for each byte and one ``bitwise_xor.reduceat`` over the spans. Spans longer than the table
are cut into blocks from their ends, and the blocks' values fold in pairs, each left one moved over its right
one's bytes, until one is left.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np

BLOCK = 64
ONES = 0xFFFFFFFF


@cache
def contributions() -> np.ndarray:
    """What byte b adds at ``distance`` bytes from the end, at [distance * 256 + b]."""
    table = np.empty((BLOCK, 256), "u4")
    table[0] = [zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)]
    for distance in range(1, BLOCK):
        last = table[distance - 1]
        table[distance] = (last >> 8) ^ table[0][last & 0xFF]
    return table.reshape(-1)


@cache
def constants() -> np.ndarray:
    """Checksums of as many zero bytes as the index says, up to a block."""
    return np.array([zlib.crc32(bytes(n)) for n in range(BLOCK + 1)], "u4")


@cache
def moves(power: int) -> np.ndarray:
    """How a value moves over 2 ** power further bytes: four tables, one for each of its own bytes."""
    if power == 0:
        own = np.arange(256, dtype="u4")
        first = contributions()[:256]
        return np.stack([first[own], *((own << np.uint32(8 * (k - 1))) for k in (1, 2, 3))])
    half = moves(power - 1)
    return moved(half, power - 1)


def moved(values: np.ndarray, power: int) -> np.ndarray:
    tables = moves(power)
    out = tables[0][values & 0xFF]
    for k in (1, 2, 3):
        out = out ^ tables[k][(values >> np.uint32(8 * k)) & 0xFF]
    return out


def zeros(length: int) -> int:
    """The checksum of ``length`` zero bytes: the start value, moved over them."""
    state, power = np.array([ONES], "u4"), 0
    while length:
        if length & 1:
            state = moved(state, power)
        length, power = length >> 1, power + 1
    return int(state[0]) ^ ONES


def _long(span: np.ndarray) -> int:
    """A span of more than a block: blocks from its end, folded in pairs."""
    whole = np.zeros(-(-len(span) // BLOCK) * BLOCK, "u1")  # zeros before a span add nothing
    whole[len(whole) - len(span) :] = span
    at = np.tile(np.arange(BLOCK - 1, -1, -1, dtype="i8") << 8, len(whole) // BLOCK) + whole
    values = np.bitwise_xor.reduceat(contributions()[at], np.arange(0, len(whole), BLOCK))
    power = BLOCK.bit_length() - 1
    while len(values) > 1:
        if len(values) % 2:
            values = np.concatenate([np.zeros(1, "u4"), values])
        values = moved(values[0::2], power) ^ values[1::2]
        power += 1
    return int(values[0]) ^ zeros(len(span))


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of data[start:end] for spans of at least a byte that ascend and don't overlap."""
    if not len(starts):
        return np.zeros(0, "u4")
    lengths = ends - starts
    short = lengths <= BLOCK
    out = np.empty(len(starts), "u4")
    if short.any():
        s, n = starts[short], lengths[short]
        first = np.cumsum(n) - n  # the spans' bytes, without what stands between them
        at = np.arange(first[-1] + n[-1]) - np.repeat(first - s, n)
        distance = np.repeat(ends[short] - 1, n) - at
        out[short] = np.bitwise_xor.reduceat(contributions()[(distance << 8) + data[at]], first) ^ constants()[n]
    for i in np.flatnonzero(~short):
        out[i] = _long(data[starts[i] : ends[i]])
    return out
