"""CRC-32 of many spans of one byte array at once, from a table of byte contributions.

CRC-32 is linear over GF(2) but for a constant of the length.  The contribution of
byte b at distance d from a span's end is ``TABLE[d, b]``; a span's checksum is the
XOR of its bytes' contributions and the checksum of as many zero bytes.  Spans
longer than the table are cut into blocks from their end, whose sums are folded in
pairs: the left of two blocks is moved over the zero bytes of the right one by a
linear operator, which is squared each round.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np

#: Distances in the table, which are also the bytes of a block.
BLOCK = 64
#: Blocks whose bytes are gathered at once.
BLOCKS_AT_ONCE = 1 << 14
#: Lengths whose constants are kept.
KNOWN_LENGTHS = 1 << 10


@lru_cache(maxsize=1)
def position_table() -> np.ndarray:
    """[distance from the end * 256 + byte] -> contribution."""
    out = np.empty((BLOCK, 256), np.uint32)
    for d in range(BLOCK):
        zero = zlib.crc32(bytes(d + 1))
        out[d] = [zlib.crc32(bytes([b]) + bytes(d)) ^ zero for b in range(256)]
    return out.ravel()


def _apply(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The linear operator with these images of the 32 single bits, for each of ``x``."""
    out = np.zeros(len(x), np.uint32)
    for bit in range(32):
        out ^= np.where((x >> np.uint32(bit)) & np.uint32(1), columns[bit], np.uint32(0))
    return out


@lru_cache(maxsize=1)
def _past_zero_bit() -> np.ndarray:
    """The state one zero bit later, for each single bit of a (reflected) CRC-32 state."""
    out = np.array([(1 << bit) >> 1 for bit in range(32)], np.uint32)
    out[0] = 0xEDB88320  # fixed value: the CRC-32 polynomial, reflected
    return out


@lru_cache(maxsize=64)
def past_zeros(doublings: int) -> np.ndarray:
    """The operator that moves a sum over 2**doublings zero bits."""
    if doublings == 0:
        return _past_zero_bit()
    half = past_zeros(doublings - 1)
    return _apply(half, half)


@lru_cache(maxsize=1)
def _known_zero_crcs() -> np.ndarray:
    return np.array([zlib.crc32(bytes(n)) for n in range(KNOWN_LENGTHS)], np.uint32)


def zero_crcs(lengths: np.ndarray) -> np.ndarray:
    """The checksum of n zero bytes for each n: the length constant."""
    if lengths.max(initial=0) < KNOWN_LENGTHS:
        return _known_zero_crcs()[lengths]
    known, back = np.unique(lengths, return_inverse=True)
    start = np.full(len(known), 0xFFFFFFFF, np.uint32)
    bits = known.astype(np.uint64) * np.uint64(8)
    top = int(bits.max()).bit_length() if len(bits) else 0
    for k in range(top):
        on = (bits >> np.uint64(k)) & np.uint64(1) == 1
        if on.any():
            start[on] = _apply(past_zeros(k), start[on])
    return (start ^ np.uint32(0xFFFFFFFF))[back.reshape(-1)]


def _short(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XOR of contributions of non-empty spans of at most BLOCK bytes, BLOCKS_AT_ONCE spans at a time."""
    if len(starts) > BLOCKS_AT_ONCE:
        cuts = [slice(i, i + BLOCKS_AT_ONCE) for i in range(0, len(starts), BLOCKS_AT_ONCE)]
        return np.concatenate([_short(data, starts[c], ends[c]) for c in cuts])
    sizes = ends - starts
    offsets = np.cumsum(sizes) - sizes
    flat = np.arange(int(sizes.sum()), dtype=np.int32)
    low = int(starts.min())  # so that 32 bits do for the places, also in a very long array
    at = flat + np.repeat((starts - low - offsets).astype(np.int32), sizes)
    distance = np.repeat((offsets + sizes - 1).astype(np.int32), sizes) - flat
    return np.bitwise_xor.reduceat(position_table()[(distance << 8) + data[low:][at]], offsets)


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The unsigned CRC-32 of ``data[start:end]`` (uint8) for each span; all spans non-empty."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    sizes = ends - starts
    constant = zero_crcs(sizes)
    blocks = (sizes + BLOCK - 1) // BLOCK
    if blocks.max() == 1:
        return _short(data, starts, ends) ^ constant
    span = np.repeat(np.arange(len(starts)), blocks)
    first = np.repeat(np.cumsum(blocks) - blocks, blocks)
    k = np.repeat(blocks, blocks) - 1 - (np.arange(len(span)) - first)  # number from the span's end
    block_ends = ends[span] - k * BLOCK
    value = _short(data, np.maximum(starts[span], block_ends - BLOCK), block_ends)
    doublings = (BLOCK * 8).bit_length() - 1
    while k.max() > 0:
        left = k & 1 == 1
        value[left] = _apply(past_zeros(doublings), value[left])
        half = k >> 1
        cut = np.flatnonzero(np.r_[True, (np.diff(span) != 0) | (np.diff(half) != 0)])
        value, span, k = np.bitwise_xor.reduceat(value, cut), span[cut], half[cut]
        doublings += 1
    return value ^ constant
