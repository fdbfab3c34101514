"""CRC-32 of many short byte ranges at once, and of joined ranges from the sums of their parts."""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np

from recordloom.llm.text_arrays import Pack

#: The reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Words of more bytes are summed one by one.
_SHORT = 24
_NEAR_BITS = 6


@cache
def _table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), table >> np.uint32(1)).astype(np.uint32)
    return table


@cache
def _near() -> np.ndarray:
    """[n, k, b]: what byte k of a sum with value b becomes after n zero bytes, n below 64."""
    table, out = _table(), np.zeros((1 << _NEAR_BITS, 4, 256), dtype=np.uint32)
    now = np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1 << _NEAR_BITS):
        out[n] = now
        now = table[now & 0xFF] ^ (now >> np.uint32(8))
    return out.reshape(-1)


@cache
def _power(bit: int) -> np.ndarray:
    """The same for 2^bit zero bytes, bit 6 and more: one step of half as many, taken twice."""
    if bit == _NEAR_BITS:
        half = _near().reshape(-1, 4, 256)[1 << (_NEAR_BITS - 1)]
    else:
        half = _power(bit - 1).reshape(4, 256)
    return _apply(half.reshape(-1), np.zeros((), np.int64), half).reshape(-1)


def _apply(tables: np.ndarray, at: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = tables[at + (x & 0xFF)]
    for k in (1, 2, 3):
        out = out ^ tables[at + (256 * k + ((x >> np.uint32(8 * k)) & 0xFF)).astype(np.int64)]
    return out


def after_zeros(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each raw sum after its number of zero bytes."""
    x = _apply(_near(), (n & ((1 << _NEAR_BITS) - 1)) * 1024, x)
    bit = _NEAR_BITS
    while len(n) and int(n.max()) >> bit:
        some = np.flatnonzero((n >> bit) & 1)
        x[some] = _apply(_power(bit), np.zeros(len(some), np.int64), x[some])
        bit += 1
    return x


def joined(a: np.ndarray, b: np.ndarray, length_b: np.ndarray) -> np.ndarray:
    """CRC-32 of each two byte strings one after the other, from their own sums and the length of the second."""
    return after_zeros(a, length_b) ^ b


def word_sums(words: Pack) -> np.ndarray:
    """CRC-32 of each word."""
    table, length = _table(), words.ends - words.starts
    order = np.argsort(-np.minimum(length, _SHORT + 1), kind="stable")
    starts, sizes = words.starts[order], length[order]
    crc = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    for j in range(min(_SHORT, int(sizes.max(initial=0)))):
        m = int(np.searchsorted(-np.minimum(sizes, _SHORT + 1), -j))  # words with more than j bytes
        crc[:m] = table[(crc[:m] ^ words.data[starts[:m] + j]) & 0xFF] ^ (crc[:m] >> np.uint32(8))
    out = np.empty(len(order), dtype=np.uint32)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(length > _SHORT).tolist():
        out[i] = zlib.crc32(words.data[words.starts[i] : words.ends[i]].tobytes())
    return out


def run_sums(words: Pack, longest: int) -> list[np.ndarray]:
    """For n = 1 to ``longest``: CRC-32 of the n words from each word on, joined by one space.

    Runs that would pass the last word of the pack are left out; the caller picks those within a row.
    """
    one, length = word_sums(words), words.ends - words.starts
    blank = np.full(len(one), zlib.crc32(b" "), dtype=np.uint32)
    led = joined(blank, one, length)  # a space and the word
    out = [one]
    for n in range(2, longest + 1):
        last = np.arange(n - 1, len(one))
        out.append(joined(out[-1][: len(last)], led[last], length[last] + 1))
    return out
