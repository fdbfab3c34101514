"""Words of many texts at once, as numpy arrays over one byte buffer.

A *pack* holds the normalised texts of some rows: the words of a row joined by single spaces, one row
after the other without separator. Any run of consecutive words is then one byte range, so equal word
sequences are equal byte ranges, and a rolling hash of a range costs two look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer single text is worked on by itself.
SLICE_BYTES = 1 << 20

_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_powers = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = -(-n // (1 << 20)) << 20  # whole megabytes, not doubled: 16 bytes each
        with np.errstate(over="ignore"):
            made = []
            for base in (_P, _P_INVERSE):
                powers = np.full(size, base, dtype=np.uint64)
                powers[0] = 1
                made.append(np.multiply.accumulate(powers, out=powers))
        _powers = (made[0], made[1])
    return _powers


def scramble(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text, or of one row."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        total, begin = np.concatenate([[0], np.cumsum(sizes)]), 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(total, total[begin] + limit, side="right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and the offset of each; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data)


@dataclass
class Pack:
    """Normalised texts: word i has the bytes ``starts[i]:ends[i]``; row r the words ``first[r]:first[r + 1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    _sums: np.ndarray | None = None

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.n_words)

    def windows(self, k: int) -> np.ndarray:
        """First words of the runs of k words that lie within one row."""
        n = len(self.starts)
        left = np.repeat(self.first[1:], self.n_words) - np.arange(n)
        return np.flatnonzero(left >= k)

    def hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte range; equal bytes have equal hashes."""
        powers, inverse = _power_tables(len(self.data) + 1)
        with np.errstate(over="ignore"):
            if self._sums is None:
                # In place: a pack of a bucket has millions of bytes, each eight here.
                sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
                sums[1:] = self.data
                sums[1:] += np.uint64(1)
                sums[1:] *= powers[: len(self.data)]
                np.add.accumulate(sums[1:], out=sums[1:])
                self._sums = sums
            return scramble((self._sums[end] - self._sums[begin]) * inverse[begin])

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the bytes from a and from b are the same, for each pair, over its length."""
        out = np.ones(len(a), dtype=bool)
        step = max(1, (1 << 22) // max(1, int(length.max(initial=1))))
        for i in range(0, len(a), step):
            n = length[i : i + step]
            before = np.concatenate([[0], np.cumsum(n)])
            inside = np.arange(before[-1]) - np.repeat(before[:-1], n)
            equal = self.data[np.repeat(a[i : i + step], n) + inside] == self.data[np.repeat(b[i : i + step], n) + inside]
            wrong = np.repeat(np.arange(len(n)), n)[~equal]
            out[i + wrong] = False
        return out

    def text(self) -> bytes:
        return self.data.tobytes()


def pack(data: np.ndarray, offsets: np.ndarray) -> Pack:
    """Normalises the texts: words are the runs of bytes other than 0x20 and 0x09 to 0x0D."""
    inside = ~_GAP[data]
    begin, last = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    at, to = offsets[:-1][filled], offsets[1:][filled] - 1
    begin[at], last[to] = inside[at], inside[to]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    first = np.searchsorted(starts, offsets)
    later = np.ones(len(starts), dtype=bool)
    later[first[:-1][first[:-1] < first[1:]]] = False
    kept = inside.copy()
    kept[starts[later] - 1] = True
    out = data[kept]
    length = ends - starts
    ends = np.cumsum(length + later)
    starts = ends - length
    out[starts[later] - 1] = 0x20
    return Pack(out, starts, ends, first)


def by_row(pack_: Pack, per_word: np.ndarray) -> np.ndarray:
    """The sum of a figure of the words over each row."""
    sums = np.concatenate([[0], np.cumsum(per_word)])
    return sums[pack_.first[1:]] - sums[pack_.first[:-1]]
