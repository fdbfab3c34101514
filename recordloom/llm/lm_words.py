"""Words of a text coded bit by bit by logistic mixing of hashed-context predictors whose contexts run across words."""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from recordloom.llm.text_arrays import scramble

#: Symbols: the end of a text, any word without a code, then the words with a code, the most frequent first.
END, OTHER, WORDS = 0, 1, 2
#: Bits of the table of each hashed predictor: the last very frequent word, the last word, the last two words.
TABLE_BITS = (19, 20, 21)
#: So many words tell the kind of a text, however far back they stand.
MARKS = 64
#: Symbols that are worked on at once. In learning counts and weights are those before the step, so steps begin
#: small and grow with what has been learned.
STEP = 1 << 11
FIRST_STEP = 1 << 8
RATE = 0.05
_K = len(TABLE_BITS)
_HASH_BITS = max(TABLE_BITS)
_LEVELS = 8
GATES = _LEVELS * _LEVELS
_STEPS = 33
_SURE = np.float32(1e-6)
#: Which half of a number of 64 bits the low bits are.
_LOW = 0 if sys.byteorder == "little" else 1


@dataclass
class Code:
    """A prefix code: from ``first`` on stand the ``length`` nodes (their hashes) and bits of a symbol. ``odds`` holds
    the stretched chance of a 1 at each of these nodes without context."""

    first: np.ndarray
    length: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    odds: np.ndarray
    #: A hash of each symbol in each kind of context; those of contexts and nodes are joined bit by bit.
    hashes: np.ndarray


def _hashed(x: np.ndarray) -> np.ndarray:
    return (scramble(x) >> np.uint64(64 - _HASH_BITS)).astype(np.int64)


def prefix_code(counts: np.ndarray) -> Code:
    """Huffman's code of two symbols or more, each counted, so a text has few bits; equal counts go by symbol."""
    n = len(counts)
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    above, bit, odds = [0] * (2 * n - 1), [0] * (2 * n - 1), [0.0] * (2 * n - 1)
    for node in range(n, 2 * n - 1):
        (one, a), (zero, b) = heapq.heappop(heap), heapq.heappop(heap)
        above[a] = above[b] = node
        bit[a] = 1
        odds[node] = float(np.log(one / zero))
        heapq.heappush(heap, (one + zero, node))
    nodes, bits, first = [], [], [0]
    for symbol in range(n):
        way = []
        while symbol != 2 * n - 2:
            way.append((above[symbol], bit[symbol]))
            symbol = above[symbol]
        nodes += [x for x, _ in reversed(way)]
        bits += [x for _, x in reversed(way)]
        first.append(len(nodes))
    places, nodes = np.array(first), np.array(nodes)
    return Code(places[:-1], np.diff(places), _hashed(nodes.astype(np.uint64)), np.array(bits, np.float32), np.array(odds, np.float32)[nodes], _hashed(np.arange((_K + 1) * n, dtype=np.uint64) + (np.uint64(1) << np.uint64(56))).reshape(-1, n))


def last_words(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Before each symbol of whole texts that follow each other: the last very frequent word, the last word and the one
    before it; no context reaches into another text."""
    before = np.concatenate([[END], symbols[:-1]])
    second = np.where(before == END, END, np.concatenate([[END], before[:-1]]))
    mark = np.where((before < WORDS + MARKS) & (before != OTHER), np.arange(len(symbols)), 0)
    return before.take(np.maximum.accumulate(mark)), before, second


def contexts(code: Code, marked: np.ndarray, before: np.ndarray, second: np.ndarray) -> list[np.ndarray]:
    """Hashes per predictor and symbol."""
    of_mark, of_one, of_two, of_second = code.hashes
    return [of_mark.take(marked), of_one.take(before), of_two.take(before) ^ of_second.take(second)]


def distinct(n: int, symbols: np.ndarray, marked: np.ndarray, before: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place for each of ``n`` symbols after the same words, in order of these, and which of them each place is."""
    every = np.arange(len(symbols))
    if (WORDS + MARKS) * n**3 >= 1 << 63:  # no number holds all four
        return every, every
    found, which = np.unique(((marked * n + second) * n + before) * n + symbols, return_inverse=True)
    one = np.empty(len(found), np.int64)
    one[which] = every
    return one, which


def _steps(code: Code, symbols: np.ndarray, hashes: list[np.ndarray], step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Per step: where each symbol's bits begin, their places in the code, the bits, their slots per predictor."""
    for i in range(0, len(symbols), step):
        now = symbols[i : i + step]
        length = code.length.take(now)
        begin = np.cumsum(length) - length
        place = np.arange(int(length.sum())) + np.repeat(code.first.take(now) - begin, length)
        node = code.nodes.take(place)
        slots = []
        for h, bits in zip(hashes, TABLE_BITS, strict=True):
            slot = np.repeat(h[i : i + step], length)
            slot ^= node
            slot >>= _HASH_BITS - bits
            slots.append(slot)
        yield begin, place, code.bits.take(place), slots


def _stretched(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + np.float32(0.05)) / (zeros + np.float32(0.05)))


def _level(n: np.ndarray) -> np.ndarray:
    """How often a slot was met: the whole part of the logarithm to base 2, 7 at most."""
    return np.minimum((n + np.float32(1)).astype(np.float32, copy=False).view(np.int32) >> 23, 127 + _LEVELS - 1) - 127


def _mixed(weights: np.ndarray, gate: np.ndarray, inputs: list[np.ndarray]) -> np.ndarray:
    x = weights[-1].take(gate)
    for of_input, column in zip(weights, inputs, strict=False):
        x += of_input.take(gate) * column
    return x


def _squash(x: np.ndarray) -> np.ndarray:
    return np.float32(1) / (np.float32(1) + np.exp(-np.clip(x, -16, 16)))


def _cells(gate: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of the adaptive map below each x, and how near the next one is."""
    place = (np.clip(x, -8, 8) + np.float32(8)) * np.float32((_STEPS - 1) / 16)
    low = np.minimum(place.astype(np.int64), _STEPS - 2)
    return gate * _STEPS + low, place - low


def _refined(refined: np.ndarray, cell: np.ndarray, share: np.ndarray) -> np.ndarray:
    low = refined.take(cell)
    return low + (refined.take(cell + 1) - low) * share


def side_by_side(counts: np.ndarray) -> np.ndarray:
    return np.stack([counts & 0xFFFFFFFF, counts >> 32], axis=1)


class Learner:
    """One online pass over texts: each step is predicted from what stood before it, then learned.

    Predictors count zeros and ones per slot. Weights of the mixer move with the errors, the steps of a weight
    shrink with the squares of its past ones; the adaptive map follows the mixed predictions.
    """

    def __init__(self, code: Code):
        self.code = code
        #: Per predictor and slot the zeros, and times 2^32 the ones: one look-up reads both.
        self.counts = [np.zeros(1 << bits, np.int64) for bits in TABLE_BITS]
        #: What each place of the code adds to them.
        self.one = np.where(code.bits > 0, 1 << 32, 1)
        #: Per input (without context, the hashed predictors, a bias) and gate; at first the code's own odds count most.
        self.weights = np.repeat(np.array([0.6, *[0.4 / _K] * _K, 0], np.float32)[:, None], GATES, axis=1)
        self.squares = np.full(self.weights.shape, 1e-2)
        grid = _squash((np.arange(_STEPS, dtype=np.float32) - (_STEPS - 1) / 2) * 16 / (_STEPS - 1))
        self.refined = np.tile(grid, GATES).astype(np.float32)
        self.seen = np.zeros(GATES)
        self.learned = 0

    def learn(self, symbols: np.ndarray) -> None:
        step = min(STEP, max(FIRST_STEP, self.learned >> 7))
        self.learned += len(symbols)
        for _, place, bit, slots in _steps(self.code, symbols, contexts(self.code, *last_words(symbols)), step):
            inputs, levels = [self.code.odds.take(place)], []
            for counts, slot in zip(self.counts, slots, strict=True):
                met = counts.take(slot).view(np.int32).astype(np.float32)
                zeros, ones = met[_LOW::2], met[1 - _LOW :: 2]
                levels.append(_level(zeros + ones) if levels else None)
                inputs.append(_stretched(zeros, ones))
            gate = (levels[1] * _LEVELS + levels[2]).astype(np.int64)
            x = _mixed(self.weights, gate, inputs)
            error = bit - _squash(x)
            change = np.stack([np.bincount(gate, error * column, GATES) for column in inputs] + [np.bincount(gate, error, GATES)])
            self.squares += change * change
            self.weights += (RATE * change / np.sqrt(self.squares)).astype(np.float32)
            cell, share = _cells(gate, x)
            miss = (bit - _refined(self.refined, cell, share)) * np.float32(0.02)
            up = miss * share
            moved = np.bincount(cell, miss - up, GATES * _STEPS) + np.bincount(cell + 1, up, GATES * _STEPS)
            self.refined = np.clip(self.refined + moved, _SURE, 1 - _SURE).astype(np.float32)
            self.seen += np.bincount(gate, minlength=GATES)
            one = self.one.take(place)
            for counts, slot in zip(self.counts, slots, strict=True):
                np.add.at(counts, slot, one)

    def pairs(self) -> list[np.ndarray]:
        """Per predictor the zeros and ones of each slot, side by side."""
        return [*map(side_by_side, self.counts)]

    def sums(self) -> np.ndarray:
        """Weights and map of each gate times the bits it saw, so runs can be averaged."""
        return np.concatenate([self.seen, (self.weights * self.seen).ravel(), (self.refined.reshape(GATES, -1) * self.seen[:, None]).ravel()])


#: Numbers that ``Learner.sums`` holds.
SUMS = GATES * (1 + _K + 2 + _STEPS)


class Mixer:
    """What all runs learned: tables of stretched predictions, how often slots were met, weights and map."""

    def __init__(self, code: Code, counts: list[np.ndarray], sums: np.ndarray):
        start = Learner(code)
        seen = sums[:GATES]
        times = np.maximum(seen, 1)
        weights = sums[GATES : GATES * (_K + 3)].reshape(-1, GATES) / times
        refined = sums[GATES * (_K + 3) :].reshape(GATES, -1) / times[:, None]
        self.code = code
        self.weights = np.where(seen > 0, weights, start.weights).astype(np.float32)
        self.refined = np.where(seen[:, None] > 0, refined, start.refined.reshape(GATES, -1)).astype(np.float32).ravel()
        # The lowest three bits of a stretched prediction hold how often its slot was met: one look-up reads both.
        self.odds = [_stretched(c[:, 0].astype(np.float32), c[:, 1].astype(np.float32)) for c in counts]
        for odds, c in zip(self.odds, counts, strict=True):
            odds.view(np.int32)[:] = (odds.view(np.int32) & ~(_LEVELS - 1)) | _level(c.sum(axis=1))

    def ones(self, odds: np.ndarray, slots: list[np.ndarray]) -> np.ndarray:
        """The chance of a 1: mixed by the weights of the gate, then averaged with its refined value."""
        inputs = [table.take(slot) for table, slot in zip(self.odds, slots, strict=True)]
        once, twice = (x.view(np.int32) & (_LEVELS - 1) for x in inputs[1:])
        gate = (once * _LEVELS + twice).astype(np.int64)
        x = _mixed(self.weights, gate, [odds, *inputs])
        return np.clip((_squash(x) + _refined(self.refined, *_cells(gate, x))) * np.float32(0.5), _SURE, 1 - _SURE)

    def log10_symbols(self, symbols: np.ndarray) -> np.ndarray:
        """log10 of the chance of each symbol after those before it in its text; what stands after the same words more
        than once is predicted once."""
        words = last_words(symbols)
        one, which = distinct(len(self.code.first), symbols, *words)
        out = []
        for begin, place, bit, slots in _steps(self.code, symbols.take(one), contexts(self.code, *(w.take(one) for w in words))):
            p = self.ones(self.code.odds.take(place), slots)
            out.append(np.add.reduceat(np.log(np.where(bit > 0, p, 1 - p)), begin, dtype=np.float64))
        return np.concatenate(out).take(which) / np.log(10) if out else np.zeros(0)
