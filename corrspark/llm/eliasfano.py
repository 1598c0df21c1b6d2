"""Elias-Fano sequences and a two-level n-gram trie on them, in memory-mapped files, with vectorised access."""

from __future__ import annotations

import os

import numpy as np

#: Place of the k-th set bit in a byte, 8 where there is none.
_SELECT = np.full((256, 8), 8, np.uint8)
for _byte in range(256):
    _bits = [i for i in range(8) if _byte >> i & 1]
    _SELECT[_byte, : len(_bits)] = _bits


def _map(folder: str, name: str, values: np.ndarray) -> np.ndarray:
    """The array, written to a file and mapped."""
    path = os.path.join(folder, f"{name}.npy")
    np.save(path, values)
    return np.load(path, mmap_mode="r")


class Monotone:
    """A non-decreasing sequence of integers below 2**63: low bits packed, high bits in unary."""

    def __init__(self, folder: str, name: str, values: np.ndarray):
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        self.n = n
        self.low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = values & np.uint64((1 << self.low_bits) - 1)
        width = max(1, -(-self.low_bits // 8))
        self.low = _map(folder, f"{name}.low", low.view(np.uint8).reshape(n, 8)[:, :width].copy())
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        unary = np.zeros(int(high[-1]) + n + 1 if n else 1, np.uint8)
        unary[high + np.arange(n)] = 1
        packed = np.packbits(unary, bitorder="little")
        self.high = _map(folder, f"{name}.high", packed)
        self.ranks = _map(folder, f"{name}.ranks", np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[7::8], [n]]) if n else np.zeros(1, np.int64))

    @property
    def n_bytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.ranks.nbytes

    def at(self, i: np.ndarray) -> np.ndarray:
        """Values at the places ``i``."""
        block = np.searchsorted(self.ranks, i, "right") - 1  # eight bytes each
        left = i - self.ranks[block]
        byte = block * 8
        for _ in range(7):
            here = np.bitwise_count(self.high[np.minimum(byte, len(self.high) - 1)]).astype(np.int64)
            go = left >= here
            left = np.where(go, left - here, left)
            byte = np.where(go, byte + 1, byte)
            if not go.any():
                break
        place = byte * 8 + _SELECT[self.high[byte], left]
        value = (place - i) << self.low_bits
        low = self.low[i]
        for k in range(low.shape[1]) if self.low_bits else ():
            value = value | (low[:, k].astype(np.int64) << (8 * k))
        return value

    def find(self, wanted: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of the first value >= wanted in [begin, end), for each; ``end`` if there is none."""
        begin, end = begin.copy(), end.copy()
        todo = np.flatnonzero(begin < end)
        while len(todo):
            middle = (begin[todo] + end[todo]) // 2
            less = self.at(middle) < wanted[todo]
            begin[todo[less]] = middle[less] + 1
            end[todo[~less]] = middle[~less]
            todo = todo[begin[todo] < end[todo]]
        return begin


class Quantised:
    """Numbers as one byte each: the mean of those nearest to one of 64 quantiles or 192 even steps, moved to it thrice."""

    def __init__(self, folder: str, name: str, values: np.ndarray):
        steps = [np.quantile(values, np.linspace(0, 1, 64)), np.linspace(values.min(), values.max(), 192)] if len(values) else [np.zeros(1)]
        self.book = np.unique(np.concatenate(steps))
        for _ in range(3):
            codes = np.clip(np.searchsorted((self.book[1:] + self.book[:-1]) / 2, values), 0, len(self.book) - 1)
            n = np.bincount(codes, minlength=len(self.book))
            self.book = np.where(n, np.bincount(codes, values, len(self.book)) / np.maximum(n, 1), self.book)
        self.codes = _map(folder, f"{name}.codes", codes.astype(np.uint8))

    def at(self, i: np.ndarray) -> np.ndarray:
        return self.book[self.codes[i]]


class NgramTrie:
    """Contexts, their successors, and a value for each of both.

    contexts: sorted distinct codes. pairs: sorted distinct (context place, successor code). A context's successors are
    stored relative to it: each range is lifted above the one before, so that all of them are one monotone sequence.
    """

    def __init__(self, folder: str, contexts: np.ndarray, context_values: np.ndarray, place: np.ndarray, successor: np.ndarray, pair_values: np.ndarray, universe: int):
        self.universe = universe
        self.contexts = Monotone(folder, "contexts", contexts)
        self.starts = Monotone(folder, "starts", np.searchsorted(place, np.arange(len(contexts) + 1)))
        self.successors = Monotone(folder, "successors", place.astype(np.int64) * universe + successor)
        self.context_values = Quantised(folder, "context-values", context_values)
        self.pair_values = Quantised(folder, "pair-values", pair_values)

    def look(self, context: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each query: is the context there, its value, is the pair there, its value (0 where it is not)."""
        n = len(context)
        begin, end = np.zeros(n, np.int64), np.full(n, self.contexts.n, np.int64)
        place = self.contexts.find(context, begin, end)
        known = place < self.contexts.n
        known[known] = self.contexts.at(place[known]) == context[known]
        values, found, pair_values = np.zeros(n), np.zeros(n, bool), np.zeros(n)
        own = np.flatnonzero(known)
        if len(own):
            values[own] = self.context_values.at(place[own])
            first, last = self.starts.at(place[own]), self.starts.at(place[own] + 1)
            wanted = place[own] * self.universe + successor[own]
            at = self.successors.find(wanted, first, last)
            hit = at < last
            hit[hit] = self.successors.at(at[hit]) == wanted[hit]
            found[own] = hit
            pair_values[own[hit]] = self.pair_values.at(at[hit])
        return known, values, found, pair_values
