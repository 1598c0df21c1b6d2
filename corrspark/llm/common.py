"""What the corpus operators share."""

from __future__ import annotations

import bisect
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_BREAKS = " \t\n\x0b\f\r"
#: Java and Python pattern of a word.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(column):
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(column, _UPPER, _UPPER.lower())


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty. Gives the memory of earlier batches back first."""
    pa.default_memory_pool().release_unused()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_text(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings of a string column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def slices(texts: list[bytes], most: int = 4 << 20) -> list[tuple[int, int]]:
    """Ranges of texts that hold about ``most`` bytes each; a longer text is a range of its own."""
    found, start, held = [], 0, 0
    for i, x in enumerate(texts):
        if i > start and held + len(x) > most:
            found.append((start, i))
            start, held = i, 0
        held += len(x)
    return found + [(start, len(texts))] * (start < len(texts))


class Reach:
    """How far the spans (start, end) that begin at or before a place reach; any number of them is asked in logarithmic time."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self._starts = [a for a, _ in spans]
        self._ends = list(itertools.accumulate((b for _, b in spans), max))

    def to(self, place: int) -> int:
        """The greatest end of a span that starts at ``place`` or before, -1 if none does."""
        i = bisect.bisect_right(self._starts, place)
        return self._ends[i - 1] if i else -1


_LOWER = bytes.maketrans(_UPPER.encode(), _UPPER.lower().encode())


class WordHashes:
    """64-bit hashes of the words of texts, A-Z lower-cased; each distinct word is hashed once while it is remembered."""

    def __init__(self, most: int = 400_000):
        self.known: dict[bytes, int] = {}
        self.most = most

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words' hashes in a row, and where each text begins (one more entry for the end)."""
        hashes, sizes = [np.empty(0, np.uint64)], [0]
        for a, b in slices(texts, 2 << 20):
            split = [x.translate(_LOWER).split() for x in texts[a:b]]
            new = set().union(*split) - self.known.keys()
            if len(self.known) + len(new) > self.most:
                self.known.clear()
                new = set().union(*split)
            for w in new:
                self.known[w] = xxhash.xxh3_64_intdigest(w)
            sizes += map(len, split)
            words = [w for s in split for w in s]
            hashes.append(np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words)))
        return np.concatenate(hashes), np.cumsum(sizes)


def bitmap(hashes: DataFrame, column: str, most_bits: int) -> tuple[bytes, int]:
    """Which ends of a column of 64-bit hashes occur, six places to a printable byte, and how many bits long the ends are.

    It has eight places or more to a row, and 2**most_bits at most: beyond, it lets more through, which a join must drop anyway.
    """
    bits = min(most_bits, max(12, hashes.count().bit_length() + 3))
    there = bytearray(b"@" * (-(-(1 << bits) // 6)))
    at = F.col(column).bitwiseAND((1 << bits) - 1).cast("int")
    sixes = hashes.groupBy(F.floor(at / 6).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), at % 6)).alias("own"))
    for row in sixes.toLocalIterator():
        there[row["at"]] |= row["own"]
    return bytes(there), bits


def in_bitmap(hashed: Column, there: bytes, bits: int) -> Column:
    """True for each hash that the bitmap has, and for some others; for a join that follows."""
    at = hashed.bitwiseAND((1 << bits) - 1).cast("int")
    byte = F.ascii(F.substring(F.lit(there), F.floor(at / 6).cast("int") + 1, F.lit(1)).cast("string"))
    return F.call_function("shiftright", byte, at % 6).bitwiseAND(1) == 1
