"""Packing of tokenised documents into fixed windows by non-negative least squares.

Documents are tokenised where they are read and cut at the window's size, which leaves one rest piece each.
The histogram of piece lengths, in bins of a few tokens, has a fixed number of entries. On it the driver
enumerates shallow combinations of bins that fill a window, solves how often to repeat each by non-negative
least squares, rounds down and packs what is left greedily. The plan says which ranks of a bin go to which
sequences, so that each piece finds its place from its rank alone.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrspark.llm.common import as_bytes, documents
from corrspark.session import cut


@dataclass(frozen=True)
class PackingRules:
    """``tokenizer``: a file, or the name of one among the installed public tokenizers. ``window``: tokens in a sequence.

    ``bin_tokens``: width of a length bin. ``cache_words``: encoded words that a task keeps.
    """

    tokenizer: str = "word_bpe_49k.json"
    window: int = 4096
    end_id: int = 2
    bin_tokens: int = 16
    cache_words: int = 1_000_000
    sweeps: int = 60


#: Marks that the tokenizers here keep apart from letters and digits, so that the ids of a word are those of what ends in one and of
#: the marks after it. Marks after any other character may be one piece with it, so such a word is encoded whole.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordEncoder(dict):
    """Token ids of words, as little-endian 32-bit bytes; each distinct word is encoded when it is first asked for.

    The vocabulary has no token across white space, so a text's ids are its words' ids in a row. Words of letters go to
    the tokenizer's steps one by one, which is what its encode() does, without the offsets that it keeps besides.
    """

    def __init__(self, rules: PackingRules):
        import os

        from tokenizers import Tokenizer

        super().__init__()
        path = rules.tokenizer
        if not os.path.isabs(path):
            import public_tokenizers

            path = public_tokenizers.path(path)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._whole = Tokenizer.from_file(path)
        self._split, self._tokens = self._whole.pre_tokenizer.pre_tokenize_str, self._whole.model.tokenize
        self._most = rules.cache_words
        added = [re.escape(x.content.encode()) for x in self._whole.get_added_tokens_decoder().values()]
        self._added = re.compile(b"|".join(added)).search if added else lambda _: None
        # whether letters stay letters, lower-cased, and marks after them make a piece of their own
        alphabet = "abcdefghijklmnopqrstuvwxyz"
        self._clean = self._whole.normalizer.normalize_str if self._whole.normalizer else str
        self._plain = self._clean(alphabet.upper()) == alphabet and all([x for x, _ in self._split(alphabet + mark)] == [alphabet, mark] for mark in MARKS.decode())

    def _apart(self, core: bytes) -> bool:
        """Whether marks after ``core`` are a piece of their own: it ends in a letter or digit, and still does when normalised."""
        if core[-1:].isalnum():  # ASCII
            return True
        last = self._clean(core.decode()[-1:])
        return unicodedata.category(last[-1:] or " ")[0] in "LN"

    def __missing__(self, word: bytes) -> bytes:
        core = word.rstrip(MARKS)
        if not self._plain or self._added(word):
            ids = self._whole.encode(word.decode(), add_special_tokens=False).ids
        elif core and len(core) < len(word) and self._apart(core):
            self[word] = found = self[core] + self[word[len(core) :]]
            return found
        elif word.isalpha():  # ASCII letters
            ids = [x.id for x in self._tokens(word.lower().decode())]
        elif (text := word.decode()).isalpha() and text.islower() and unicodedata.is_normalized("NFC", text):
            ids = [x.id for piece, _ in self._split(text) for x in self._tokens(piece)]
        else:
            ids = self._whole.encode(text, add_special_tokens=False).ids
        self[word] = found = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        known = self.__getitem__
        for i, text in enumerate(texts):
            if i % 256 == 0 and len(self) > self._most:
                self.clear()
            yield b"".join(map(known, text.split()))


PIECE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("bin", T.IntegerType()),
        T.StructField("task", T.LongType()),
        T.StructField("task_rank", T.LongType()),
    ]
)


def pieces(docs: DataFrame, rules: PackingRules) -> DataFrame:
    """Each document's ids, cut at the window's size; task_rank counts the pieces of a bin that the task has made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(rules)
        task = TaskContext.get().partitionId()
        end = np.array([rules.end_id], "<u4").tobytes()
        made = [0] * (rules.window // rules.bin_tokens + 2)
        step = 4 * rules.window
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(as_bytes(batch.column(1))), strict=True):
                ids += end
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    n = len(part) // 4
                    kind = -(-n // rules.bin_tokens)
                    rows.append((doc, at // 4, n, zlib.crc32(part), len(ids) // 4, kind, task, made[kind]))
                    made[kind] += 1
            columns = list(zip(*rows, strict=True)) or [[] for _ in PIECE]
            kinds = [pa.int32() if f.name == "bin" else pa.int64() for f in PIECE]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], PIECE.names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE)


def combinations(full: int, present: list[int]) -> list[dict[int, int]]:
    """Ways to fill ``full`` bins exactly from at most three lengths: one repeated, the others once."""
    there = set(present)
    found: dict[tuple, dict[int, int]] = {}
    for a in present:
        for times in range(1, full // a + 1):
            rest = full - times * a
            pairs = [()] if rest == 0 else [(rest,)] if rest in there else []
            if times <= 2:
                pairs += [(b, rest - b) for b in present if 2 * b <= rest and rest - b in there]
            for more in pairs:
                ways = {a: times}
                for b in more:
                    ways[b] = ways.get(b, 0) + 1
                found[tuple(sorted(ways.items()))] = ways
    return list(found.values())


def non_negative_counts(columns: list[dict[int, int]], histogram: np.ndarray, sweeps: int) -> np.ndarray:
    """Non-negative least squares by coordinate descent: min |A x - h| with x >= 0, columns of A being combinations."""
    x = np.zeros(len(columns))
    rest = histogram.astype(float).copy()
    parts = [(np.array(list(c)), np.array(list(c.values()), float)) for c in columns]
    norms = [float(v @ v) for _, v in parts]
    for _ in range(sweeps):
        moved = 0.0
        for j, (at, v) in enumerate(parts):
            step = max(-x[j], float(v @ rest[at]) / norms[j])
            if step:
                x[j] += step
                rest[at] -= step * v
                moved = max(moved, abs(step))
        if moved < 0.5:
            break
    return x


def plan(histogram: np.ndarray, full: int, sweeps: int) -> list[tuple[int, dict[int, int]]]:
    """(repeats, {bin: pieces}) that use up the histogram (index: bin) exactly."""
    left = histogram.astype(np.int64).copy()
    present = [b for b in range(1, full + 1) if left[b]]
    columns = combinations(full, present)
    solved = non_negative_counts(columns, left, sweeps)
    patterns = []
    for j in np.argsort(-solved, kind="stable"):
        times = min([int(solved[j] + 1e-9), *(int(left[b]) // n for b, n in columns[j].items())])
        if times > 0:
            patterns.append((times, columns[j]))
            for b, n in columns[j].items():
                left[b] -= times * n
    while left.any():  # the longest piece first, then the longest that fits, as often as it fits
        ways: dict[int, int] = {}
        room = full
        for b in range(full, 0, -1):
            n = min(room // b, int(left[b]))
            if n:
                ways[b] = n
                room -= n * b
        times = min(int(left[b]) // n for b, n in ways.items())
        patterns.append((times, ways))
        for b, n in ways.items():
            left[b] -= times * n
    return patterns


def pack(docs: DataFrame, rules: PackingRules = PackingRules()) -> DataFrame:
    """Pieces of all documents with their sequence_id and offset.

    A null or empty text is one piece that holds the end id alone. Repeated rows are packed each; a null id
    stays null. Other columns are not read. An empty table gives an empty table.
    """
    full = rules.window // rules.bin_tokens
    table = cut(pieces(docs, rules), "pieces")
    by_task = cut(table.groupBy("bin", "task").count(), "piece-counts")
    histogram = np.zeros(full + 1, np.int64)
    for row in by_task.groupBy("bin").agg(F.sum("count").alias("n")).collect():  # a row for each bin at most
        histogram[row["bin"]] = row["n"]

    runs: dict[int, list[tuple[int, int, int, int]]] = {b: [] for b in range(full + 1)}
    used, sequence = [0] * (full + 1), 0
    for times, ways in plan(histogram, full, rules.sweeps):
        slot = 0
        for b, n in sorted(ways.items(), reverse=True):
            runs[b].append((used[b], sequence, n, slot))
            used[b] += times * n
            slot += n
        sequence += times
    starts = {b: np.array(r, np.int64).reshape(-1, 4) for b, r in runs.items() if r}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rank, bins = x["rank"].to_numpy(), x["bin"].to_numpy()
            sequences, slots = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            for b in np.unique(bins):
                own = np.flatnonzero(bins == b)
                run = starts[b][np.searchsorted(starts[b][:, 0], rank[own], "right") - 1]
                ahead = rank[own] - run[:, 0]
                sequences[own] = run[:, 1] + ahead // run[:, 2]
                slots[own] = run[:, 3] + ahead % run[:, 2]
            yield x.drop(columns=["bin", "rank"]).assign(sequence_id=sequences, slot=slots)

    # a few rows for each task of the first stage, however many pieces a bin has
    before = Window.partitionBy("bin").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("bin", "task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    ranked = table.join(offsets, ["bin", "task"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", (F.col("ahead") + F.col("task_rank")).alias("rank"))
    schema = T.StructType([*(f for f in PIECE if f.name not in ("bin", "task", "task_rank")), T.StructField("sequence_id", T.LongType()), T.StructField("slot", T.LongType())])
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return ranked.mapInPandas(place, schema).withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).drop("slot")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
