"""Benchmark decontamination by template windows.

Numbers, names and units become typed placeholders, so a question that was asked again with other values has the
same template. Windows of template tokens are joined by hash; a match counts only while its slots are consistent:
along one alignment, equal values of the item stand for equal values of the document, and different for different.

Windows that are mostly placeholders say too little as templates, and so do items shorter than a window; they are joined
by their words themselves, with values, so a verbatim copy is found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corrspark.llm.common import as_bytes, documents, slices

NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,/]*(?:st|nd|rd|th|%)?")
JOINED = re.compile(r"([+-]?[$€£]?\d[\d.,]*)([a-zµ°]{1,4})")
NAME = re.compile(r"[^\W\d_a-z][^\W\d_A-Z]+(?:['’-]\w+)*")
#: Words for numbers, and units of measure after a number.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split())
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg lb lbs oz ton tons ml l liter liters litre litres meter meters metre metres gram grams kilogram kilograms second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros pound pounds percent degrees mph kmh hz khz mhz ghz kb mb gb tb w kw v a j kj cal kcal".split()
)
PLAIN, NUM, UNIT, NAMED, BOTH = 0, 1, 2, 3, 4
TYPES = ("", "num", "unit", "name", "num+unit")
_LINE = b"\x01"


@dataclass(frozen=True)
class TemplateRules:
    """``window``: template tokens in a window; ``min_plain``: with fewer words that are no placeholder it counts with its values.

    A document is contaminated by an item if windows with consistent slots run over ``min_run`` tokens, or cover
    ``min_percent`` of the item. ``filter_bits``: size of the bitmap that drops windows no item has.
    """

    window: int = 8
    min_plain: int = 4
    min_run: int = 13
    min_percent: int = 50
    filter_bits: int = 24
    cache_words: int = 300_000


def _rolled(codes: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """A hash of the n codes from each of the places on."""
    value = np.zeros(len(at), np.uint64)
    every = len(at) == len(codes) - n + 1
    with np.errstate(over="ignore"):
        for k in range(n):
            value = (value ^ (codes[k : k + len(at)] if every else codes[at + k])) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(31)
    return value


class Templates:
    """Template tokens of texts, as arrays. A word is looked at once; what it becomes also depends on its neighbours."""

    def __init__(self, rules: TemplateRules):
        self.rules = rules
        self.known: dict[bytes, int] = {}

    def _look(self, word: bytes) -> int:
        """60 bits of the word's hash, then 4 bits: its type (name and unit: if its place allows), or 7 for none; top bit of 4: ends a sentence."""
        if word == _LINE:
            return 15
        core = word.rstrip(b".,")
        if core.isalpha() and core.islower() and len(word) - len(core) < 2:  # most words: ASCII letters and at most a mark
            text = core.decode()
            if text not in NUMBER_WORDS and text not in UNITS:
                return (xxhash.xxh3_64_intdigest(core) >> 4 << 4) | PLAIN | 8 * word.endswith(b".")
        text = word.decode("utf-8", "surrogatepass")
        ends = 8 * bool(re.search(r"[.!?:][\"'”’)\]]*$", text))
        core = re.sub(r"^[^\w$€£+-]+|[^\w%]+$", "", text)
        low = core.lower()
        if not any(map(str.isalnum, core)):
            return 7 | ends
        kind = PLAIN
        if NUMBER.fullmatch(core) or low in NUMBER_WORDS:
            kind = NUM
        elif (m := JOINED.fullmatch(low)) and m[2] in UNITS:
            kind = BOTH
        elif low in UNITS:
            kind = UNIT
        elif NAME.fullmatch(core):
            kind = NAMED
        return (xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass")) >> 4 << 4) | kind | ends

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """Owner (text number), token hash and type of each template token, the words they come from, and their own hashes."""
        known = self.known
        split = [x.replace(b"\x01", b" ").replace(b"\n", b" \x01 ").split() for x in texts]
        new = set().union(*split) - known.keys()
        if len(known) + len(new) > self.rules.cache_words:
            known.clear()
            new = set().union(*split)
        for w in new:
            known[w] = self._look(w)
        words = [w for s in split for w in s]
        owner = np.repeat(np.arange(len(texts)), [len(s) for s in split])
        code = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        kind = (code & np.uint64(7)).astype(np.int8)
        starts = np.ones(len(words), bool)  # after the end of a sentence or line, or first
        starts[1:] = ((code[:-1] & np.uint64(8)) != 0) | (owner[1:] != owner[:-1])
        real = np.flatnonzero(kind != 7)
        # marks between words don't hide that a sentence has ended before them
        since = np.maximum.accumulate(np.where(starts, np.arange(len(words)), 0)) if len(words) else np.empty(0, np.int64)
        last = np.concatenate([[-1], real[:-1]]) if len(real) else real
        first = since[real] > last
        owner, code, kind = owner[real], code[real], kind[real].copy()
        kind[(kind == NAMED) & first] = PLAIN
        after = np.zeros(len(kind), bool)
        after[1:] = (kind[:-1] == NUM) & (owner[1:] == owner[:-1])
        kind[(kind == UNIT) & ~after] = PLAIN
        token = np.where(kind == PLAIN, code >> np.uint64(4), kind.astype(np.uint64) + np.uint64(1))
        return owner, token, kind, [words[i] for i in real] if kind.any() else [], code >> np.uint64(4)

    def windows(self, texts: list[bytes], short: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
        """Owner, first token's number in its text, and hash of each window; then what slots() needs, the windows' sizes last.

        short: also windows of so many tokens with their values, for items that have no more.
        """
        owner, token, kind, words, code = self.tokens(texts)
        begins = np.searchsorted(owner, np.arange(len(texts)))
        owners, places, values, ats, sizes = [], [], [], [], []
        for n in (self.rules.window, *short):
            size = len(token) - n + 1
            if size < 1:
                continue
            if n == self.rules.window:
                plain = np.zeros(size, np.int16)
                for k in range(n):
                    plain += kind[k : k + size] == PLAIN
                value = _rolled(token, n, np.arange(size))
                dense = np.flatnonzero(plain < self.rules.min_plain)
            else:
                value, dense = np.zeros(size, np.uint64), np.arange(size)
            at = np.flatnonzero(owner[:size] == owner[n - 1 :])
            value[dense] = _rolled(code, n, dense) ^ np.uint64(0xA24BAED4963EE407 + n)
            owners.append(owner[at])
            places.append(at - begins[owner[at]])
            values.append(value[at].view(np.int64))
            ats.append(at)
            sizes.append(np.full(len(at), n))
        none = np.empty(0, np.int64)
        joined = [np.concatenate(x) if x else none for x in (owners, places, values, ats, sizes)]
        return joined[0], joined[1], joined[2], (joined[3], kind, words, joined[4])

    def slots(self, at: int, kind: np.ndarray, words: list[bytes], n: int) -> list[str]:
        """type:place:value of the placeholders in the window of n tokens that begins at token ``at``."""
        return [f"{TYPES[kind[at + k]]}:{k}:{words[at + k].decode('utf-8', 'replace').strip('.,;:!?()[]').lower()}" for k in range(n) if kind[at + k]]


def item_windows(benchmark: DataFrame, rules: TemplateRules) -> DataFrame:
    """item_id, item_tokens, item_at, window, item_slots. An item with fewer tokens than a window has one of its own size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(rules)
        for batch in batches:
            texts, ids = as_bytes(batch.column(1)), batch.column(0).to_numpy()
            sizes = np.bincount(templates.tokens(texts)[0], minlength=len(texts))
            short = tuple(n for n in np.unique(sizes).tolist() if 0 < n < rules.window)
            owner, place, value, (at, kind, words, n) = templates.windows(texts, short)
            keep = np.flatnonzero((n == rules.window) | (n == sizes[owner]))
            slots = pa.array([templates.slots(at[i], kind, words, n[i]) for i in keep], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(pa.array(c[keep], pa.int64()) for c in (ids[owner], sizes[owner], place, value)), slots], ["item_id", "item_tokens", "item_at", "window", "item_slots"])

    items = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null")
    return items.mapInArrow(run, "item_id long, item_tokens long, item_at long, window long, item_slots array<string>")


def window_filter(items: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2**bits places: which ends of window hashes occur. Its size is fixed, however large the benchmark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        there = np.zeros(1 << bits, bool)
        for x in batches:
            there[x["window"].to_numpy() & ((1 << bits) - 1)] = True
        yield pd.DataFrame({"part": [np.packbits(there).tobytes()]})

    found = np.zeros((1 << bits) // 8, np.uint8)
    for row in items.select("window").coalesce(8).mapInPandas(run, "part binary").toLocalIterator():
        found |= np.frombuffer(row["part"], np.uint8)
    return np.unpackbits(found).astype(bool)


def document_windows(docs: DataFrame, there: np.ndarray, short: tuple[int, ...], rules: TemplateRules) -> DataFrame:
    """doc_id, text_hash, at, window, slots of the windows that the bitmap lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(there))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates, known = Templates(rules), shared.value
        mask = np.int64(8 * len(known) - 1)
        for batch in batches:
            texts, ids, hashes = as_bytes(batch.column(1)), batch.column(0).to_pylist(), batch.column(2).to_numpy()
            for a, b in slices(texts, 2 << 20):
                owner, place, value, (at, kind, words, n) = templates.windows(texts[a:b], short)
                bit = value & mask
                hit = np.flatnonzero(known[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[a + i] for i in owner[hit]], pa.int64()),
                        pa.array(hashes[a + owner[hit]], pa.int64()),
                        pa.array(place[hit], pa.int64()),
                        pa.array(value[hit], pa.int64()),
                        pa.array([templates.slots(at[i], kind, words, n[i]) for i in hit], pa.list_(pa.string())),
                    ],
                    ["doc_id", "text_hash", "at", "window", "slots"],
                )

    source = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text"))
    return source.mapInArrow(run, "doc_id long, text_hash long, at long, window long, slots array<string>")


def consistent_runs(rows: list[tuple[int, list[str], list[str]]], window: int) -> list[tuple[int, int]]:
    """Ranges of item tokens that windows cover, of one alignment, cut where slots stop to be consistent.

    rows: (place in the item, the item's slots, the document's slots), by place.
    """
    runs: list[list[int]] = []
    there: dict[str, str] = {}
    back: dict[str, str] = {}
    for place, item, doc in rows:
        pairs = []
        for x, y in zip(item, doc, strict=True):
            kind, _, a = x.split(":", 2)
            pairs.append((f"{kind}:{a}", f"{kind}:{y.split(':', 2)[2]}"))
        fits = all(there.get(a, b) == b and back.get(b, a) == a for a, b in pairs) and len(set(pairs)) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
        if not fits or not runs or place > runs[-1][1]:
            there, back = {}, {}
            if len(set(pairs)) != len({a for a, _ in pairs}) or len(set(pairs)) != len({b for _, b in pairs}):
                continue  # the window contradicts itself
            runs.append([place, place + window])
        runs[-1][1] = place + window
        there.update(pairs)
        back.update((b, a) for a, b in pairs)
    return [(a, b) for a, b in runs]


def find_leaks(docs: DataFrame, benchmark: DataFrame, rules: TemplateRules = TemplateRules()) -> DataFrame:
    """One row for each contaminated document and item: doc_id, text_hash, item_id, covered (tokens of the item), longest_run.

    Null texts and texts without a token match nothing; items without id or token are left out. Rows with equal doc_id
    and text are one document, also without an id. Empty tables give an empty table. Other columns are not read.
    """
    items = item_windows(benchmark, rules)
    # of all sizes below a window's at most
    short = tuple(sorted(r["item_tokens"] for r in items.where(F.col("item_tokens") < rules.window).select("item_tokens").distinct().collect()))
    found = document_windows(docs, window_filter(items, rules.filter_bits), short, rules)
    # Both sides are small after the bitmap; Spark picks the join by their measured size
    pairs = found.join(items, "window").where(F.size("slots") == F.size("item_slots"))

    def check(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        covered, longest, size = set(), 0, int(x["item_tokens"].iloc[0])
        for _, part in x.sort_values("item_at").groupby(x["at"] - x["item_at"]):
            rows = list(zip(part["item_at"], part["item_slots"], part["slots"], strict=True))
            for a, b in consistent_runs([r for i, r in enumerate(rows) if not i or r[0] != rows[i - 1][0]], min(rules.window, size)):
                covered.update(range(a, b))
                longest = max(longest, b - a)
        leak = longest >= rules.min_run or 100 * len(covered) >= rules.min_percent * size
        return pd.DataFrame({"doc_id": [key[0]], "text_hash": [key[1]], "item_id": [key[2]], "covered": [len(covered)], "longest_run": [longest]}).head(int(leak))

    return pairs.groupBy("doc_id", "text_hash", "item_id").applyInPandas(check, "doc_id long, text_hash long, item_id long, covered long, longest_run long")


def _same(docs: DataFrame, leaks: DataFrame) -> Column:
    return docs["doc_id"].eqNullSafe(leaks["_id"]) & (F.xxhash64(docs["text"]) == leaks["_hash"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, rules: TemplateRules = TemplateRules()) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns and nothing else."""
    leaks = find_leaks(docs, benchmark, rules).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(leaks, _same(docs, leaks), "left_anti")


def judge(docs: DataFrame, benchmark: DataFrame, rules: TemplateRules = TemplateRules()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, contaminated, n_items, item_ids (sorted), longest_run."""
    leaks = find_leaks(docs, benchmark, rules).groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("longest_run").alias("longest_run"))
    own = docs.select(F.col("doc_id").cast("long"), "text")
    joined = own.join(leaks, _same(own, leaks), "left")
    items = F.coalesce("item_ids", F.array().cast("array<long>"))
    return joined.select("doc_id", (F.size(items) > 0).alias("contaminated"), F.size(items).cast("long").alias("n_items"), items.alias("item_ids"), F.coalesce("longest_run", F.lit(0)).alias("longest_run"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
