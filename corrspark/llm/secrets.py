"""Secret scan: fixed formats, and Shannon entropy in a sliding window over candidate strings.

A candidate is a maximal run of token characters. Its character class (hexadecimal, letters of one case, letters, letters and
digits, or base64 with its marks) sets how many bits a window needs; the window's counts are updated by the character that leaves and
the one that enters. Candidates that the allow-list has are left alone: those that a pattern matches in full, and names, whose letters
follow each other as they do in the corpus.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrspark.llm.common import Reach, as_bytes, as_text, documents

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
CANDIDATE_BYTES = re.compile(CANDIDATE.pattern.encode())


@dataclass(frozen=True)
class EntropyRules:
    """``window``: characters, also the least length of a candidate; bits a window needs, by class. ``name_digits``, ``name_bits``: digits that a
    name may have, and bits a pair of its letters that it must be likelier than chance; ``allow``: patterns of whole candidates that are no secrets.
    """

    window: int = 20
    hex_bits: float = 2.9
    case_bits: float = 3.2
    letter_bits: float = 3.5
    alnum_bits: float = 3.5
    base64_bits: float = 3.6
    name_digits: int = 8
    name_bits: float = 0.25
    allow: tuple[str, ...] = (
        r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUID
        r"[0-9]+([-_/=][0-9]+)*",  # numbers and dates
        r"(?i:your|my|the|key|example|sample|dummy|test|placeholder|changeme|x{4,}|0123456789(abcdef)?|abcdef(ghij(klmnop(qrstuvwxyz)?)?)?|1234567890|[-_/=+])+",  # placeholders
        r"(da39a3ee5e6b4b0d3255bfef95601890afd80709|d41d8cd98f00b204e9800998ecf8427e|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855)",  # digests of nothing
    )


_FOLD = np.full(256, 26, np.uint16)
_FOLD[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)] = _FOLD[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = np.arange(26)


def letter_pairs(docs: DataFrame) -> np.ndarray:
    """(27, 27): how many bits likelier than by chance a letter follows another in words shorter than a candidate, over all documents.

    The last row and column stand for all other characters and count nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27 * 27, np.int64)
        for batch in batches:
            for x in as_bytes(batch.column(0)):
                codes = _FOLD[np.frombuffer(CANDIDATE_BYTES.sub(b" ", x), np.uint8)]
                total += np.bincount(codes[:-1] * np.uint16(27) + codes[1:], minlength=27 * 27)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(27 * 27), pa.int32()), pa.array(total)], ["pair", "n"])

    counts = np.zeros(27 * 27)
    for row in docs.select("text").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 729 rows at most
        counts[row["pair"]] = row["n"]
    counts = counts.reshape(27, 27)[:26, :26] + 0.5
    out = np.zeros((27, 27))
    out[:26, :26] = np.log2(counts / counts.sum(1, keepdims=True) * 26)
    return out


def is_name(word: str, pairs: np.ndarray, rules: EntropyRules) -> bool:
    """Whether the letters follow each other as in the corpus, by ``name_bits`` a pair, with few digits among them."""
    raw = np.frombuffer(word.encode(), np.uint8)
    codes = _FOLD[raw]
    both = (codes[:-1] < 26) & (codes[1:] < 26) & ((raw[:-1] < 97) | (raw[1:] >= 97))  # a capital after a small letter begins a word
    n = int(both.sum())
    digits = sum(map(str.isdigit, word))
    if n < 6 or digits > rules.name_digits or digits * 3 > len(word):
        return False
    return float(pairs[codes[:-1], codes[1:]][both].sum()) >= rules.name_bits * n


def entropy_runs(text: str, bits: float, window: int) -> list[tuple[int, int]]:
    """Merged ranges of the windows whose entropy is at least ``bits``."""
    term = [0.0] + [c * math.log2(c) for c in range(1, window + 2)]  # a character enters before one leaves
    counts: dict[str, int] = {}
    total = 0.0
    runs: list[tuple[int, int]] = []
    for i, char in enumerate(text):
        c = counts.get(char, 0)
        counts[char] = c + 1
        total += term[c + 1] - term[c]
        if i >= window:
            old = text[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += term[c - 1] - term[c]
        if i >= window - 1 and math.log2(window) - total / window >= bits - 1e-9:
            start = i - window + 1
            if runs and start <= runs[-1][1]:
                runs[-1] = (runs[-1][0], i + 1)
            else:
                runs.append((start, i + 1))
    return runs


#: Candidates of one class, and the rule that limits it; the first that holds counts.
CLASSES = ((re.compile(r"[0-9]*[a-f][0-9a-f]*|[0-9]*[A-F][0-9A-F]*"), "hex_bits"), (re.compile(r"[a-z]+|[A-Z]+"), "case_bits"), (re.compile(r"[A-Za-z]+"), "letter_bits"), (re.compile(r"[A-Za-z0-9]+"), "alnum_bits"), (re.compile(r".+"), "base64_bits"))


def allow_list(rules: EntropyRules, pairs: np.ndarray):
    """A function that tells whether a candidate is left alone."""
    listed = re.compile("|".join(f"(?:{x})" for x in rules.allow)).fullmatch if rules.allow else lambda _: None
    return lambda word: bool(listed(word)) or is_name(word, pairs, rules)


def _entropy_spans(text: str, rules: EntropyRules, allowed) -> list[tuple[int, int]]:
    spans = []
    for m in CANDIDATE.finditer(text):
        word = m.group()
        if not allowed(word):
            bits = next(getattr(rules, limit) for chars, limit in CLASSES if chars.fullmatch(word))
            spans += [(m.start() + a, m.start() + b) for a, b in entropy_runs(word, bits, rules.window)]
    return spans


def scan(text: str, rules: EntropyRules, allowed) -> tuple:
    """Counts of the fixed formats, their digest, and all spans."""
    base = []
    if "=" in text or ":" in text:
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    reach = Reach([(a, b) for a, _, b in base])
    more = [(a, 3, b) for a, b in _entropy_spans(text, rules, allowed) if reach.to(a) < b]
    show = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
    kinds = [k for _, k, _ in base]
    return (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(show(base).encode()).hexdigest(), show(sorted(base + more)), len(more))


FIELDS = [
    T.StructField("n_assign", T.LongType()),
    T.StructField("n_access", T.LongType()),
    T.StructField("n_hex", T.LongType()),
    T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()),
    T.StructField("n_entropy", T.LongType()),
]


def find_secrets(docs: DataFrame, rules: EntropyRules = EntropyRules()) -> DataFrame:
    """One row per row of ``docs``: doc_id and FIELDS; positions are code points, ends exclusive.

    A null or empty text has no span; very long ones are scanned whole. Repeated rows and null ids are scanned row by row; other columns are
    not read. An empty table gives an empty table.
    """

    shared = docs.sparkSession.sparkContext.broadcast(letter_pairs(docs))  # 729 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = allow_list(rules, shared.value)
        for batch in batches:
            columns = list(zip(*(scan(x, rules, allowed) for x in as_text(batch.column(1))), strict=True)) or [[] for _ in FIELDS]
            arrays = [pa.array(c, pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for c, f in zip(columns, FIELDS, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *(f.name for f in FIELDS)])

    source = docs.select("doc_id", "text")
    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], *FIELDS]))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))
