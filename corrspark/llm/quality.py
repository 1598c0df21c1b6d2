"""Quality rules: bands of zstandard compression ratios over whole documents and fixed chunks.

Repetitive text compresses too well and noise hardly at all. What counts as too much depends on the length,
so each length band has its own limits, for the document and for each of its chunks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from corrspark.llm.common import as_bytes, documents


@dataclass(frozen=True)
class QualityRules:
    """``bands``: (bytes from, least ratio, greatest ratio); a text is held to the last band that starts at or below its length.

    ``chunk_bytes``: size of the fixed chunks; a last one under a quarter of it is judged with the document only.
    ``bad_chunk_percent``: a document goes when more than this share of its chunks is outside the limits.
    """

    bands: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 9.9),
        (128, 0.95, 1.9),
        (256, 1.1, 2.1),
        (512, 1.25, 2.3),
        (1024, 1.4, 2.45),
        (2048, 1.5, 2.6),
        (4096, 1.6, 2.8),
        (16384, 1.7, 3.2),
        (65536, 1.7, 3.6),
    )
    level: int = 3
    chunk_bytes: int = 4096
    bad_chunk_percent: int = 50
    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    symbols: bytes = field(default=b"#*$%&|<>")

    def limits(self, n: int) -> tuple[float, float]:
        return next((low, high) for start, low, high in reversed(self.bands) if n >= start)


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
    T.StructField("ratio", T.DoubleType()),
    T.StructField("n_chunks", T.LongType()),
    T.StructField("n_bad_chunks", T.LongType()),
    T.StructField("reason", T.StringType()),
]


def _repeat_words(words: list[bytes], window: int) -> int:
    """Words inside windows that occur at least twice in the text."""
    grams = list(zip(*(words[i:] for i in range(window)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    seen = Counter(grams)
    total, end = 0, 0
    for i, gram in enumerate(grams):
        if seen[gram] > 1:
            total += i + window - max(end, i)
            end = i + window
    return total


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def judge(text: bytes, rules: QualityRules, compress) -> tuple:
    """The values of FIELDS for one text."""
    words = text.split()
    joined = b"".join(words)
    n_symbols = len(text) - len(text.translate(None, rules.symbols))
    repeats = _repeat_words(words, rules.window)
    base_failed = len(words) < rules.min_words or 100 * repeats > rules.max_repeat_percent * len(words)

    low, high = rules.limits(len(text))
    ratio = len(text) / len(compress(text)) if text else 0.0
    chunks = [text[i : i + rules.chunk_bytes] for i in range(0, len(text), rules.chunk_bytes)]
    if len(chunks) > 1 and 4 * len(chunks[-1]) < rules.chunk_bytes:
        chunks.pop()
    bad = 0
    for chunk in chunks if len(chunks) > 1 else []:
        least, most = rules.limits(len(chunk))
        bad += not least <= len(chunk) / len(compress(chunk)) <= most
    reason = "base" if base_failed else "incompressible" if ratio < low else "repetitive" if ratio > high else "chunks" if 100 * bad > rules.bad_chunk_percent * len(chunks) else None
    return (len(words), len(joined.decode("utf-8", "surrogatepass")), n_symbols, _dup_lines(text), repeats, base_failed, reason is None, ratio, len(chunks), bad, reason)



def measure(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per row of ``docs``: doc_id and FIELDS.

    A null text counts as empty, fails the base rule and has ratio 0. Repeated rows and null ids are judged row by row.
    Other columns are not read. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=rules.level).compress
        for batch in batches:
            rows = [judge(x, rules, compress) for x in as_bytes(batch.column(1))]
            columns = list(zip(*rows, strict=True)) or [[] for _ in FIELDS]
            kinds = {T.LongType: pa.int64(), T.BooleanType: pa.bool_(), T.DoubleType: pa.float64(), T.StringType: pa.string()}
            arrays = [pa.array(c, kinds[type(f.dataType)]) for c, f in zip(columns, FIELDS, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *(f.name for f in FIELDS)])

    source = docs.select("doc_id", "text")
    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], *FIELDS]))


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns and nothing else.

    Each row is judged where it is read, without a join; null and repeated ids are no special case, and a
    column of any name passes through.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=rules.level).compress
        for batch in batches:
            yield batch.filter(pa.array([judge(x, rules, compress)[6] for x in as_bytes(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(documents(spark, sf_dir))
