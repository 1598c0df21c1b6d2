"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A text's words are seen in two ways: as they are, A-Z lower-cased, and by their shape (``Aa``, ``a,``, ``A!!``). One and two
successive words of each kind, with a word's repetition as a pair of its own, are hashed into a fixed number of weights. A bounded
sample of labelled rows is dealt to few shards, each learns by itself, and the mean of their weights scores all texts as sparse
dot products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrspark.llm.common import as_bytes, documents, slices
from corrspark.session import cut


@dataclass(frozen=True)
class Training:
    """``sample``: labelled rows to learn from at most, the first by a hash of their id. ``buckets``: weights, a power of two.

    ``alpha``, ``beta``, ``l1``, ``l2``: of the updates. ``shard``: rows that one model learns from. ``held_out``: ids whose checksum has
    ``held_rest`` as its remainder by it teach nothing. ``remembered``: words whose hashes a task keeps.
    """

    sample: int = 20_000
    buckets: int = 1 << 20
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.01
    l2: float = 0.01
    passes: int = 4
    shard: int = 2_500
    held_out: int = 3
    held_rest: int = 1
    remembered: int = 400_000


_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_NEXT, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shape(word: str) -> str:
    """Runs of upper-case letters as A, of other letters as a, of digits as 0; all else stays, but a run of one mark is three at most."""
    if word.isalpha() and (word.islower() or word.isupper() or word[0].isupper() and word[1:].islower()):
        return "a" if word.islower() else "A" if word.isupper() else "Aa"
    out: list[str] = []
    for x in word:
        kind = "A" if x.isupper() else "a" if x.isalpha() else "0" if x.isdigit() else x
        if out[-1:] != [kind] or not (kind in "Aa0" or out[-3:] == [kind] * 3):
            out.append(kind)
    return "".join(out)


class Features:
    """Hashed n-grams of texts; each distinct word is hashed once while it is remembered."""

    def __init__(self, t: Training):
        self.t = t
        self.known: dict[bytes, int] = {}
        self.hashes = np.empty((2, 1024), np.uint64)

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        """(2, words): of the words and of their shapes."""
        new = list(set(words) - self.known.keys())
        if len(self.known) + len(new) > self.t.remembered:
            self.known.clear()
            new = list(set(words))
        first = len(self.known)
        while first + len(new) > self.hashes.shape[1]:
            self.hashes = np.concatenate([self.hashes, np.empty_like(self.hashes)], axis=1)
        self.known.update(zip(new, range(first, first + len(new)), strict=True))
        digest = xxhash.xxh3_64_intdigest
        self.hashes[0, first : first + len(new)] = np.fromiter((digest(w.translate(_LOWER)) for w in new), np.uint64, len(new))
        forms = (shape(w.decode("utf-8", "surrogatepass")) for w in new)
        self.hashes[1, first : first + len(new)] = np.fromiter((digest(x.encode("utf-8", "surrogatepass"), seed=1) for x in forms), np.uint64, len(new))
        return self.hashes[:, np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]

    def of(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text its buckets, ascending, and their values: 1 + log of the count, of length 1 as a vector."""
        for a, b in slices(texts, 2 << 20):
            split = [x.split() for x in texts[a:b]]
            hashes = self._hashes([w for s in split for w in s])
            at = 0
            for words in split:
                own = hashes[:, at : at + len(words)]
                at += len(words)
                with np.errstate(over="ignore"):
                    pairs = (own[:, :-1] * _NEXT + own[:, 1:]) * _MIX
                    pairs[0, own[0, :-1] == own[0, 1:]] = _NEXT
                    keys = np.concatenate([own.ravel(), (pairs ^ (pairs >> np.uint64(31))).ravel()])
                found, counts = np.unique((keys & np.uint64(self.t.buckets - 1)).astype(np.int64), return_counts=True)
                values = 1 + np.log(counts)
                yield found, values / max(1e-12, float(np.sqrt(values @ values)))


class Leader:
    """Weights by follow-the-regularised-leader updates, one example at a time; the last weight is the bias."""

    def __init__(self, t: Training):
        self.t = t
        self.z, self.n = np.zeros(t.buckets + 1), np.zeros(t.buckets + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n, t = self.z[at], self.n[at], self.t
        return np.where(np.abs(z) <= t.l1, 0.0, (np.sign(z) * t.l1 - z) / ((t.beta + np.sqrt(n)) / t.alpha + t.l2))

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        at, values = np.append(at, self.t.buckets), np.append(values, 1.0)
        w = self.weights(at)
        g = (_sigmoid(float(w @ values)) - label) * values
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.t.alpha * w
        self.n[at] = n + g * g


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -500, 500))))


def _learns(t: Training):
    return F.crc32(F.col("doc_id").cast("string")) % t.held_out != t.held_rest


def examples(docs: DataFrame, labels: DataFrame, t: Training) -> DataFrame:
    """doc_id, place, label, buckets, values: the labelled rows to learn from, as features."""
    place = F.xxhash64("doc_id")
    taught = labels.where(F.col("quality").isin(0, 1) & _learns(t)).select("doc_id", F.col("quality").cast("int").alias("label")).distinct()
    taught = taught.withColumn("place", place).orderBy("place", "doc_id", "label").limit(t.sample)
    # of a fixed size at most
    rows = docs.select("doc_id", "text").join(F.broadcast(taught), "doc_id").select("doc_id", "place", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(t)
        for batch in batches:
            found = list(features.of(as_bytes(batch.column(3))))
            arrays = [pa.array([a.astype("<i4").tobytes() for a, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *arrays], ["doc_id", "place", "label", "buckets", "values"])

    made = rows.mapInArrow(run, "doc_id long, place long, label int, buckets binary, values binary")
    # of rows that share an id, one teaches
    return made.groupBy("doc_id", "place", "label").agg(F.min(F.struct("buckets", "values")).alias("x")).select("doc_id", "place", "label", "x.buckets", "x.values")


def train(docs: DataFrame, labels: DataFrame, t: Training = Training()) -> np.ndarray:
    """Mean weights of the shards' models; all 0 where nothing is labelled."""

    def fit(x: pa.Table) -> pa.Table:
        rows = sorted(zip(*(x.column(c).to_pylist() for c in ("place", "doc_id", "label", "buckets", "values")), strict=True))
        parsed = [(np.frombuffer(b, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(float), y) for _, _, y, b, v in rows]
        model, rng = Leader(t), np.random.default_rng(0)
        for _ in range(t.passes):
            for i in rng.permutation(len(parsed)):
                model.learn(*parsed[i])
        w = model.weights()
        at = np.flatnonzero(w)
        shard = x.column("shard")[0].as_py()
        return pa.table({"shard": pa.array([shard], pa.int64()), "bucket": pa.array([at.astype("<i4").tobytes()], pa.binary()), "weight": pa.array([w[at].astype("<f8").tobytes()], pa.binary())})

    made = cut(examples(docs, labels, t), "examples")  # a bounded sample
    shards = max(1, -(-made.count() // t.shard))
    models = made.withColumn("shard", F.pmod("place", F.lit(shards))).groupBy("shard").applyInArrow(fit, "shard long, bucket binary, weight binary").collect()  # a model for each shard
    mean = np.zeros(t.buckets + 1)
    for m in sorted(models, key=lambda m: m["shard"]):
        mean[np.frombuffer(m["bucket"], "<i4")] += np.frombuffer(m["weight"], "<f8") / len(models)
    return mean


def score(docs: DataFrame, weights: np.ndarray, t: Training = Training()) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, w = Features(t), shared.value
        for batch in batches:
            logits = np.array([float(w[at].astype(float) @ values) for at, values in features.of(as_bytes(batch.column(2)))]) + float(w[-1])
            p = 1 / (1 + np.exp(-np.clip(logits, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", F.coalesce(~_learns(t), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, t: Training = Training()) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    A null or empty text scores by the bias alone. A null id is not held out and has no label. Very long texts are read whole.
    Repeated rows are scored each; an id that repeats teaches once for each label it has. Labels other than 0 and 1, and labels
    of documents that are not there, teach nothing; without any label all scores are 0.5. Other columns are not read, and lang, source and doc_id
    play no part in a score. An empty table gives an empty table.
    """
    return score(docs, train(docs, labels, t), t)


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
