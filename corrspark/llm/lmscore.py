"""Language-model scores: a bigram model in Elias-Fano tries, one for each shard of contexts.

Every pair of neighbouring words goes to the shard of its first word, of training texts to be counted and of all
texts to be scored, so no task needs the whole model. A shard counts its pairs, writes its trie (monotone pointers,
one-byte probabilities) to memory-mapped files, looks all pairs up and returns sums for each text. Smoothing is
p(w|v) = (c(vw) + m p(w)) / (c(v) + m), m growing with c(v) as the number of successors does; p(w) is (c(w) + 0.1) / (n + 0.1 (v + 1)),
from a join of each shard's words with the exact counts. A word that is so frequent that it would fill a shard is spread over shards by its successor; its count is sent along.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrspark.llm.common import WordHashes, as_bytes, documents, slices
from corrspark.llm.eliasfano import NgramTrie
from corrspark.session import cut

BEGIN, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


@dataclass(frozen=True)
class ModelRules:
    """``power``: m = c(v) ** power is the weight of the shorter context. ``bucket_words``: words whose counts one task joins at a time.
    ``shard_tokens``: tokens to a shard; words with half as many are spread. ``folds``: one in so many texts is held out.
    ``common_words``: how many of the most frequent words go by numbers, which take less room than hashes; their counts are sent to all tasks.
    """

    power: float = 0.8
    bucket_words: int = 500_000
    shard_tokens: int = 1_000_000
    folds: int = 10
    common_words: int = 1 << 17


def held_out(doc_id: int | None, folds: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == 0


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
        return x ^ (x >> np.uint64(29))


def word_counts(docs: DataFrame, rules: ModelRules) -> DataFrame:
    """word (hash), n in training texts; the end is a word. Tasks sum up their own words first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return every, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

        for batch in batches:
            texts = [t for i, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True) if not held_out(i, rules.folds)]
            for a, b in slices(texts):
                found, _ = words.of(texts[a:b])
                held.append(np.unique(np.append(found, np.full(b - a, END)), return_counts=True))
                if len(held) > 8:
                    held[:] = [merged()]
        if held:
            every, n = merged()
            for a in range(0, len(every), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(every[a : a + (1 << 17)].view(np.int64)), pa.array(n[a : a + (1 << 17)])], ["word", "n"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _pack(*arrays: np.ndarray) -> bytes:
    press = zstandard.ZstdCompressor(level=1).compress
    parts = [press(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()) for a in arrays]
    return b"".join(len(p).to_bytes(4, "little") + a.dtype.str.encode().ljust(4) + p for p, a in zip(parts, arrays, strict=True))


def _unpack(data: bytes, most: int | None = None) -> list[np.ndarray]:
    found, at = [], 0
    unpress = zstandard.ZstdDecompressor().decompress
    while at < len(data) and len(found) != most:
        n, kind = int.from_bytes(data[at : at + 4], "little"), np.dtype(data[at + 4 : at + 8].decode().strip())
        raw = np.frombuffer(unpress(data[at + 8 : at + 8 + n]), np.uint8).reshape(kind.itemsize, -1)
        found.append(np.ascontiguousarray(raw.T).view(kind).reshape(-1))
        at += 8 + n
    return found


def _common(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and counts of the most frequent words: a table of fixed size."""
    rows = counts.orderBy(F.desc("n"), "word").limit(most).toPandas()
    word, n = rows["word"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(word)
    return word[order], n[order]


def _among(code: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which hashes are those of common words."""
    return common[np.minimum(np.searchsorted(common, code), len(common) - 1)] == code if len(common) else np.zeros(len(code), bool)


def _numbered(code: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Sorted hashes as sorted codes: numbers of common words, then the other hashes, which none of 64 bits is likely to be as small as."""
    hit = _among(code, common)
    return np.concatenate([np.searchsorted(common, code[hit]).astype(np.uint64), code[~hit]])


def _hashes(code: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The hashes that codes stand for, in the codes' order."""
    n = np.searchsorted(code, np.uint64(len(common)))
    return np.concatenate([common[code[:n].astype(np.int64)], code[n:]])


def _narrow(model: np.ndarray, base: np.ndarray, known: np.ndarray) -> bytes:
    """Sums for texts in less room: the model's, whose probabilities have a byte, as floats, the base's in steps of 2**-32."""
    return _pack(model.astype(np.float32), np.rint(base * 2**32).astype(np.int64), known)


def _pairs(docs: DataFrame, shards: int, frequent: dict[int, int], common: Broadcast, rules: ModelRules) -> DataFrame:
    """shard, block, data: a block of texts' pairs for a shard. Negative shards have the texts' ids, token counts and folds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        often = np.array(sorted(frequent), np.int64).view(np.uint64)
        often.sort()
        known = common.value[0]
        block = TaskContext.get().partitionId() << 24
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            for a, b in slices(texts, 12 << 20):
                block += 1
                found, starts = words.of(texts[a:b])
                n = np.diff(starts)
                owner = np.repeat(np.arange(b - a, dtype=np.int32), n + 1)
                tokens = np.full(len(owner), END)
                last = np.cumsum(n + 1) - 1
                inner = np.ones(len(owner), bool)
                inner[last] = False
                tokens[inner] = found
                context = np.empty_like(tokens)
                context[1:] = tokens[:-1]
                context[last - n] = BEGIN
                out = np.array([held_out(i, rules.folds) for i in ids[a:b]], bool)
                spread = np.zeros(len(context), bool)
                if len(often):
                    spread = often[np.minimum(np.searchsorted(often, context), len(often) - 1)] == context
                shard = (_mix(np.where(spread, context ^ _mix(tokens), context)) % np.uint64(shards)).astype(np.int32)
                order = np.argsort(shard, kind="stable")
                edges = np.searchsorted(shard[order], np.arange(shards + 1))
                meta = _pack(np.array([i or 0 for i in ids[a:b]], np.int64), np.array([i is None for i in ids[a:b]], np.uint8), (n + 1).astype(np.int64), out.astype(np.uint8))
                rows = [(-1 - block % shards, block, meta)]
                for s in np.flatnonzero(np.diff(edges)):
                    own = order[edges[s] : edges[s + 1]]
                    code, at = np.unique(np.concatenate([context[own], tokens[own]]), return_inverse=True)
                    rare = ~_among(code, known)
                    renamed = np.where(rare, np.cumsum(rare) + (len(code) - np.count_nonzero(rare)), np.cumsum(~rare)).astype(np.uint32) - np.uint32(1)
                    code = _numbered(code, known)
                    at = renamed[at]
                    steps = np.diff(owner[own], prepend=np.int32(0)).astype(np.int32)
                    rows.append((int(s), block, _pack(code, at[: len(own)], at[len(own) :], steps, out.astype(np.uint8))))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["shard", "block", "data"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "shard int, block long, data binary")


def _asked(pairs: DataFrame, buckets: int, most: int) -> DataFrame:
    """bucket, shard, data: words of a shard that follow others, but for the ``most`` common ones, by buckets of words. Tasks sum up their own words first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for shard, codes in held.items():
                every = np.unique(np.concatenate(codes))
                bucket = (_mix(every) % np.uint64(buckets)).astype(np.int32)
                own = np.unique(bucket)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), shard, np.int32)), pa.array([_pack(every[bucket == b]) for b in own], pa.binary())], ["bucket", "shard", "data"])
            held.clear()

        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if shard >= 0:
                    code, left, right = _unpack(data, 3)
                    asked = np.zeros(len(code), bool)
                    asked[right] = True  # only what follows a word needs its count
                    asked[: np.searchsorted(code, np.uint64(most))] = False  # common words are told to all
                    held.setdefault(shard, []).append(code := code[asked])
                    size += len(code)
                if size > 1 << 22:
                    yield from rows()
                    size = 0
        yield from rows()

    return pairs.mapInArrow(run, "bucket int, shard int, data binary")


def _told(asked: DataFrame, counts: DataFrame, buckets: int) -> DataFrame:
    """shard, block, data: the words of each shard that have a count, and the counts; the block is negative."""

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            bucket = (_mix(word) % np.uint64(buckets)).astype(np.int32)
            own = np.unique(bucket)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), -1, np.int32)), pa.array([_pack(word[bucket == b], n[bucket == b]) for b in own], pa.binary())], ["bucket", "shard", "data"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words, n = None, [], []
        shard, wanted = None, []

        def reply() -> Iterator[pa.RecordBatch]:
            if wanted and words:
                every = np.unique(np.concatenate(wanted))
                at = np.minimum(np.searchsorted(words[0], every), len(words[0]) - 1)
                hit = words[0][at] == every
                if hit.any():
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([-1 - now], pa.int64()), pa.array([_pack(every[hit], n[0][at[hit]])], pa.binary())], ["shard", "block", "data"])

        for batch in batches:
            for bucket, s, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (bucket, s) != (now, shard):
                    yield from reply()
                    if bucket != now:
                        words, n = [], []
                    now, shard, wanted = bucket, s, []
                if s < 0:
                    word, count = _unpack(data)
                    words.append(word)
                    n.append(count)
                    continue
                if len(words) > 1:
                    order = np.argsort(every := np.concatenate(words))
                    words, n = [every[order]], [np.concatenate(n)[order]]
                elif words and not wanted:
                    order = np.argsort(words[0])
                    words, n = [words[0][order]], [n[0][order]]
                wanted.append(_unpack(data)[0])
        yield from reply()

    rows = asked.union(counts.select("word", "n").mapInArrow(known, "bucket int, shard int, data binary"))
    return rows.repartition("bucket").sortWithinPartitions("bucket", "shard").mapInArrow(look, "shard int, block long, data binary")


def _score_shard(blocks: list[tuple[int, bytes]], told: list[bytes], common: tuple[np.ndarray, np.ndarray], all_words: tuple[int, int], frequent: dict[int, int], rules: ModelRules) -> Iterator[tuple[int, bytes]]:
    """(block, sums for its texts: log10 of the model, log10 of base counts, known words) of one shard.

    told: words of the shard with their counts, but for common ones; those that both lack have none. all_words: training tokens and distinct words.
    """
    parts = [_unpack(data) for _, data in blocks]
    for p in parts:
        p[0] = _hashes(p[0], common[0])
    codes = np.unique(np.concatenate([p[0] for p in parts]))
    contexts, successors, texts, taught, ends = [], [], [], [], [0]
    for code, left, right, steps, out in parts:
        here = np.searchsorted(codes, code).astype(np.int32)  # code is not in order, as common words come first
        contexts.append(here[left])
        successors.append(here[right])
        text = np.cumsum(steps, dtype=np.int32)
        texts.append(text)
        taught.append(out[text] == 0)
        ends.append(ends[-1] + len(left))
    outs = [p[4] for p in parts]
    context, successor, taught = np.concatenate(contexts), np.concatenate(successors), np.concatenate(taught)
    del contexts, successors, parts
    pair, inverse = np.unique(context.astype(np.int64) * len(codes) + successor, return_inverse=True)
    inverse = inverse.astype(np.int32)
    del successor
    count = np.bincount(inverse[taught], minlength=len(pair))
    total = np.bincount(context[taught], minlength=len(codes))
    for word, n in frequent.items():  # spread over shards: the count of all of them
        at = np.searchsorted(codes, np.int64(word).view(np.uint64))
        if at < len(codes) and codes[at].view(np.int64) == word:
            total[at] = n
    left, right = pair // len(codes), pair % len(codes)
    own = np.zeros(len(codes))
    hit = _among(codes, common[0])
    own[hit] = common[1][np.searchsorted(common[0], codes[hit])]
    for data in told:
        word, n = _unpack(data)
        own[np.searchsorted(codes, word)] = n
    logs = np.log10((own + 0.1) / (all_words[0] + 0.1 * (all_words[1] + 1)))

    seen = np.flatnonzero(count)
    there = np.flatnonzero(total)  # with seen pairs here or, if spread, elsewhere
    place = np.searchsorted(there, left[seen])
    weight = np.maximum(total, 1) ** rules.power
    smoothed = np.log10((count[seen] + weight[left[seen]] * 10 ** logs[right[seen]]) / (total[left[seen]] + weight[left[seen]]))
    with tempfile.TemporaryDirectory() as folder:
        trie = NgramTrie(folder, there, np.log10(weight[there] / (total[there] + weight[there])), place, right[seen], smoothed, len(codes))
        known, shorter, found, value = trie.look(left, right)
        del trie
    pair_logs = np.where(found, value, np.where(known, shorter, 0.0) + logs[right])
    base_logs = np.log10(total + 0.1)
    begin = np.searchsorted(codes, BEGIN)
    counted = np.ones(len(codes), bool)
    if begin < len(codes) and codes[begin] == BEGIN:
        counted[begin] = False
    for (block, _), text, out, a, b in zip(blocks, texts, outs, ends[:-1], ends[1:], strict=True):
        n = len(out)
        word = context[a:b]
        real = counted[word]
        yield (
            block,
            _narrow(
                np.bincount(text, pair_logs[inverse[a:b]], n),
                np.bincount(text[real], base_logs[word[real]], n),
                np.bincount(text[real & (total[word] > 0)], minlength=n).astype(np.int64),
            ),
        )


def score_texts(docs: DataFrame, rules: ModelRules = ModelRules()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text is its end alone. A null id is held out, as the crc32 of nothing is 0. Repeated rows count and
    are scored each. Without training tokens the base is uniform over one word. An empty table gives an empty table.
    """
    counts = cut(word_counts(docs, rules), "word-counts")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    shards = max(8, -(-n // rules.shard_tokens))
    # at most 2 n / shard_tokens words; the end is no context
    frequent = {r["word"]: r["n"] for r in counts.where((F.col("n") > rules.shard_tokens // 2) & (F.col("word") != int(END.view(np.int64)))).collect()}
    end_count = next((r["n"] for r in counts.where(F.col("word") == int(END.view(np.int64))).collect()), 0)
    if end_count > rules.shard_tokens // 2:  # as often as a text ends, one begins
        frequent[int(BEGIN.view(np.int64))] = end_count
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    common = docs.sparkSession.sparkContext.broadcast(_common(counts, rules.common_words))
    most = len(common.value[0])
    base_of_all = float(np.log10(n + 0.1 * (v + 1)))
    base_of_end = float(np.log10(end_count + 0.1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        shard, blocks, told = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if blocks:
                rows = list(_score_shard(blocks, told, common.value, (n, v), often, rules))
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array([False] * len(rows)), pa.array([d for _, d in rows], pa.binary())], ["block", "meta", "data"])

        for batch in batches:
            passed = [(block, data) for s, block, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) if s < 0]
            if passed:
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in passed], pa.int64()), pa.array([True] * len(passed)), pa.array([d for _, d in passed], pa.binary())], ["block", "meta", "data"])
            for s, block, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if s < 0:
                    continue
                if s != shard:
                    yield from done()
                    shard, blocks, told = s, [], []
                if block < 0:
                    told.append(data)
                else:
                    blocks.append((block, data))
        yield from done()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, meta, sums = None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            if meta is not None:
                ids, none, tokens, out = meta
                model, base, known = sums if sums is not None else (np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64))
                base = base + base_of_end - tokens * base_of_all
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=none.astype(bool)), pa.array(out.astype(bool)), pa.array(tokens), pa.array(known + (end_count > 0)), pa.array(np.full(len(ids), n, np.int64)), pa.array(base), pa.array(model)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

        for batch in batches:
            for block, is_meta, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if block != now:
                    yield from done()
                    now, meta, sums = block, None, None
                if is_meta:
                    meta = _unpack(data)
                else:
                    own = _unpack(data)
                    own = [own[0].astype(np.float64), own[1] / 2**32, own[2]]
                    sums = own if sums is None else [a + b for a, b in zip(sums, own, strict=True)]
        yield from done()

    buckets = max(8, -(-v // rules.bucket_words))
    pairs = _pairs(docs, shards, frequent, common, rules)
    # the pairs are made twice, as keeping them takes as much disk as their shuffle
    pairs = pairs.union(_told(_asked(pairs, buckets, most), counts, buckets)).repartition("shard").sortWithinPartitions("shard", "block")
    scored = pairs.mapInArrow(score, "block long, meta boolean, data binary").repartition("block").sortWithinPartitions("block", F.desc("meta"))
    return scored.mapInArrow(total, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))
