"""Removal of long repeated byte strings with run-length compressed Burrows-Wheeler indexes.

Two equal strings of the length sought hold an equal anchor (a least hash of shorter strings in a window) at the same
place. The context of an anchor is all that a string of that length around it can reach. Anchors that occur once
cannot match and are dropped, equal contexts are counted and kept once, and what is left goes to buckets by anchor:
all that can match meets in one bucket, and nothing else is compared.

A bucket's contexts are aligned at their anchors and indexed together. Backwards from the anchors, each column of the
Burrows-Wheeler transform comes from the one before by a stable sort of its bytes (the LF mapping). Within a run of
equal bytes neighbours stay neighbours and their common prefix grows by one; only at run ends are positions sampled
and prefixes compared. So one pass streams the matching statistics of all contexts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrspark.llm.common import as_bytes, bitmap, documents, in_bitmap, slices
from corrspark.session import cut


@dataclass(frozen=True)
class RepeatRules:
    """``length``: bytes of a repeated string. ``anchor``: bytes of an anchor, 8 times a power of two.
    ``index_contexts``: contexts that one index is meant for. ``split``: contexts of one anchor beyond which they
    are dealt out by longer strings around it.
    """

    length: int = 200
    anchor: int = 64
    index_contexts: int = 16_000
    split: int = 50_000
    most_filter_bits: int = 26

    @property
    def reach(self) -> int:
        return self.length - self.anchor


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _hashes(text: bytes, size: int) -> np.ndarray:
    """64-bit hashes of all strings of ``size`` bytes."""
    x = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,)) * np.uint64(0x9E3779B97F4A7C15)
    step = 8
    while step < size:
        x = x[:-step] * np.uint64(0x9FB21C651E98DF25) + (x[step:] ^ (x[step:] >> np.uint64(29)))
        step *= 2
    return _mix(x)


def _slide(x: np.ndarray, window: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """``pick`` (minimum or maximum) of each window, from running picks inside blocks of the window's size."""
    n = len(x)
    padded = np.full(-(-n // window) * window, fill, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, window)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    back = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[: n - window + 1], ahead[window - 1 : n])


def anchor_places(text: bytes, rules: RepeatRules) -> tuple[np.ndarray, np.ndarray]:
    """Places whose hash is the least of some string of the length sought, and their hashes."""
    window = rules.reach + 1
    x = _hashes(text, rules.anchor)
    least = _slide(x, window, np.minimum, 2**64 - 1)
    around = np.zeros(len(least) + 2 * (window - 1), np.uint64)
    around[window - 1 : window - 1 + len(least)] = least
    places = np.flatnonzero(x == _slide(around, window, np.maximum, 0))
    return places, x[places]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc, doc_id, text. Rows with equal id and text share the key."""
    return docs.select(F.xxhash64("doc_id", F.col("doc_id").isNull(), "text").alias("doc"), "doc_id", "text")


ANCHOR = "doc long, place int, begin int, end int, anchor long, context_a long, context_b long"


def anchors(keyed: DataFrame, rules: RepeatRules) -> DataFrame:
    """The anchors of all texts, with the range and 128-bit hash of their contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.strip().split(" ")[0] for f in ANCHOR.split(",")]
        old = np.seterr(over="ignore")
        for batch in batches:
            docs, texts = batch.column(0).to_numpy(), as_bytes(batch.column(1))
            for a, b in slices(texts):
                owner, place, begin, end, anchor, digests = [], [], [], [], [], []
                for i in range(a, b):
                    text = texts[i]
                    if len(text) < rules.length:
                        continue
                    at, x = anchor_places(text, rules)
                    start, stop = np.maximum(at - rules.reach, 0), np.minimum(at + rules.length, len(text))
                    owner.append(np.full(len(at), docs[i]))
                    place.append(at)
                    begin.append(start)
                    end.append(stop)
                    anchor.append(x)
                    digests += [xxhash.xxh3_128_digest(text[s:e]) for s, e in zip(start.tolist(), stop.tolist(), strict=True)]
                if owner:
                    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                    # a context is the same only with its anchor at the same place
                    ahead = np.concatenate(place) - np.concatenate(begin)
                    columns = [np.concatenate(owner), *(np.concatenate(c).astype(np.int32) for c in (place, begin, end)), np.concatenate(anchor).view(np.int64), both[:, 0] ^ ahead, both[:, 1]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)
        np.seterr(**old)

    return keyed.select("doc", "text").mapInArrow(run, ANCHOR)


def repeated_anchors(keyed: DataFrame, rules: RepeatRules) -> DataFrame:
    """The rows of anchors() that can match: n_same, how many have the same context; mixed, whether others have another."""
    by_anchor = Window.partitionBy("anchor")
    rows = anchors(keyed, rules).withColumn("n", F.count(F.lit(1)).over(by_anchor)).where("n > 1")
    rows = rows.withColumn("mixed", F.min("context_a").over(by_anchor) != F.max("context_a").over(by_anchor))
    return rows.withColumn("n_same", F.count(F.lit(1)).over(Window.partitionBy("anchor", "context_a", "context_b"))).where("mixed or n_same > 1").drop("n")


CONTEXT = "anchor long, doc long, place int, begin int, context binary"


def contexts(keyed: DataFrame, wanted: DataFrame, rules: RepeatRules) -> DataFrame:
    """anchor, doc, place, begin, context (bytes) of the wanted rows of anchors()."""
    places = wanted.groupBy("doc").agg(F.collect_list(F.struct("place", "begin", "end", "anchor")).alias("places"))  # as many as the document has
    there, bits = bitmap(wanted, "doc", rules.most_filter_bits)
    texts = keyed.where(in_bitmap(F.col("doc"), there, bits)).select("doc", "text")
    joined = texts.join(places, "doc").select("doc", "text", *(F.col(f"places.{c}").alias(c) for c in ("place", "begin", "end", "anchor")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            place, begin, end, anchor = (batch.column(k).to_pylist() for k in range(2, 6))
            for i, (doc, text) in enumerate(zip(docs, texts, strict=True)):
                if doc in done:  # another row of the same document
                    continue
                done.add(doc)
                n = len(place[i])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[i], pa.int64()), pa.array([doc] * n, pa.int64()), pa.array(place[i], pa.int32()), pa.array(begin[i], pa.int32()), pa.array([text[s:e] for s, e in zip(begin[i], end[i], strict=True)], pa.binary())],
                    ["anchor", "doc", "place", "begin", "context"],
                )

    return joined.mapInArrow(run, CONTEXT)


def match_starts(rows: list[tuple[int, bytes]], rules: RepeatRules) -> np.ndarray:
    """rows: (bytes before the anchor, context). [i, t]: does the string of the length sought that begins t bytes
    before the anchor of context i occur in another one, too?"""
    n, reach, length = len(rows), rules.reach, rules.length
    width = reach + length
    data = np.zeros((n, width), np.uint8)
    ahead, right = np.array([a for a, _ in rows]), np.array([len(c) - a for a, c in rows])
    for i, (a, c) in enumerate(rows):
        data[i, reach - a : reach - a + len(c)] = np.frombuffer(c, np.uint8)
    stop = reach + right

    def prefix(i: np.ndarray, j: np.ndarray, column: int) -> np.ndarray:
        """Common prefix from ``column`` on, where the texts go on."""
        size = np.minimum(stop[i], stop[j]) - column
        found = np.empty(len(i), np.int64)
        for k in range(0, len(i), 8192):
            differ = data[i[k : k + 8192], column:] != data[j[k : k + 8192], column:]
            first = differ.argmax(axis=1)
            found[k : k + 8192] = np.where(differ[np.arange(len(first)), first], first, width)
        return np.minimum(found, size)

    order = np.array(sorted(range(n), key=[c[a:] for a, c in rows].__getitem__))
    common = np.zeros(n, np.int64)  # with the row above in the order
    common[1:] = prefix(order[:-1], order[1:], reach)
    hits = np.zeros((n, reach + 1), bool)
    for t in range(reach + 1):
        if t:
            alive = ahead[order] >= t
            if not alive.all():
                # a text that begins here leaves; the prefix with the next one stays the least of those between
                keep = np.flatnonzero(alive)
                if not len(keep):
                    break
                common = np.minimum.reduceat(common, np.concatenate([[0], keep[:-1] + 1]))[: len(keep)]
                order = order[keep]
                common[0] = 0
            column = data[order, reach - t]
            step = np.argsort(column, kind="stable")
            bytes_now = column[step]
            same = np.zeros(len(step), bool)
            same[1:] = bytes_now[1:] == bytes_now[:-1]
            inside = same.copy()
            inside[1:] &= step[1:] == step[:-1] + 1  # within a run of the transform
            order_now = order[step]
            grown = np.where(inside, common[step] + 1, 0)
            ends = np.flatnonzero(same & ~inside)  # a run begins, and the last one of the same byte has ended
            if len(ends):
                grown[ends] = prefix(order_now[ends - 1], order_now[ends], reach - t)
            order, common = order_now, grown
        long = common >= length
        hits[order[long], t] = True
        hits[order[np.flatnonzero(long) - 1], t] = True
    return hits


def index_marks(rows: DataFrame, rules: RepeatRules) -> DataFrame:
    """doc, begin, end: ranges of repeated strings, from rows of (bucket, doc, place, begin, context), a bucket at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def marks() -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            hits = match_starts([(place - begin, context) for _, place, begin, context in held], rules)
            found = []
            for i in np.flatnonzero(hits.any(axis=1)).tolist():
                doc, place, _, _ = held[i]
                starts = place - np.flatnonzero(hits[i])[::-1]
                cuts = np.flatnonzero(np.diff(starts) > rules.length)
                found += [(doc, a, b + rules.length) for a, b in zip(starts[np.append(0, cuts + 1)].tolist(), starts[np.append(cuts, len(starts) - 1)].tolist(), strict=True)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.int32())], ["doc", "begin", "end"])

        for batch in batches:
            for b, *row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if b != bucket:
                    yield from marks()
                    bucket, held = b, []
                held.append(row)
        yield from marks()

    rows = rows.select("bucket", "doc", "place", "begin", "context")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "doc long, begin int, end int")


def _longer(rows: DataFrame, rules: RepeatRules) -> DataFrame:
    """Deals out groups by a longer string around the anchor: half of what lacks for the length sought lies on one side.

    rows: key, low, high (the string's range in the context), and the columns of a context. A row goes to a group for
    each side; groups of one row are dropped, as such a string cannot match.
    """
    need = rules.length - (F.col("high") - F.col("low"))
    half = F.ceil(need / 2).cast("int")
    sides = F.array(F.struct((F.col("low") - half).alias("low"), "high", F.lit(0).alias("side")), F.struct("low", (F.col("high") + half).alias("high"), F.lit(1).alias("side")))
    spread = rows.withColumn("s", F.explode(sides)).where("s.low >= 0 and s.high <= octet_length(context)")
    fixed = F.expr("substring(context, s.low + 1, s.high - s.low)")
    spread = spread.select(F.xxhash64("key", "s.side", fixed).alias("key"), F.col("s.low").alias("low"), F.col("s.high").alias("high"), "doc", "place", "begin", "context")
    return spread.join(spread.groupBy("key").count().where("count > 1"), "key")


def repeats(docs: DataFrame, rules: RepeatRules = RepeatRules()) -> DataFrame:
    """doc, spans: for each document with a repeated string, ranges of bytes (they may overlap) that such strings cover."""
    keyed = _keyed(docs)
    table = cut(repeated_anchors(keyed, rules), "anchors")
    wanted = table.where("mixed").groupBy("anchor", "context_a", "context_b").agg(F.first("doc").alias("doc"), F.first("place").alias("place"), F.first("begin").alias("begin"), F.first("end").alias("end"))
    wanted = cut(wanted.drop("context_a", "context_b"), "wanted-contexts")
    sizes = wanted.groupBy("anchor").count()
    total, largest = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    buckets = max(1, -(-total // rules.index_contexts))
    found = contexts(keyed, wanted, rules)
    marks = table.where("n_same > 1").select("doc", "begin", "end")  # the whole context occurs elsewhere
    if largest > rules.split:
        large = cut(sizes.where(F.col("count") > rules.split).select("anchor"), "large-anchors")
        found = cut(found, "contexts")
        rows = found.join(large, "anchor", "left_semi").select(F.col("anchor").alias("key"), (F.col("place") - F.col("begin")).alias("low"), (F.col("place") - F.col("begin") + rules.anchor).alias("high"), "doc", "place", "begin", "context")
        found = found.join(large, "anchor", "left_anti")
        while not rows.isEmpty():
            rows = cut(_longer(rows, rules), "longer-strings")
            whole = rows.where(F.col("high") - F.col("low") >= rules.length)  # all of a group are equal
            marks = marks.union(whole.select("doc", (F.col("begin") + F.col("low")).alias("begin"), (F.col("begin") + F.col("high")).alias("end")))
            rows = rows.where(F.col("high") - F.col("low") < rules.length)
            small = rows.where(F.col("count") <= rules.split)
            marks = marks.union(index_marks(small.withColumn("bucket", F.pmod(F.col("key"), F.lit(buckets))).dropDuplicates(["bucket", "doc", "place"]), rules))
            rows = rows.where(F.col("count") > rules.split).drop("count")
    marks = marks.union(index_marks(found.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets))), rules))
    return cut(marks.groupBy("doc").agg(F.collect_list(F.struct("begin", "end")).alias("spans")), "repeats")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs."""
    found: list[list[int]] = []
    for a, b in sorted(spans):
        if found and a <= found[-1][1]:
            found[-1][1] = max(found[-1][1], b)
        else:
            found.append([a, b])
    return [(a, b) for a, b in found]


def strip_repeats(docs: DataFrame, rules: RepeatRules = RepeatRules()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, spans (removed runs of UTF-8 bytes), kept (the bytes left).

    A null or empty text has no bytes; one shorter than a repeated string loses nothing. Rows with equal id and text
    are documents of their own, so each repeats the other. An empty table gives an empty table. Other columns are not
    read.
    """
    keyed = _keyed(docs)
    marks = repeats(docs, rules)
    there, bits = bitmap(marks, "doc", rules.most_filter_bits)
    touched = in_bitmap(F.col("doc"), there, bits)
    parts = [F.col("spans.begin").alias("begin"), F.col("spans.end").alias("end")]
    none = F.lit(None).cast("array<int>")
    rows = keyed.where(touched).join(marks, "doc", "left").select("doc_id", "text", *parts).union(keyed.where(~touched).select("doc_id", "text", none, none))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for a, b in slices(texts, 16 << 20):
                runs = [merged(list(zip(s or [], e or [], strict=True))) for s, e in zip(batch.column(2).slice(a, b - a).to_pylist(), batch.column(3).slice(a, b - a).to_pylist(), strict=True)]
                kept = []
                for text, own in zip(texts[a:b], runs, strict=True):
                    edges = [0, *(x for r in own for x in r), len(text)]
                    kept.append(b"".join(text[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(t) for t in texts[a:b]], pa.int64()),
                        pa.array([[{"begin": s, "end": e} for s, e in own] for own in runs], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                        pa.array(kept, pa.binary()),
                    ],
                    ["doc_id", "n_bytes", "spans", "kept"],
                )

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType())])
    return rows.mapInArrow(run, schema)


def digest(stripped: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of strip_repeats()."""
    removed = F.col("n_bytes") - F.octet_length("kept")
    return stripped.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(strip_repeats(documents(spark, sf_dir)))
