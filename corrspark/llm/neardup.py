"""Near-duplicate documents: one-permutation MinHash with optimal densification, and verified links.

A document is its set of hashed word shingles; equal sets are one node. One permutation sorts a set into bins whose
least elements are the sketch; an empty bin borrows from the first full bin of its own random order. Bands of the
sketch are buckets. Each bucket gives a star of candidate edges, so their number is bounded by the band entries. The
components of the candidates come to tasks with their texts, where links are confirmed on the whole sets. Components
too large for one task are first compared with a central member; what that leaves is compared in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrspark.llm.common import WordHashes, as_bytes, bitmap, documents, in_bitmap, slices
from corrspark.llm.components import components
from corrspark.session import cut


@dataclass(frozen=True)
class NearRules:
    """``shingle``: words. ``percent``: least Jaccard similarity of a link. ``bins``: of the sketch, a power of two.
    ``band``: bins in a band; at a similarity of 0.85, 42 bands of 6 miss a pair once in 4e8, of 4 less.
    ``block``, ``block_bytes``: members and text bytes that one task compares at a time.
    """

    shingle: int = 5
    percent: int = 80
    bins: int = 256
    band: int = 6
    seed: int = 20240229
    block: int = 1024
    block_bytes: int = 24 << 20
    most_filter_bits: int = 26


class Sketcher:
    """Shingle sets of texts and their bucket keys."""

    def __init__(self, rules: NearRules):
        self.rules = rules
        self.words = WordHashes()
        rng = np.random.default_rng(rules.seed)
        # place of each donor in each bin's own order
        self.order = np.argsort(rng.random((rules.bins, rules.bins)), axis=1).astype(np.int16)
        self.shift = np.uint64(64 - rules.bins.bit_length() + 1)
        self.edges = (np.arange(rules.bins, dtype=np.uint64) << self.shift).astype(np.uint64)
        self.bands = rules.bins // rules.band

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text; a text with fewer words is one shingle, without words none."""
        hashes, starts = self.words.of(texts)
        k = self.rules.shingle
        with np.errstate(over="ignore"):
            mixed = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
            for i in range(k):
                mixed = (mixed ^ hashes[i : i + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(32)
            mixed = mixed * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(29)
        found = []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if b - a >= k:
                found.append(np.unique(mixed[a : b - k + 1]))
            else:
                found.append(np.array([xxhash.xxh3_64_intdigest(hashes[a:b].tobytes())] if b > a else [], np.uint64))
        return found

    def buckets(self, own: np.ndarray) -> np.ndarray:
        """A 64-bit key for each band of the set's sketch."""
        at = np.searchsorted(own, self.edges)
        least = own[np.minimum(at, len(own) - 1)]
        full = (at < len(own)) & ((least >> self.shift) == np.arange(len(at), dtype=np.uint64))
        donors = np.flatnonzero(full)
        if len(donors) < len(full):
            poor = np.flatnonzero(~full)
            least[poor] = least[donors[self.order[np.ix_(poor, donors)].argmin(axis=1)]]
        rows = least[: self.bands * self.rules.band].reshape(self.bands, self.rules.band)
        with np.errstate(over="ignore"):
            key = np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
            for i in range(self.rules.band):
                key = (key ^ rows[:, i]) * np.uint64(0x9FB21C651E98DF25)
                key ^= key >> np.uint64(31)
        return key.view(np.int64)


def sketch(docs: DataFrame, rules: NearRules) -> DataFrame:
    """doc_id, text_hash, n_shingles, n_bytes, set_a, set_b, buckets, a row for each row; without shingles the last three are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(rules)
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for a, b in slices(texts):
                sets = sketcher.sets(texts[a:b])
                ids = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                part = [None if i is None else int.from_bytes(i[:8], "little", signed=True) for i in ids], [None if i is None else int.from_bytes(i[8:], "little", signed=True) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(2).slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([len(t) for t in texts[a:b]], pa.int64()),
                        pa.array(part[0], pa.int64()),
                        pa.array(part[1], pa.int64()),
                        pa.array([sketcher.buckets(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "text_hash", "n_shingles", "n_bytes", "set_a", "set_b", "buckets"],
                )

    source = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    return source.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, n_bytes long, set_a long, set_b long, buckets array<long>")


def linked(sets: list[np.ndarray], percent: int, left: int | None = None) -> list[tuple[int, int]]:
    """Pairs (i, j), i < j, of sets whose similarity is high enough. left: only pairs of one below it and one not below.

    A set that is there twice is linked with itself.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    common = np.zeros((m, m), np.float32)
    if m == 2:
        at = np.searchsorted(sets[0], sets[1])
        common[0, 1] = np.count_nonzero(sets[0][np.minimum(at, len(sets[0]) - 1)] == sets[1]) if sizes.all() else 0
    else:
        flat, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
        _, code, seen = np.unique(flat, return_inverse=True, return_counts=True)
        shared = seen[code] > 1
        _, code = np.unique(code[shared], return_inverse=True)
        owner = owner[shared]
        width = 4096
        order = np.argsort(code, kind="stable")
        code, owner = code[order], owner[order]
        for c in range(0, int(code[-1]) + 1 if len(code) else 0, width):
            a, b = np.searchsorted(code, (c, c + width))
            there = np.zeros((m, width), np.float32)
            there[owner[a:b], code[a:b] - c] = 1
            common += there @ there.T  # exact: counts stay far below 2**24
    common = common.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    i, j = np.nonzero(np.triu((100 * common >= percent * union) & (union > 0), 1))
    if left is not None:
        i, j = i[keep := (i < left) & (j >= left)], j[keep]
    return list(zip(i.tolist(), j.tolist(), strict=True))


def _forest(nodes: list[int], pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, root): as few edges as connect what the pairs connect; roots are the least nodes. A node may be there twice, as one."""
    first: dict[int, int] = {}
    up = [first.setdefault(node, i) for i, node in enumerate(nodes)]

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in pairs:
        a, b = root(i), root(j)
        if a != b:
            if nodes[a] < nodes[b]:
                a, b = b, a
            up[a] = b
    return [(nodes[i], nodes[root(i)]) for i in first.values() if root(i) != i]


def _compare(rules: NearRules):
    """Over rows (task, side, node, set_a, text), those of a task together: the edges that connect what is linked.

    side: 0 or 1 if only pairs of both sides count, else null; a node may be on both. A row whose text does not have the set is another version of its document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(rules)
        task, members = None, {}

        def edges() -> Iterator[pa.RecordBatch]:
            if len(members) > 1:
                ordered = sorted(members)
                both = any(side for side, _ in ordered)
                left = sum(side == 0 for side, _ in ordered) if both else None
                found = _forest([node for _, node in ordered], linked([members[x] for x in ordered], rules.percent, left))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            texts = as_bytes(batch.column(4))
            tasks, sides, nodes, keys = (batch.column(k).to_pylist() for k in range(4))
            for a, b in slices(texts):
                for i, own in zip(range(a, b), sketcher.sets(texts[a:b]), strict=True):
                    if tasks[i] != task:
                        yield from edges()
                        task, members = tasks[i], {}
                    if int.from_bytes(xxhash.xxh3_128_digest(own.tobytes())[:8], "little", signed=True) == keys[i]:
                        members[sides[i] or 0, nodes[i]] = own
        yield from edges()

    return run


def _run_tasks(rows: DataFrame, rules: NearRules) -> DataFrame:
    return rows.select("task", "side", "node", "set_a", "text").repartition("task").sortWithinPartitions("task").mapInArrow(_compare(rules), "a long, b long")


def near_links(docs: DataFrame, sketches: DataFrame, rules: NearRules) -> tuple[DataFrame, DataFrame]:
    """The nodes (distinct sets: node, set_a, set_b) and edges (a, b) that connect exactly the nodes that links connect."""
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("one")
    nodes = sketches.where("set_a is not null").groupBy("set_a", "set_b").agg(one, F.first("n_bytes").alias("n_bytes"), F.first("buckets").alias("buckets"))
    nodes = cut(nodes.select(F.monotonically_increasing_id().alias("node"), "set_a", "set_b", F.col("one.doc_id").alias("doc_id"), F.col("one.text_hash").alias("text_hash"), "n_bytes", "buckets"), "nodes")

    entries = nodes.select("node", F.explode("buckets").alias("bucket"))
    stars = entries.groupBy("bucket").agg(F.min("node").alias("center"), F.count(F.lit(1)).alias("size")).where("size > 1")
    spokes = cut(entries.join(stars, "bucket").groupBy("node", "center").agg(F.sum("size").alias("weight")), "spokes")
    groups = components(spokes.select(F.col("node").alias("a"), F.col("center").alias("b")))
    # how often a node agrees with others: the original of many near copies has the highest sum
    weight = spokes.groupBy("node").agg(F.sum("weight").alias("weight"))
    members = groups.join(nodes.drop("buckets"), "node").join(weight, "node")

    there, bits = bitmap(members, "text_hash", rules.most_filter_bits)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), "text").where(in_bitmap(F.col("hash"), there, bits))
    on = members["doc_id"].eqNullSafe(texts["id"]) & (members["text_hash"] == texts["hash"])
    members = cut(members.join(texts, on).select("root", "node", "set_a", "weight", "n_bytes", "text"), "members")

    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.sum("n_bytes").alias("bytes"), F.max(F.struct("weight", "node")).getField("node").alias("central"))
    blocks = F.ceil(F.greatest(F.col("size") / rules.block, F.col("bytes") / rules.block_bytes)).cast("int")
    sizes = cut(sizes.select("root", "central", blocks.alias("blocks")), "group-sizes")
    whole = members.join(sizes.where("blocks = 1").select("root"), "root", "left_semi")
    edges = _run_tasks(whole.withColumn("task", F.xxhash64("root")).withColumn("side", F.lit(None).cast("int")), rules)
    large = sizes.where("blocks > 1")
    if large.isEmpty():
        return nodes, edges

    # Large groups: each block of members, and with it the central one
    split = cut(members.join(large, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "large-members")
    spread = split.where("node = central").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.xxhash64("root", "block")
    around = split.where("node <> central").select(key.alias("task"), F.lit(1).alias("side"), "node", "set_a", "text")
    near = cut(_run_tasks(around.union(spread.select(key.alias("task"), F.lit(0).alias("side"), "node", "set_a", "text")), rules), "central-edges")
    settled = near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node"))).distinct()
    # The members that the central one is not linked with, against all: blocks of the one against blocks of the other
    rest = cut(split.join(settled, "node", "left_anti").where("node <> central"), "large-rest")
    rest_blocks = rest.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / rules.block, F.sum("n_bytes") / rules.block_bytes)).cast("int").alias("rest_blocks"))
    rest = rest.join(rest_blocks, "root").withColumn("rest_block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("rest_blocks")).cast("int"))
    left = rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = split.join(rest_blocks, "root").withColumn("rest_block", F.explode(F.sequence(F.lit(0), F.col("rest_blocks") - 1)))
    pair = F.xxhash64("root", "rest_block", "block")
    cross = left.select(pair.alias("task"), F.lit(0).alias("side"), "node", "set_a", "text").union(right.select(pair.alias("task"), F.lit(1).alias("side"), "node", "set_a", "text"))
    return nodes, edges.union(near).union(_run_tasks(cross, rules))


def _rooted(docs: DataFrame, rules: NearRules) -> DataFrame:
    """doc_id, text_hash, n_shingles, root (the group's node, null without shingles) of each row."""
    sketches = cut(sketch(docs, rules), "sketches")
    nodes, edges = near_links(docs, sketches, rules)
    roots = components(edges)
    labelled = nodes.select("node", "set_a", "set_b").join(roots, "node", "left").select("set_a", "set_b", F.coalesce("root", "node").alias("root"))
    return sketches.drop("buckets", "n_bytes").join(labelled, ["set_a", "set_b"], "left").select("doc_id", "text_hash", "n_shingles", "root")


def near_groups(docs: DataFrame, rules: NearRules = NearRules()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_hash, n_shingles, component_id, kept.

    A null text and one without words have no shingles, are linked with nothing and stay. A null id is larger than
    any; a group of null ids alone has a null component_id and stays. Repeated rows get the same result. An empty
    table gives an empty table. Other columns are not read.
    """
    rows = _rooted(docs, rules)
    least = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    joined = rows.join(least, "root", "left")
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return joined.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, rules: NearRules = NearRules()) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates, with all columns and nothing else.

    It is the row with the least doc_id, null ids last; of rows that share it, the one with the least hash of its text, and
    one of several equal ones. Rows that share an id but no group are no duplicates and stay, as do all rows without words.
    """
    rows = cut(_rooted(docs, rules).where("root is not null"), "near-groups")
    texts = rows.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("times"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "times")
    chosen = cut(texts.groupBy("root").agg(F.min(place).alias("one"), F.sum("times").alias("size")).where("size > 1").select("root", "one"), "chosen")
    gone = rows.join(chosen, "root").where(~(F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("text_hash") == F.col("one.text_hash"))))
    gone = gone.select("doc_id", "text_hash").distinct()
    # the columns of docs stay together, so that their names do not matter
    whole = docs.select(F.struct("*").alias("row")).select("row", F.col("row.doc_id").cast("long").alias("id"), F.xxhash64("row.text").alias("hash"))
    same = lambda other: whole["id"].eqNullSafe(other["doc_id"]) & (whole["hash"] == other["text_hash"])
    left = whole.join(gone, same(gone), "left_anti")
    again = chosen.where("one.times > 1").select("one.doc_id", "one.text_hash")
    if again.isEmpty():
        return left.select("row.*")
    once = left.join(again, same(again), "left_semi").dropDuplicates(["id", "hash"])
    return left.join(again, same(again), "left_anti").union(once).select("row.*")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(documents(spark, sf_dir), NearRules(shingle=3, percent=85))
    return found.select("doc_id", "n_shingles", "component_id", "kept")
