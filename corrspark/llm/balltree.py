"""Ranked lexical search: exact inner products of sparse term vectors, searched best-first in ball trees.

Texts are read once; what is kept of a document is how often it has each term that an item has. With the corpus's counts, documents
become vectors of whole numbers and items vectors of whole weights. Tasks build trees over a few thousand documents at a time: a
node knows its centroid and the radius around it, which bounds the score of all documents below it. An item's search takes
nodes in falling order of that bound and ends where the bound is below the item's worst kept score; leaves are scored exactly.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corrspark.llm.common import as_bytes, documents, slices
from corrspark.session import cut


@dataclass(frozen=True)
class Ranking:
    """``top``: documents for each item. ``tree_documents``, ``tree_terms``: documents and their terms (with repeats by document) in
    one tree at most, unless a single document has more. ``leaf``: documents of a leaf. ``cells``: entries of a tree's centroids.
    ``item_bytes``: item texts that are searched in one pass over the documents; more make more passes.
    """

    top: int = 20
    tree_documents: int = 4096
    tree_terms: int = 1_000_000
    leaf: int = 64
    cells: int = 4_000_000
    item_bytes: int = 32 << 20


_SLACK = 1e-9  # of bounds and of squared distances, relative to what went into them
#: Separators become blanks and A-Z lower case; bytes of other characters stay, so that a split gives the terms.
_TERMS = bytes(x if x >= 0x80 or 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A else x + 32 if 0x41 <= x <= 0x5A else 32 for x in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), terms and counts (of those in the vocabulary, as 32-bit numbers) of each document with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of a block of items, whose size is bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.get
        width = len(shared.value)
        for batch in batches:
            texts = as_bytes(batch.column(1))
            sizes, found, counts = [], [], []
            for a, b in slices(texts, 2 << 20):
                split = [terms(x) for x in texts[a:b]]
                lengths = [len(s) for s in split]
                at = np.fromiter((known(w, -1) for s in split for w in s), np.int64, sum(lengths))
                keys = (np.repeat(np.arange(b - a), lengths) * width + at)[at >= 0]
                keys, times = np.unique(keys, return_counts=True)
                ends = np.searchsorted(keys, np.arange(b - a + 1) * width)
                own, times = (keys % max(width, 1)).astype("<i4"), times.astype("<i4")
                found += [own[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]
                counts += [times[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]
                sizes += lengths
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "n", "terms", "counts"])
            yield out.filter(pa.array([n > 0 for n in sizes], pa.bool_()))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, terms binary, counts binary")


def document_counts(held: DataFrame, width: int) -> np.ndarray:
    """How many documents have each term; tasks sum theirs up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), minlength=width)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["term", "n"])

    out = np.zeros(width, np.int64)
    for row in held.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # the vocabulary at most
        out[row["term"]] = row["n"]
    return out


class Tree:
    """Ball tree over documents as sparse vectors of whole numbers.

    ``ends``: where each document's terms end; ``at``, ``values``: their terms and values, above 0. Distances are measured with each
    term scaled by ``scale``, and so are bounds; this makes rare terms count as much as they do in scores.
    """

    def __init__(self, ends: np.ndarray, at: np.ndarray, values: np.ndarray, scale: np.ndarray, leaf: int, cells: int):
        self.active, own = np.unique(at, return_inverse=True)
        self.scale = scale[self.active]
        self._starts, self._lengths = np.append(0, ends[:-1]), np.diff(ends, prepend=0)
        self._at, self._values = own, values
        self._scaled = values * self.scale[own]
        self._squares = np.add.reduceat(self._scaled * self._scaled, self._starts)
        self._leaf = max(leaf, -(-2 * len(ends) * len(self.active) // cells))
        self.children: list[tuple[int, int] | None] = []
        self.radius: list[float] = []
        self.leaves: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        centroids: list[np.ndarray] = []
        waiting = [(np.arange(len(ends)), -1, 0)]
        while waiting:
            docs, parent, side = waiting.pop()
            node = len(self.radius)
            if parent >= 0:
                pair = list(self.children[parent])
                pair[side] = node
                self.children[parent] = tuple(pair)
            flat, starts = self._flat(docs)
            center = np.bincount(self._at[flat], self._scaled[flat], len(self.active)) / len(docs)
            far = self._distances(docs, flat, starts, center)
            centroids.append(center)
            # distances are differences of large numbers; what rounding may hide is added
            self.radius.append(float(np.sqrt((far + _SLACK * (self._squares[docs] + center @ center)).max())))
            if len(docs) <= self._leaf:
                self.children.append(None)
                self.leaves[node] = (docs, self._at[flat], self._values[flat], starts)
                continue
            to_a = self._distances(docs, flat, starts, self._dense(docs[far.argmax()]))
            to_b = self._distances(docs, flat, starts, self._dense(docs[to_a.argmax()]))
            left = to_a <= to_b
            if left.all() or not left.any():  # all alike
                left = np.arange(len(docs)) * 2 < len(docs)
            self.children.append((-1, -1))
            waiting += [(docs[left], node, 0), (docs[~left], node, 1)]
        self.centroids = np.array(centroids).T.copy()

    def _flat(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the documents' entries, and where each document's begin among these."""
        lengths = self._lengths[docs]
        starts = np.append(0, np.cumsum(lengths)[:-1])
        return np.repeat(self._starts[docs] - starts, lengths) + np.arange(lengths.sum()), starts

    def _dense(self, doc: int) -> np.ndarray:
        out = np.zeros(len(self.active))
        a, n = self._starts[doc], self._lengths[doc]
        out[self._at[a : a + n]] = self._scaled[a : a + n]
        return out

    def _distances(self, docs: np.ndarray, flat: np.ndarray, starts: np.ndarray, point: np.ndarray) -> np.ndarray:
        """Squared, to a point."""
        return np.maximum(self._squares[docs] - 2 * np.add.reduceat(self._scaled[flat] * point[self._at[flat]], starts) + point @ point, 0)

    def bounds(self, own: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each node a score that none of its documents exceeds. ``own``: places among the active terms."""
        q = weights / self.scale[own]
        near = q @ self.centroids[own] + math.sqrt(q @ q) * np.array(self.radius)
        return near * (1 + _SLACK) + 1e-3

    def search(self, at: np.ndarray, weights: np.ndarray, least: int, take) -> int:
        """Calls take(documents, scores), which returns the new least score of interest; gives the number of leaves scored.

        ``at``: an item's terms, ascending. Nodes whose bound is below the least score are left out; an equal one may hold a tie.
        """
        place = np.searchsorted(self.active, at)
        there = place < len(self.active)
        there[there] = self.active[place[there]] == at[there]
        own, weights = place[there], weights[there]
        if not len(own):
            return 0
        bounds = self.bounds(own, weights.astype(float))
        dense = np.zeros(len(self.active), np.int64)
        dense[own] = weights
        heap, scored = [(-bounds[0], 0)], 0
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < max(least, 1):
                break
            if self.children[node] is not None:
                for child in self.children[node]:
                    heapq.heappush(heap, (-bounds[child], child))
                continue
            docs, terms_, values, starts = self.leaves[node]
            scored += 1
            least = take(docs, np.add.reduceat(values * dense[terms_], starts))
        return scored


class Best:
    """An item's best documents so far: by falling score, then ascending id with null ids first."""

    def __init__(self, most: int):
        self.most = most
        self.scores, self.ids, self.nulls = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def least(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.most else 1

    def take(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> int:
        good = scores >= self.least
        if good.any():
            scores, ids, nulls = np.append(self.scores, scores[good]), np.append(self.ids, ids[good]), np.append(self.nulls, nulls[good])
            order = np.lexsort((ids, ~nulls, -scores))[: self.most]
            self.scores, self.ids, self.nulls = scores[order], ids[order], nulls[order]
        return self.least


def _search(held: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n_documents: int, n_terms: int, r: Ranking) -> DataFrame:
    """item (place), doc_id, score: each task's best documents of each item."""
    shared = held.sparkSession.sparkContext.broadcast((items, weights))  # of a block of items, whose size is bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        scale = np.sqrt(weights.astype(float))
        best = [Best(r.top) for _ in items]
        queue: list[tuple] = []
        size = 0

        def flush() -> None:
            nonlocal size
            ids = np.array([0 if d is None else d for d, *_ in queue], np.int64)
            nulls = np.array([d is None for d, *_ in queue], bool)
            lengths = np.array([len(t) for _, _, t, _ in queue])
            at, times = np.concatenate([t for _, _, t, _ in queue]).astype(np.int64), np.concatenate([c for *_, c in queue]).astype(np.int64)
            m = np.array([75 + 25 * n * n_documents // n_terms for _, n, _, _ in queue], np.int64)
            values = 1_000_000_000 * times // (1000 * times + 12 * np.repeat(m, lengths))
            queue.clear()
            size = 0
            counts = (values > 0) & (weights[at] > 0)  # all else adds nothing to any score
            kept = np.bincount(np.repeat(np.arange(len(ids)), lengths)[counts], minlength=len(ids))
            some = kept > 0
            if not some.any():
                return
            tree = Tree(np.cumsum(kept[some]), at[counts], values[counts], scale, r.leaf, r.cells)
            ids, nulls = ids[some], nulls[some]
            for (own, w), b in zip(items, best, strict=True):
                tree.search(own, w, b.least, lambda docs, scores, b=b: b.take(scores, ids[docs], nulls[docs]))

        for batch in batches:
            for doc, n, t, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if t:
                    queue.append((doc, n, np.frombuffer(t, "<i4"), np.frombuffer(c, "<i4")))
                    size += len(t) // 4
                    if len(queue) >= r.tree_documents or size >= r.tree_terms:
                        flush()
        if queue:
            flush()
        for i, b in enumerate(best):
            if len(b.scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.scores), i), pa.int64()), pa.array(b.ids, pa.int64(), mask=b.nulls), pa.array(b.scores, pa.int64())], ["item", "doc_id", "score"])

    return held.mapInArrow(run, "item long, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, r: Ranking = Ranking()) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of each row of ``items`` (item_id, text).

    A null or empty text has no term: such a document is not counted, such an item gives no rows. Very long texts are read whole.
    Repeated documents are ranked each and repeated items answered each; of equal scores the smaller doc_id comes first, a null
    one before all others. Other columns are not read. An empty table on either side gives an empty table.
    """
    spark = docs.sparkSession
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // r.item_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out: DataFrame | None = None
    for b in range(blocks):
        rows = [(x["item_id"], x["text"]) for x in items.where(block == b).select(F.col("item_id").cast("long"), "text").collect()]  # item_bytes, more or less
        split = [terms((text or "").encode("utf-8", "surrogatepass")) for _, text in rows]
        vocabulary = {w: i for i, w in enumerate(sorted(set().union(*split)))}
        if not vocabulary:
            continue
        held = cut(postings(docs, vocabulary), "postings")
        n_documents, n_terms = held.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_documents:
            continue
        with_term = document_counts(held, len(vocabulary)).tolist()
        weights = np.array([math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1))) for df in with_term], np.int64)
        queries = []
        for words in split:
            at, times = np.unique(np.array([vocabulary[w] for w in words], np.int64), return_counts=True)
            queries.append((at, times * weights[at]))
        useful = [(at[w > 0], w[w > 0]) for at, w in queries]
        found = _search(held, useful, weights, n_documents, n_terms, r)
        w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= r.top)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(rows)], "item long, item_id long")
        part = best.join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SPLIT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""with d as (select doc_id, {_SPLIT} as t from documents), dn as (select doc_id, len(t) as n, t from d where len(t) > 0), s as (select count(*)::bigint as nd, sum(n)::bigint as nt from dn),
 q as (select item_id, unnest({_SPLIT}) as term from benchmark), tf as (select doc_id, n, term, count(*)::bigint as tf from (select doc_id, n, unnest(t) as term from dn) where term in (select term from q) group by all),
 df as (select term, floor(1000 * ln((2 * nd + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, s group by term, nd),
 sc as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nt))))::bigint as score from q join tf using (term) join df using (term), s group by item_id, doc_id)
 select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from sc where score > 0 qualify row_number() over (partition by item_id order by score desc, doc_id) <= 20"""
