"""Hard-negative mining by exact inner-product search in length buckets with coordinate pruning.

Rows are packed into buckets of one label and like length. Anchors meet buckets in tiles of a bounded size, so a hot label or
a vector that many rows share only makes more tiles. In a tile the buckets come longest first. A bucket is passed over where
its length cannot reach an anchor's threshold; else the threshold bounds where a partner's coordinates may lie, one range for
each of the anchor's largest coordinates, and the ranges of the bucket's sorted coordinate lists are intersected. What is left
is scored in whole numbers. Positives are found first; they set the thresholds of the negatives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corrspark.session import cut


@dataclass(frozen=True)
class Mining:
    """``anchors``: one in so many ids is an anchor. ``relabel``, ``classes``: ids divisible by the first get the next label of so many.

    ``low``, ``high``: a negative's score in per cent of the positive's. ``bucket``: rows of a length bucket; ``tile_buckets`` and
    ``tile_anchors``: what one task compares at a time. ``focus``: coordinates of an anchor whose ranges are intersected.
    """

    anchors: int = 50
    relabel: int = 7
    classes: int = 10
    scale: float = 256.0
    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    bucket: int = 2048
    tile_buckets: int = 8
    tile_anchors: int = 8192
    focus: int = 4


#: Whole numbers up to here are exact in doubles.
_EXACT = 2.0**53
_LONG = 2**63 - 1
#: Room for rounding in comparisons of lengths (relative) and of unit coordinates (absolute).
_SLACK = 1e-9
_SLICE = 512  # anchors scored at once


def _packed(x: np.ndarray) -> tuple[str, bytes]:
    """The smallest type that holds the whole numbers of ``x``, and its bytes."""
    most = float(np.abs(x).max()) if x.size else 0.0
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
    return kind, x.astype(kind).tobytes()


def _matrix(kinds: list[str], blobs: list[bytes]) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones end in zeros."""
    rows = [np.frombuffer(b, k).astype(float) for k, b in zip(kinds, blobs, strict=True)]
    width = max(map(len, rows), default=0)
    return np.stack([np.pad(r, (0, width - len(r))) for r in rows]) if rows else np.empty((0, 0))


def _products(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact products of rows, as doubles where these are exact, else as Python's whole numbers, cut to what a long holds."""
    width = min(p.shape[1], q.shape[1])
    p, q = p[:, :width], q[:, :width]
    if width == 0:
        return np.zeros((len(p), len(q)))
    if float(np.abs(p).max(initial=0)) * float(np.abs(q).max(initial=0)) * width < _EXACT:
        return p @ q.T
    whole = lambda x: np.array([[int(v) for v in r] for r in x], object).reshape(x.shape)
    return np.clip(whole(p) @ whole(q).T, -_LONG, _LONG)


class Bucket:
    """Rows of one label and like length, by ascending id; sorted coordinate lists are made when first needed."""

    def __init__(self, label: int, ids: np.ndarray, vectors: np.ndarray):
        self.label, self.ids, self.vectors = label, ids, vectors
        self.lengths = np.sqrt((vectors * vectors).sum(1))
        self.longest = float(self.lengths.max(initial=0.0))
        self._lists: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors, and for each coordinate the rows in order of its value, with the values."""
        if self._lists is None:
            unit = self.vectors / np.maximum(self.lengths, 1e-300)[:, None]
            order = np.argsort(unit, axis=0, kind="stable")
            self._lists = unit, order, np.take_along_axis(unit, order, axis=0)
        return self._lists

    def candidates(self, anchors: np.ndarray, lengths: np.ndarray, least: np.ndarray, focus: int) -> list[np.ndarray | None]:
        """For each anchor the rows whose product may reach ``least`` (above 0); None where the ranges leave too many to tell."""
        unit, order, values = self.lists()
        width = min(anchors.shape[1], unit.shape[1])
        own = anchors[:, :width] / np.maximum(lengths, 1e-300)[:, None]
        at = np.argsort(-np.abs(own), axis=1, kind="stable")[:, :focus]
        # a unit vector whose product with the anchor's is cos(turn) or more lies within that angle of it, and so do the angles to any axis
        turn = np.arccos(np.clip(least / np.maximum(lengths * self.longest, 1e-300) - _SLACK, -1, 1))[:, None]
        angle = np.arccos(np.clip(np.take_along_axis(own, at, axis=1), -1, 1))
        low = np.cos(np.minimum(np.pi, angle + turn)) - _SLACK
        high = np.cos(np.maximum(0, angle - turn)) + _SLACK
        first, last = np.empty(at.shape, np.int64), np.empty(at.shape, np.int64)
        for f in np.unique(at):
            i, j = np.nonzero(at == f)
            first[i, j] = np.searchsorted(values[:, f], low[i, j], "left")
            last[i, j] = np.searchsorted(values[:, f], high[i, j], "right")
        sizes = last - first
        found: list[np.ndarray | None] = []
        for i in range(len(anchors)):
            j = int(sizes[i].argmin()) if at.shape[1] else 0
            if not at.shape[1] or sizes[i, j] * 4 > len(self.ids):
                found.append(None)
                continue
            rows = order[first[i, j] : last[i, j], at[i, j]]
            for k in range(at.shape[1]):
                if k != j:
                    x = unit[rows, at[i, k]]
                    rows = rows[(x >= low[i, k]) & (x <= high[i, k])]
            found.append(np.sort(rows))
        return found


class Search:
    """Running best partners of a tile's anchors, in bands of scores: (lowest, highest) or None for all scores."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bands: list[list[tuple[int, int] | None]], most: int, focus: int):
        self.ids, self.vectors, self.bands, self.most, self.focus = ids, vectors, bands, most, focus
        self.lengths = np.sqrt((vectors * vectors).sum(1))
        self.best: list[list[list[tuple[int, int]]]] = [[[] for _ in b] for b in bands]  # (-score, id), in order
        self.least = np.array([self._least(i) for i in range(len(ids))], float)

    def _least(self, i: int) -> float:
        """The lowest score that could still change a band of the anchor, rounded down."""
        found = np.inf
        for band, best in zip(self.bands[i], self.best[i], strict=True):
            last = -best[-1][0] if len(best) == self.most else None
            found = min(found, -np.inf if band is None and last is None else float(last if band is None else band[0] if last is None else max(band[0], last)))
        return np.nextafter(found, -np.inf) if abs(found) >= _EXACT else found

    def compare(self, bucket: Bucket, anchors: np.ndarray) -> None:
        """Takes the bucket's rows into account for ``anchors`` (places)."""
        reach = self.lengths[anchors] * bucket.longest * (1 + _SLACK)
        live = anchors[(self.least[anchors] <= reach) | (self.least[anchors] <= 0)]
        bounded = live[(self.least[live] > 0) & (self.lengths[live] > 0)]
        dense = np.setdiff1d(live, bounded)
        if len(bounded) and bucket.longest > 0:
            found = bucket.candidates(self.vectors[bounded], self.lengths[bounded], self.least[bounded], self.focus)
            for i, rows in zip(bounded.tolist(), found, strict=True):
                if rows is not None and len(rows):
                    self._take(i, _products(bucket.vectors[rows], self.vectors[i : i + 1])[:, 0], bucket.ids[rows])
            dense = np.union1d(dense, bounded[[rows is None for rows in found]])
        for a in range(0, len(dense), _SLICE):
            part = dense[a : a + _SLICE]
            scores = _products(self.vectors[part], bucket.vectors)
            for i, row in zip(part.tolist(), scores, strict=True):
                self._take(i, row, bucket.ids)

    def _take(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of rows in order of their ids."""
        at = np.flatnonzero((scores >= self.least[i]) & (ids != self.ids[i]))
        if not len(at):
            return
        at = at[np.argsort(-scores[at], kind="stable")]
        falling = -scores[at]
        for band, best in zip(self.bands[i], self.best[i], strict=True):
            a, b = (0, len(at)) if band is None else (np.searchsorted(falling, -band[1], "left"), np.searchsorted(falling, -band[0], "right"))
            new = at[a : min(a + self.most, b)]
            if len(new):
                best.extend((-int(scores[k]), int(ids[k])) for k in new)
                best.sort()
                del best[self.most :]
        self.least[i] = self._least(i)


def vectors(embeddings: DataFrame, m: Mining) -> DataFrame:
    """vec_id, label, length, kind, v: the rows that take part, with relabelled ids and whole components."""
    sound = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    c = F.col
    label = F.when(c("vec_id") % m.relabel == 0, (c("label") + 1) % m.classes).otherwise(c("label"))
    taken = embeddings.where(c("vec_id").isNotNull() & c("label").isNotNull() & sound)
    rows = taken.select(c("vec_id").cast("long"), label.cast("long").alias("label"), c("embedding").cast("array<double>").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))
            whole = np.floor(m.scale * flat)
            own = [whole[a:b] for a, b in zip(ends[:-1].astype(int), ends[1:].astype(int), strict=True)]
            packed = [_packed(x) for x in own]
            lengths = [float(np.sqrt(x @ x)) for x in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths, pa.float64()), pa.array([k for k, _ in packed], pa.string()), pa.array([b for _, b in packed], pa.binary())], ["vec_id", "label", "length", "kind", "v"])

    return rows.mapInArrow(run, "vec_id long, label long, length double, kind string, v binary")


def buckets(rows: DataFrame, m: Mining) -> DataFrame:
    """label, longest, number, ids, width, kind, matrix: rows of a label in falling length, ``bucket`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        held: list[tuple] = []

        def pack() -> pa.RecordBatch:
            nonlocal number
            held.sort(key=lambda r: r[0])
            x = _matrix([r[3] for r in held], [r[4] for r in held])
            kind, blob = _packed(x)
            row = {"label": held[0][1], "longest": max(r[2] for r in held), "number": number, "ids": np.array([r[0] for r in held], "<i8").tobytes(), "width": x.shape[1], "kind": kind, "matrix": blob}
            number += 1
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (held[0][1] != row[1] or len(held) == m.bucket):
                    yield pack()
                held.append(row)
        if held:
            yield pack()

    schema = pa.schema([("label", pa.int64()), ("longest", pa.float64()), ("number", pa.int64()), ("ids", pa.binary()), ("width", pa.int32()), ("kind", pa.string()), ("matrix", pa.binary())])
    order = [F.col("label"), F.desc("length"), F.col("vec_id")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "label long, longest double, number long, ids binary, width int, kind string, matrix binary")


def _tiles(anchors: DataFrame, held: DataFrame, key: list[str], most: int, same: bool, m: Mining) -> DataFrame:
    """aid, slot, partner, score: each band's best in each tile of anchors and buckets (both with the tile's key columns).

    ``bands`` of an anchor is an array of (low, high), or null for all scores. ``same``: partners have the anchor's label, else another.
    """

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if a.num_rows and b.num_rows:
            own = a.select(["aid", "vec_id", "label", "kind", "v", "bands"]).to_pydict()
            bands = [[None] if x is None else [(y["low"], y["high"]) for y in x] for x in own["bands"]]
            search = Search(np.array(own["vec_id"], np.int64), _matrix(own["kind"], own["v"]), bands, most, m.focus)
            labels, places = np.array(own["label"], np.int64), np.arange(a.num_rows)
            for row in sorted(b.select(["label", "longest", "ids", "width", "kind", "matrix"]).to_pylist(), key=lambda r: -r["longest"]):
                ids = np.frombuffer(row["ids"], "<i8")
                bucket = Bucket(row["label"], ids, np.frombuffer(row["matrix"], row["kind"]).astype(float).reshape(len(ids), row["width"]))
                search.compare(bucket, places[(labels == bucket.label) == same])
            for aid, best in zip(own["aid"], search.best, strict=True):
                out += [(aid, slot, i, -s) for slot, found in enumerate(best) for s, i in found]
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["aid", "slot", "partner", "score"])

    return anchors.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(run, "aid long, slot int, partner long, score long")


def _first(found: DataFrame, most: int) -> DataFrame:
    """The ``most`` best of each anchor and slot over all tiles, with rank."""
    w = Window.partitionBy("aid", "slot").orderBy(F.desc("score"), "partner")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def _parts(n, size: int):
    return F.greatest(F.ceil(n / size), F.lit(1)).cast("int")


def _spread(count):
    return F.explode(F.sequence(F.lit(0), count - 1))


def mine(embeddings: DataFrame, m: Mining = Mining()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Of vectors of different sizes
    the shorter counts as if it ended in zeros. Repeated rows count each as partners and once as anchors; a row is no partner of
    its own vec_id. Products beyond 64 bits count as the greatest long, or its negative. Anchors without
    a positive, and positives without a negative, give no rows; an empty table gives an empty table. Other columns are not read.
    """
    c = F.col
    rows = vectors(embeddings.select("vec_id", "embedding", "label"), m)
    held = cut(buckets(rows, m), "length-buckets")
    anchors = cut(rows.where(c("vec_id") % m.anchors == 0).dropDuplicates(["vec_id", "label", "kind", "v"]).withColumn("aid", F.monotonically_increasing_id()), "anchors")

    # a label's anchors and buckets meet in tiles; what belongs to a label has as many tiles as it needs
    sizes = anchors.groupBy("label").agg(_parts(F.count(F.lit(1)), m.tile_anchors).alias("parts")).join(held.groupBy("label").agg(_parts(F.count(F.lit(1)), m.tile_buckets).alias("shards")), "label")
    share = F.pmod(F.xxhash64("aid"), c("parts")).cast("int")
    own = anchors.join(sizes, "label").select("aid", "vec_id", "label", "kind", "v", F.lit(None).cast("array<struct<low:long,high:long>>").alias("bands"), share.alias("part"), _spread(c("shards")).alias("shard"))
    there = held.join(sizes, "label").select(*held.columns, F.pmod("number", c("shards")).cast("int").alias("shard"), _spread(c("parts")).alias("part"))
    positives = _first(_tiles(own, there, ["label", "part", "shard"], m.positives, True, m), m.positives)
    positives = positives.select("aid", (c("rank") - 1).alias("slot"), c("partner").alias("positive_id"), c("score").alias("positive_score"))
    positives = cut(positives, "positives")

    # negatives score within a band below each positive; only a positive's score of 0 or more leaves one
    band = F.struct(F.ceil(m.low * c("positive_score").cast("decimal(20,0)") / 100).cast("long").alias("low"), F.floor(m.high * c("positive_score").cast("decimal(20,0)") / 100).cast("long").alias("high"))
    bands = positives.where("positive_score >= 0").select("aid", "slot", band.alias("band")).groupBy("aid").agg(F.array_sort(F.collect_list(F.struct("slot", "band"))).alias("bands"))
    needed = F.array_min(F.transform("bands", lambda x: x["low"])) / F.greatest("length", F.lit(1e-9))  # the length that a partner needs
    level = F.least(F.floor(2 * F.log2(F.greatest(needed, F.lit(1.0)))), F.lit(63)).cast("int")
    wanting = anchors.join(bands.select("aid", F.transform("bands", lambda x: x["band"]).alias("bands"), F.transform("bands", lambda x: x["slot"]).alias("slots")), "aid").withColumn("needed", needed).withColumn("level", level)
    wanting = cut(wanting, "thresholds")
    levels = wanting.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.min("needed").alias("needed")).collect()  # 64 rows at most
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not levels:
        return held.sparkSession.createDataFrame([], result)
    shards = max(1, -(-held.count() // m.tile_buckets))
    groups = F.array(*[F.struct(F.lit(r["level"]).alias("level"), F.lit(-(-r["n"] // m.tile_anchors)).cast("int").alias("parts"), F.lit(r["needed"]).alias("needed")) for r in levels])
    count = F.element_at(F.create_map(*[x for r in levels for x in (F.lit(r["level"]), F.lit(-(-r["n"] // m.tile_anchors)))]), c("level"))
    own = wanting.select("aid", "vec_id", "label", "kind", "v", "bands", "level", F.pmod(F.xxhash64("aid"), count).cast("int").alias("part"), _spread(F.lit(shards)).alias("shard"))
    # a bucket that is too short for all anchors of a level is not sent to them
    met = held.withColumn("_g", F.explode(groups)).where(c("longest") * (1 + _SLACK) >= c("_g.needed") * (1 - _SLACK))
    there = met.select(*held.columns, F.pmod("number", F.lit(shards)).cast("int").alias("shard"), c("_g.level").alias("level"), _spread(c("_g.parts")).alias("part"))
    found = _first(_tiles(own, there, ["level", "part", "shard"], m.negatives, False, m), m.negatives)
    named = found.join(wanting.select("aid", c("vec_id").alias("anchor_id"), "slots"), "aid").withColumn("slot", F.element_at("slots", c("slot") + 1))
    full = named.join(positives, ["aid", "slot"])
    return full.select("anchor_id", "positive_id", c("rank").cast("int").alias("rank"), c("partner").alias("negative_id"), "positive_score", c("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP13_SQL = """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::bigint as score from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
 p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
 select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id)::int as rank, vec_id as negative_id, positive_score, score as negative_score
 from p join s on p.anchor_id = s.anchor_id and not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
 qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) <= 3"""
