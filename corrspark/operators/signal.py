"""Operators on one-dimensional signals: rows of key columns, pos and a value.

A contig is one long axis, so sliding windows run in chunks of it: each chunk takes the rows of its neighbours that
its windows reach, and drops them afterwards. Contigs of any length thus spread over tasks.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1 << 16


def joined_runs(parts: DataFrame, by: list[str], aggregates: dict[str, Column], same: list[str] = ()) -> DataFrame:
    """Runs (start, end) that touch, and agree in ``same``, become one: by, start, end, same and the aggregates.

    Parts come from chunks of the axis, so the order along a contig holds runs, not positions.
    """
    order = Window.partitionBy(*by).orderBy("start")
    touches = F.lag("end").over(order) == F.col("start")
    for c in same:
        touches = touches & F.lag(F.struct(c)).over(order).eqNullSafe(F.struct(c))
    runs = parts.withColumn("_opens", F.when(touches, 0).otherwise(1)).withColumn("_run", F.sum("_opens").over(order))
    return runs.groupBy(*by, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), *[F.first(c).alias(c) for c in same], *[v.alias(k) for k, v in aggregates.items()]).drop("_run")


def _chunk_runs(rows: DataFrame, by: list[str], aggregates: dict[str, Column]) -> DataFrame:
    """by, start, end and aggregates of the runs of successive positions, cut at chunks."""
    order = Window.partitionBy(*by, "_chunk").orderBy("pos")
    runs = rows.withColumn("_chunk", F.floor(F.col("pos") / CHUNK)).withColumn("_island", F.col("pos") - F.row_number().over(order))
    return runs.groupBy(*by, "_chunk", "_island").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), *[v.alias(k) for k, v in aggregates.items()]).drop("_chunk", "_island")


def encode_runs(signal: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Runs of equal values at successive positions: by, start, end, value."""
    order = Window.partitionBy(*by, "_chunk").orderBy("pos")
    before = F.lag(F.struct("pos", F.col(value).alias("v"))).over(order)
    opens = F.when((before["pos"] == F.col("pos") - 1) & before["v"].eqNullSafe(F.col(value)), 0).otherwise(1)
    runs = signal.withColumn("_chunk", F.floor(F.col("pos") / CHUNK)).withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(order))
    parts = runs.groupBy(*by, "_chunk", "_run").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.first(value).alias("value")).drop("_chunk", "_run")
    return joined_runs(parts, by, {}, ["value"])


def spread_ranges(ranges: DataFrame, by: list[str], more: list[str] = ()) -> DataFrame:
    """by, pos and more: a row for each position of [start, end). Ranges are dealt out in chunks before they are spread."""
    c = F.col
    chunks = ranges.select(*by, "start", "end", *more, F.explode(F.sequence(F.floor(c("start") / CHUNK), F.floor((c("end") - 1) / CHUNK))).alias("_chunk")).repartition(*by, "_chunk")
    inside = F.sequence(F.greatest(c("start"), c("_chunk") * CHUNK).cast("long"), F.least(c("end"), (c("_chunk") + 1) * CHUNK).cast("long") - 1)
    return chunks.select(*by, *more, F.explode(inside).alias("pos"))


def densify(runs: DataFrame, lengths: DataFrame, by: list[str], default: float = 0.0) -> DataFrame:
    """A value for each position of [0, length): by, pos, value. Of runs that overlap, the one with the greatest ``row`` counts, where there is such a column."""
    spine = spread_ranges(lengths.where("length > 0").select(*by, F.lit(0).cast("long").alias("start"), F.col("length").cast("long").alias("end")), by)
    inside = runs.join(lengths.select(*by, "length"), by).withColumns({"start": F.greatest("start", F.lit(0)), "end": F.least("end", "length")}).where("end > start")
    row = [c for c in ("row",) if c in runs.columns]
    points = spread_ranges(inside, by, ["value", *row])
    last = F.max_by("value", "row") if row else F.max("value")
    return spine.join(points.groupBy(*by, "pos").agg(last.alias("value")), [*by, "pos"], "left").withColumn("value", F.coalesce("value", F.lit(default)))


def in_chunks(signal: DataFrame, by: list[str], reach: int, columns: dict[str, Column], chunk: int = CHUNK) -> DataFrame:
    """Adds columns, windows over at most ``reach`` rows to each side within (by, _chunk) by pos, chunk by chunk.

    Positions must be dense, or gaps only shorten what a window sees.
    """
    if reach >= chunk:
        raise ValueError("windows must be shorter than chunks")
    home = F.floor(F.col("pos") / chunk)
    low, high = F.floor((F.col("pos") - reach) / chunk), F.floor((F.col("pos") + reach) / chunk)
    spread = signal.withColumn("_home", home).withColumn("_chunk", F.explode(F.sequence(low, high)))
    return spread.withColumns(columns).where("_home = _chunk").drop("_home", "_chunk")


def _frame(by: list[str], half: int):
    return Window.partitionBy(*by, "_chunk").orderBy("pos").rowsBetween(-half, half)


def moving_average(signal: DataFrame, by: list[str], window: int, value: str = "value", chunk: int = CHUNK) -> DataFrame:
    """Adds sm: the mean of the ``window // 2`` positions on each side and the position itself, fewer at the ends."""
    if window <= 1:
        return signal.withColumn("sm", F.col(value).cast("double"))
    return in_chunks(signal, by, window // 2, {"sm": F.sum(value).over(_frame(by, window // 2)) / F.count(value).over(_frame(by, window // 2))}, chunk)


def mask_override(signal: DataFrame, by: list[str]) -> DataFrame:
    """Sets sm of masked positions to one more than the greatest of the contig."""
    top = signal.groupBy(*by).agg(F.max("sm").alias("_top"))
    return signal.join(top, by).withColumn("sm", F.when(F.col("masked"), F.col("_top") + 1).otherwise(F.col("sm"))).drop("_top")


def percentile_threshold(signal: DataFrame, by: list[str], percent: float) -> DataFrame:
    """by, thr: the unmasked value at place floor(n * percent / 100) of the ascending order, at most the last.

    Values are counted before they are ordered, so the order holds each distinct value once.
    """
    counts = signal.where(~F.col("masked")).groupBy(*by, "sm").count()
    order = Window.partitionBy(*by).orderBy("sm")
    total = F.sum("count").over(Window.partitionBy(*by))
    through = counts.withColumn("_through", F.sum("count").over(order)).withColumn("_place", F.least(F.floor(total * percent / 100), total - 1))
    return through.where(F.col("_through") > F.col("_place")).groupBy(*by).agg(F.min("sm").alias("thr"))


def local_minima(signal: DataFrame, thresholds: DataFrame, by: list[str], radius: int, chunk: int = CHUNK) -> DataFrame:
    """The unmasked positions whose sm is at most thr and, to 1e-12, the least unmasked one within the radius: by, pos, sm."""
    least = F.min(F.when(~F.col("masked"), F.col("sm"))).over(_frame(by, radius))
    seen = in_chunks(signal, by, radius, {"_least": least}, chunk)
    return seen.join(thresholds, by).where(~F.col("masked") & (F.col("sm") <= F.col("thr")) & (F.col("sm") <= F.col("_least") + 1e-12)).select(*by, "pos", "sm")


def suppress(valleys: DataFrame, by: list[str], radius: int) -> DataFrame:
    """Greedy suppression: by ascending value, then position, a valley goes if it is within the radius of one that stays.

    Valleys further apart than the radius do not touch, so each cluster of close ones is a group of its own.
    """
    order = Window.partitionBy(*by).orderBy("pos")
    opens = F.when(F.col("pos") - F.lag("pos").over(order) <= radius, 0).otherwise(1)
    clusters = valleys.withColumn("_opens", opens).withColumn("_cluster", F.sum("_opens").over(order)).drop("_opens")

    def fold(x: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        for at, pos in x.sort_values(["sm", "pos"])["pos"].items():
            if all(abs(pos - x.at[k, "pos"]) > radius for k in kept):
                kept.append(at)
        return x.loc[kept].drop(columns="_cluster")

    alone = clusters.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(*by, "_cluster")))
    single = alone.where("_size = 1").select(*valleys.columns)
    return single.unionByName(alone.where("_size > 1").drop("_size").groupBy(*by, "_cluster").applyInPandas(fold, valleys.schema))


def low_islands(signal: DataFrame, thresholds: DataFrame, by: list[str], factor: float = 1.0) -> DataFrame:
    """Maximal runs with sm <= thr * factor: by, start, end, low (least sm), low_pos (its first position)."""
    low = signal.join(thresholds, by).where(F.col("sm") <= F.col("thr") * factor)
    parts = _chunk_runs(low, by, {"_low": F.min(F.struct("sm", "pos"))})
    return joined_runs(parts, by, {"_low": F.min("_low")}).select(*by, "start", "end", F.col("_low.sm").alias("low"), F.col("_low.pos").alias("low_pos"))


#: Positions of a bin in which valleys and islands meet.
SPAN_BIN = 16_384


def valley_spans(valleys: DataFrame, islands: DataFrame, by: list[str], max_expand: int | None = None) -> DataFrame:
    """by, start, end, pos, sm: the islands that hold a valley, each once, with its least valley.

    With ``max_expand`` a valley's span is that part of its island which is so near, and one island may keep several (see apart()).
    """
    i = islands.select(*by, "start", "end", F.explode(F.sequence(F.floor(F.col("start") / SPAN_BIN), F.floor((F.col("end") - 1) / SPAN_BIN))).alias("_bin"))
    met = valleys.withColumn("_bin", F.floor(F.col("pos") / SPAN_BIN)).join(i, [*by, "_bin"])
    inside = met.where((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end"))).select(*by, "start", "end", "pos", "sm")
    if max_expand is None:
        return inside.groupBy(*by, "start", "end").agg(F.min(F.struct("sm", "pos")).alias("v")).select(*by, "start", "end", "v.pos", "v.sm")
    return apart(inside.withColumns({"start": F.greatest("start", F.col("pos") - max_expand), "end": F.least("end", F.col("pos") + max_expand + 1)}), by)


def apart(spans: DataFrame, by: list[str]) -> DataFrame:
    """Greedy choice of spans (start, end, pos, sm) that do not overlap: by ascending value, then position.

    Spans that overlap, directly or through others, are one group; those that overlap none stay as they are.
    """
    order = Window.partitionBy(*by).orderBy("start", "end", "pos")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    clusters = spans.withColumn("_new", F.when(reached > F.col("start"), 0).otherwise(1)).withColumn("_cluster", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")

    def fold(x: pd.DataFrame) -> pd.DataFrame:
        starts: list[int] = []  # of what stays, in order, with the ends beside them
        ends: list[int] = []
        kept = []
        for at, row in x.sort_values(["sm", "pos"])[["start", "end"]].iterrows():
            i = bisect.bisect_left(starts, row["end"])
            if i and ends[i - 1] > row["start"]:
                continue
            starts.insert(i, row["start"])
            ends.insert(i, row["end"])
            kept.append(at)
        return x.loc[kept].drop(columns="_cluster")

    sized = clusters.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(*by, "_cluster")))
    single = sized.where("_size = 1").select(*spans.columns)
    return single.unionByName(sized.where("_size > 1").drop("_size").groupBy(*by, "_cluster").applyInPandas(fold, spans.schema))


def radius(window: int, given: int | None = None) -> int:
    """The radius for a smoothing window: two fifths of it unless given, one fifth at least, and 1."""
    return max(int(max(1, 2 * window / 5)) if given is None else given, int(max(1, 2 * window / 10)))


def coverage(smooth: DataFrame, by: list[str]) -> DataFrame:
    """by, pos1, coverage_raw, coverage_smooth of each position (with value and sm), as text with six digits."""
    text = lambda c: F.format_string("%.6f", F.col(c).cast("double"))
    return smooth.select(*by, (F.col("pos") + 1).alias("pos1"), text("value").alias("coverage_raw"), text("sm").alias("coverage_smooth"))


def fixed_spans(valleys: DataFrame, lengths: DataFrame, by: list[str], half: int) -> DataFrame:
    """[pos - half, pos + half + 1) inside the contig."""
    return valleys.join(lengths, by).withColumns({"start": F.greatest(F.col("pos") - half, F.lit(0)), "end": F.least(F.col("pos") + half + 1, F.col("length"))}).drop("length")


def anchors(spans: DataFrame, by: list[str], scale: float, min_length: int = 1) -> DataFrame:
    """by, start, end, anchor_id, score, strand of spans that are long enough; ids count positions from 1."""
    return spans.where(F.col("end") - F.col("start") >= min_length).select(*by, "start", "end", F.concat(F.lit("anchor_"), (F.col("pos") + 1).cast("string")).alias("anchor_id"), F.bround(F.col("sm") * scale).cast("long").alias("score"), F.lit("+").alias("strand"))


def high_runs(signal: DataFrame, thresholds: DataFrame, by: list[str], min_length: int, scale: float) -> DataFrame:
    """Maximal unmasked runs with sm > thr of at least a length: by, start, end, name, score; names count the runs that are kept."""
    high = signal.join(thresholds, by).where(~F.col("masked") & (F.col("sm") > F.col("thr")))
    parts = _chunk_runs(high, by, {"_sum": F.sum("sm"), "_n": F.count(F.lit(1))})
    runs = joined_runs(parts, by, {"mean": F.sum("_sum") / F.sum("_n")})
    kept = runs.where(F.col("end") - F.col("start") >= min_length)
    number = F.row_number().over(Window.partitionBy(*by).orderBy("start"))
    return kept.select(*by, "start", "end", F.concat(F.lit("repeat_"), number.cast("string")).alias("name"), F.bround(F.col("mean") * scale).cast("long").alias("score"))


def downsample(df: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """Every n-th row in order, n so that about ``most`` remain of each key."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumns({"_n": n, "_i": place - 1}).where(F.col("_i") % F.greatest(F.ceil(F.col("_n") / most), F.lit(1)) == 0).drop("_n", "_i")


def normalise(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Adds scaled: the value on [0, 1] within its key; as it is where all are equal. NaN counts as missing."""
    v = F.when(~F.isnan(F.col(value)), F.col(value))
    w = Window.partitionBy(*by)
    low, high = F.min(v).over(w), F.max(v).over(w)
    return df.withColumn("scaled", F.when(high > low, (v - low) / (high - low)).otherwise(v))
