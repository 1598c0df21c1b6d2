"""Interval operators. Intervals are rows with the key columns, start and end (0-based, half-open)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corrspark.functions.coords import clip


def _merge_within(iv: DataFrame, by: list[str], max_gap: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reached.isNull() | (F.col("start") - reached > max_gap), 1).otherwise(0)
    islands = iv.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("_island")


def merge(iv: DataFrame, by: list[str], max_gap: int = 0, bin_width: int = 1 << 20) -> DataFrame:
    """Unions intervals that overlap, touch, or lie at most ``max_gap`` apart: by, start, end, n (intervals merged).

    First inside bins of the axis, which spreads a long contig over tasks; what is left of each bin is merged again.
    """
    own = iv.where("end > start").select(*by, "start", "end", (F.col("n") if "n" in iv.columns else F.lit(1).cast("long")).alias("n"))
    local = _merge_within(own.withColumn("_bin", F.floor(F.col("start") / bin_width)), [*by, "_bin"], max_gap).drop("_bin")
    return _merge_within(local, by, max_gap)


def pad(iv: DataFrame, lengths: DataFrame, by: list[str], size: int) -> DataFrame:
    """Adds ``size`` on both sides, inside [0, length]; drops what is empty. lengths: by, length."""
    joined = iv.join(lengths.select(*by, "length"), by)
    a, b = clip(F.col("start"), F.col("end"), F.col("length"), size)
    return joined.withColumns({"start": a, "end": b}).where("end > start").drop("length")


def complement(iv: DataFrame, lengths: DataFrame, by: list[str]) -> DataFrame:
    """What intervals leave of [0, length): by, start, end. A contig without intervals is left whole, one without length is not."""
    merged = merge(iv, by).join(lengths.select(*by, "length"), by)
    inside = merged.select(*by, F.greatest("start", F.lit(0)).alias("start"), F.least("end", "length").alias("end")).where("end > start")
    ends = lengths.where("length > 0").select(*by, F.col("length").cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
    order = Window.partitionBy(*by).orderBy("start", F.col("end").isNull())
    gaps = inside.select(*by, F.col("start").cast("long"), F.col("end").cast("long")).unionByName(ends).withColumn("_from", F.coalesce(F.lag("end").over(order), F.lit(0).cast("long")))
    return gaps.where(F.col("start") > F.col("_from")).select(*by, F.col("_from").alias("start"), F.col("start").alias("end"))


def _binned(iv: DataFrame, width: int) -> DataFrame:
    last = F.greatest(F.col("end") - 1, F.col("start"))
    return iv.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(last / width))))


def overlapping(iv: DataFrame, other: DataFrame, by: list[str], keep: bool = True, width: int = 1 << 12) -> DataFrame:
    """The rows of ``iv`` that overlap an interval of ``other`` (keep), or none.

    ``other`` is merged first, so it is small and disjoint. Both sides are dealt to bins of the axis and meet in an
    equi-join on the bin; the rows' hits are counted by row number, not by value, so equal rows stay apart.
    """
    target = _binned(merge(other, by), width).select(*by, "_bin", F.col("start").alias("_a"), F.col("end").alias("_b"))
    hit = (F.col("start") < F.col("_b")) & (F.col("_a") < F.col("end"))
    probe = iv.withColumn("_bins", F.sequence(F.floor(F.col("start") / width), F.floor(F.greatest(F.col("end") - 1, F.col("start")) / width)))
    # most rows lie in one bin: these need no row numbers
    single = probe.where(F.size("_bins") == 1).withColumn("_bin", F.col("_bins")[0])
    several = probe.where(F.size("_bins") > 1)
    kind = "left_semi" if keep else "left_anti"

    def meets(rows: DataFrame) -> DataFrame:
        left, right = rows.alias("l"), target.alias("r")
        on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in [*by, "_bin"]]
        condition = on[0]
        for c in on[1:]:
            condition = condition & c
        return left.join(right, condition & hit, kind)

    whole = meets(single).select(*iv.columns)
    values = F.xxhash64(*[F.col(c).cast("string") for c in iv.columns])
    keyed = several.withColumn("_row", values)
    spread = keyed.select("_row", *by, "start", "end", F.explode("_bins").alias("_bin")).join(target, [*by, "_bin"]).where(hit).select("_row").distinct()
    return whole.unionByName(keyed.join(spread, "_row", kind).select(*iv.columns))


def flag_runs(iv: DataFrame, lengths: DataFrame, by: list[str]) -> DataFrame:
    """by, start, end, flag: runs of 1 inside intervals and 0 outside that cover each contig."""
    joined = merge(iv, by).join(lengths.select(*by, "length"), by)
    inside = joined.select(*by, F.greatest("start", F.lit(0)).cast("long").alias("start"), F.least("end", "length").cast("long").alias("end"), F.lit(1).alias("flag")).where("end > start")
    return inside.unionByName(complement(iv, lengths, by).withColumn("flag", F.lit(0)))


def longest(iv: DataFrame, by: list[str], view: int) -> DataFrame:
    """The longest interval of each key (the first of equals) and a view of ``view`` bases about its middle."""
    best = F.max_by(F.struct("start", "end"), F.struct((F.col("end") - F.col("start")).alias("n"), (-F.col("start")).alias("s")))
    chosen = iv.groupBy(*by).agg(best.alias("_best")).select(*by, "_best.start", "_best.end")
    middle = F.floor((F.col("start") + F.col("end")) / 2)
    return chosen.withColumn("view_start", F.greatest(F.col("start"), middle - view // 2)).withColumn("view_end", F.least(F.col("end"), F.col("view_start") + view))


def expand(iv: DataFrame, windows: list[int]) -> DataFrame:
    """Each interval widened by each window, never below 0, with the window's size."""
    spread = iv.withColumn("window", F.explode(F.array(*[F.lit(w) for w in windows])))
    return spread.withColumns({"start": F.greatest(F.col("start") - F.col("window"), F.lit(0)), "end": F.col("end") + F.col("window")})


def split_by_length(df: DataFrame, length: str, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Rows of at least the threshold, and shorter ones; rows without a length are in neither."""
    return df.where(F.col(length) >= threshold), df.where(F.col(length) < threshold)
