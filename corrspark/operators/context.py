"""Anchors in order: gaps, contexts and token sequences. Rows: sample, chrom, anchor_id, center, gid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrspark.functions.coords import gap_bin

BY = ["sample", "chrom"]

#: Rows that a task takes before they are spread: a token has as many substrings as the longest one's length.
TASK_ROWS = 1 << 15


def in_tasks(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``df`` dealt out by ``keys``, TASK_ROWS of ``rows`` to a task; a number that is given is not coalesced by what rows weigh before they are spread."""
    return df.repartition(max(rows // TASK_ROWS + 1, df.sparkSession.sparkContext.defaultParallelism), *keys)


def order(anchors: DataFrame, beta: float) -> DataFrame:
    """Adds idx (from 0, by center, then id), n (anchors of the contig), gap and bin to the next anchor."""
    anchors = in_tasks(anchors, BY, anchors.count())
    w = Window.partitionBy(*BY).orderBy("center", "anchor_id")
    gap = F.lead("center").over(w) - F.col("center")
    return anchors.withColumns({"idx": (F.row_number().over(w) - 1).cast("long"), "n": F.count(F.lit(1)).over(Window.partitionBy(*BY)), "gap": gap}).withColumn("bin", gap_bin(F.col("gap"), beta))


def signatures(ordered: DataFrame, most: int) -> DataFrame:
    """Adds left and right: arrays of (g, b), the nearest neighbour first, at most ``most``, and k_max, how many both sides have."""
    w = Window.partitionBy(*BY).orderBy("idx")
    left = F.reverse(F.collect_list(F.struct(F.col("gid").alias("g"), F.col("bin").alias("b"))).over(w.rowsBetween(-most, -1)))
    before = F.lag("bin").over(w)
    with_before = ordered.withColumn("_before", before)
    right = F.collect_list(F.struct(F.col("gid").alias("g"), F.col("_before").alias("b"))).over(w.rowsBetween(1, most))
    return with_before.withColumns({"left": left, "right": right}).drop("_before").withColumn("k_max", F.least(F.size("left"), F.size("right")))


def inverted(signed: DataFrame) -> DataFrame:
    """The same anchors read against the axis."""
    return signed.withColumns({"left": F.col("right"), "right": F.col("left")})


def tokens(ordered: DataFrame, reverse: bool = False) -> DataFrame:
    """sample, chrom, t, token, anchor_id: groups (G:) and gap bins (D:) in turn, 2n - 1 for each contig."""
    pair = F.array(F.concat(F.lit("G:"), F.col("gid")), F.concat(F.lit("D:"), F.col("bin").cast("string")))
    spread = ordered.select(*BY, "anchor_id", "idx", "n", F.posexplode(pair).alias("_odd", "token")).where("token is not null")
    t = 2 * F.col("idx") + F.col("_odd")
    place = (2 * F.col("n") - 2 - t) if reverse else t
    return spread.select(*BY, place.cast("long").alias("t"), "token", F.when(F.col("_odd") == 0, F.col("anchor_id")).alias("anchor_id"))
