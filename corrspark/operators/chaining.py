"""Colinear chains of links and bundles of chains. Links: key columns, ref_center, qry_center, rid, qid."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrspark.functions.coords import invert
from corrspark.session import cut


class _Walk:
    """Links in order: whether each stays, and the number of its chain (from ``before``). ``skipped`` links were dropped last, from a state that no link can go on from."""

    def __init__(self, limits: tuple[float, float, float, float], max_skip: int, skipped: int, before: int = 0):
        self.limits, self.max_skip = limits, max_skip
        self.skipped, self.number, self.last = skipped, before - 1, None

    def step(self, x: float, y: float) -> bool:
        goes_on = False
        if self.last is not None:
            gap_ref, gap_qry, low, high = self.limits
            dr, dq = x - self.last[0], y - self.last[1]
            goes_on = 0 < dr <= gap_ref * (self.skipped + 1) and abs(dq) <= gap_qry * (self.skipped + 1) and low <= dq / dr <= high
        if not goes_on:
            if self.skipped < self.max_skip:
                self.skipped += 1
                return False
            self.number += 1
        self.last, self.skipped = (x, y), 0
        return True


def _listed(batch: pa.RecordBatch, *columns: str) -> list[list]:
    return [batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in columns]


def chain(links: DataFrame, by: list[str], gap_ref: float, gap_qry: float, slope: tuple[float, float], max_skip: int = 5) -> DataFrame:
    """The links that stay, with chain (a number for each key).

    Links are taken by (ref_center, qry_center, rid). One that does not go on from the last is dropped, and limits grow with
    each drop in a row; after ``max_skip`` drops the next opens a chain. A key is cut where no link can go on, whatever was dropped before.
    Only the number of drops passes such a gap, so each segment says for each of these numbers how it ends; the segments' answers are put together
    for each key, a row for each segment, and then each segment is walked by itself. Tasks take the sorted rows of many segments as a stream,
    so a segment costs its rows alone and is never held whole.
    """
    limits, own = (gap_ref, gap_qry, *slope), links.columns
    places = [F.col(c).asc_nulls_last() for c in ("ref_center", "qry_center", "rid")]
    order = Window.partitionBy(*by).orderBy(*places)
    far = F.col("ref_center") - F.lag("ref_center").over(order) > gap_ref * (max_skip + 1)
    placed = links.withColumn("_far", F.when(far, 1).otherwise(0)).withColumn("_segment", F.sum("_far").over(order)).drop("_far")
    cut_up = cut(placed, "chain-segments")
    segment = Window.partitionBy(*by, "_segment").orderBy(*places)
    bounds = {"_first": F.row_number().over(segment) == 1, "_end": F.lead(F.lit(1)).over(segment).isNull()}
    keys = T.StructType([*(links.schema[c] for c in by), T.StructField("_segment", T.LongType())])
    ends = T.StructType([*keys, T.StructField("_ends", T.ArrayType(T.IntegerType())), T.StructField("_opened", T.ArrayType(T.LongType()))])
    starts = T.StructType([*keys, T.StructField("_skipped", T.IntegerType()), T.StructField("_before", T.LongType())])

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks: list[_Walk] = []
        for batch in batches:
            found = []
            for x, y, first, end in zip(*_listed(batch, "ref_center", "qry_center", "_first", "_end"), strict=True):
                if first:
                    walks = [_Walk(limits, max_skip, s) for s in range(max_skip + 1)]
                for walk in walks:
                    walk.step(x, y)
                if end:
                    found.append(([w.skipped for w in walks], [w.number + 1 for w in walks]))
            rows = batch.filter(batch.column("_end")).select(keys.names)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([e for e, _ in found], pa.list_(pa.int32())), pa.array([o for _, o in found], pa.list_(pa.int64()))], ends.names)

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skipped, before = max_skip, 0
        for batch in batches:
            out = []
            for first, ended, opened in zip(*(batch.column(c).to_pylist() for c in ("_first", "_ends", "_opened")), strict=True):
                if first:
                    skipped, before = max_skip, 0  # the first link of all opens a chain
                out.append((skipped, before))
                before += opened[skipped]
                skipped = ended[skipped]
            yield pa.RecordBatch.from_arrays([*batch.select(keys.names).columns, pa.array([s for s, _ in out], pa.int32()), pa.array([b for _, b in out], pa.int64())], starts.names)

    sizes = cut_up.groupBy(*by).agg(F.max("_segment").alias("_last"))
    several = cut_up.join(sizes.where("_last > 0"), by).select(*keys.names, "ref_center", "qry_center", "rid").withColumns(bounds)
    answered = several.mapInArrow(answers, ends).withColumn("_first", F.row_number().over(Window.partitionBy(*by).orderBy("_segment")) == 1)
    known = answered.mapInArrow(put_together, starts)
    whole = sizes.where("_last = 0").select(*by, F.lit(0).cast("long").alias("_segment"), F.lit(max_skip).alias("_skipped"), F.lit(0).cast("long").alias("_before"))
    ready = cut_up.join(known.unionByName(whole), [*by, "_segment"]).select(*own, "_segment", "_skipped", "_before").withColumns(bounds)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk: _Walk | None = None
        for batch in batches:
            numbers = []
            for x, y, first, skipped, before in zip(*_listed(batch, "ref_center", "qry_center", "_first", "_skipped", "_before"), strict=True):
                if first:
                    walk = _Walk(limits, max_skip, skipped, before)
                numbers.append(walk.number if walk.step(x, y) else None)
            chains = pa.array(numbers, pa.int64())
            rows = pa.RecordBatch.from_arrays([*batch.select(own).columns, chains], [*own, "chain"])
            yield rows.filter(chains.is_valid())

    return ready.mapInArrow(fold, T.StructType([*links.schema, T.StructField("chain", T.LongType())]))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def bundle_stats(chained: DataFrame, by: list[str], min_links: int = 1, min_span: float = 0.0) -> DataFrame:
    """One row for each chain of enough links and span: ranges, n_links, slope_med, b0_med, resid_mad, greatest steps, ids.

    Medians are exact and taken from the chain's own array of links, in order. What a lambda takes from outside is bound by _bound:
    the optimizer would copy its expression into the lambda, to be evaluated once more for each link.
    """
    link = F.struct("ref_center", "qry_center", "rid", "qid")
    rows = chained.groupBy(*by, "chain").agg(F.sort_array(F.collect_list(link)).alias("_l"), F.count(F.lit(1)).alias("n_links"))
    rows = rows.where(F.col("n_links") >= min_links)

    def middle(s):
        n = F.size(s)
        return F.when(n > 0, (F.try_element_at(s, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(s, F.floor(n / 2).cast("int") + 1)) / 2)

    def median(values):
        return _bound(F.sort_array(F.array_compact(values)), middle)

    steps = F.zip_with(F.slice("_l", F.lit(1), F.greatest(F.size("_l") - 1, F.lit(0))), F.slice("_l", F.lit(2), F.greatest(F.size("_l") - 1, F.lit(0))), lambda a, b: F.struct((b["ref_center"] - a["ref_center"]).alias("dr"), (b["qry_center"] - a["qry_center"]).alias("dq")))
    rows = rows.withColumn("_d", steps).withColumn("slope_med", median(F.transform(F.filter("_d", lambda d: d["dr"] > 0), lambda d: d["dq"] / d["dr"])))
    a = F.coalesce("slope_med", F.lit(1.0))
    rows = rows.withColumn("b0_med", median(_bound(a, lambda a: F.transform("_l", lambda x: x["qry_center"] - a * x["ref_center"]))))
    resid = _bound(a, lambda a: _bound(F.col("b0_med"), lambda b: F.transform("_l", lambda x: x["qry_center"] - (a * x["ref_center"] + b))))
    rows = rows.withColumn("_r", resid).withColumn("resid_mad", _bound(median(F.col("_r")), lambda m: median(F.transform("_r", lambda v: F.abs(v - m)))))
    out = rows.select(
        *by,
        "chain",
        F.array_min(F.transform("_l", lambda x: x["ref_center"])).alias("ref_start"),
        F.array_max(F.transform("_l", lambda x: x["ref_center"])).alias("ref_end"),
        F.array_min(F.transform("_l", lambda x: x["qry_center"])).alias("qry_start"),
        F.array_max(F.transform("_l", lambda x: x["qry_center"])).alias("qry_end"),
        "n_links",
        "slope_med",
        "b0_med",
        "resid_mad",
        F.coalesce(F.array_max(F.transform("_d", lambda d: d["dr"])), F.lit(0.0)).alias("max_gap_ref"),
        F.coalesce(F.array_max(F.transform("_d", lambda d: F.abs(d["dq"]))), F.lit(0.0)).alias("max_gap_qry"),
        F.transform("_l", lambda x: x["rid"]).alias("rids"),
        F.transform("_l", lambda x: x["qid"]).alias("qids"),
    )
    return out.where(F.col("ref_end") - F.col("ref_start") >= min_span)


def both_strands(links: DataFrame, length: str) -> DataFrame:
    """Each link as it is (strand +), and, where the query's length is known, with its center on the reversed axis (-)."""
    there = F.array(F.struct(F.lit("+").alias("strand"), F.col("qry_center").alias("at")), F.struct(F.lit("-").alias("strand"), (F.col(length) - F.col("qry_center")).alias("at")))
    spread = links.withColumn("_s", F.explode(there)).where(F.col("_s.at").isNotNull())
    return spread.withColumns({"strand": F.col("_s.strand"), "qry_center": F.col("_s.at")}).drop("_s")


def raw_bundles(bundles: DataFrame, length: str) -> DataFrame:
    """Query ranges of - bundles on the axis as it is."""
    a, b = invert(F.col("qry_start"), F.col("qry_end"), F.col(length))
    minus = F.col("strand") == "-"
    return bundles.withColumns({"qry_start": F.when(minus, a).otherwise(F.col("qry_start")), "qry_end": F.when(minus, b).otherwise(F.col("qry_end"))})


def parallel(base: str, other: str, slope_tol: float, pad: float):
    """Whether two bundles (aliases) have like slopes and meet on the reference, give or take ``pad``."""
    c = F.col
    return (F.abs(c(f"{other}.slope_med") - c(f"{base}.slope_med")) <= slope_tol) & (c(f"{other}.ref_end") >= c(f"{base}.ref_start") - pad) & (c(f"{base}.ref_end") + pad >= c(f"{other}.ref_start"))


def merge_parallel(bundles: DataFrame, by: list[str], slope_tol: float = 0.06, ref_gap: float = 50_000.0, qry_gap: float = 50_000.0, b0_tol: float = 5_000.0, near: bool = True) -> DataFrame:
    """Joins successive bundles of one strand whose slope is that of the run's first and which are close on both axes.

    The slope becomes the median of two, the intercept stays the first's; a bundle that does not fit opens a new run. Without ``near``
    the query's axis plays no part.
    """
    schema = bundles.schema

    def fold(x: pd.DataFrame) -> pd.DataFrame:
        runs: list[dict] = []
        seed = np.nan
        for row in x.sort_values(["ref_start", "chain"]).to_dict("records"):
            now = runs[-1] if runs else None
            fits = (
                now is not None
                and row["strand"] == now["strand"]
                and abs(row["slope_med"] - seed) <= slope_tol
                and abs(row["b0_med"] - now["b0_med"]) <= b0_tol
                and row["ref_start"] <= now["ref_end"] + ref_gap
                and (not near or (row["qry_start"] <= now["qry_end"] + qry_gap and now["qry_start"] <= row["qry_end"] + qry_gap))
            )
            if not fits:
                runs.append(dict(row))
                seed = row["slope_med"]
                continue
            for c, pick in (("ref_start", min), ("ref_end", max), ("qry_start", min), ("qry_end", max), ("resid_mad", max), ("max_gap_ref", max), ("max_gap_qry", max)):
                now[c] = pick(now[c], row[c])
            now["n_links"] += row["n_links"]
            now["rids"], now["qids"] = [*now["rids"], *row["rids"]], [*now["qids"], *row["qids"]]
            now["slope_med"] = (now["slope_med"] + row["slope_med"]) / 2
        return pd.DataFrame(runs, columns=schema.names)

    return bundles.groupBy(*by).applyInPandas(fold, schema)


def emit(bundles: DataFrame, by: list[str], ids: bool = False) -> DataFrame:
    """Bundle rows for output: whole coordinates (half to even), spans, ids B000001 and on for each key.

    The links' ids come joined by commas, or, with ``ids``, as the arrays rids and qids.
    """
    order = [c for c in ("chrom", "strand") if c in bundles.columns and c not in by]
    number = F.row_number().over(Window.partitionBy(*by).orderBy(*order, "ref_start", "chain"))
    whole = bundles.withColumn("bundle_id", F.format_string("B%06d", number))
    for c in ("ref_start", "ref_end", "qry_start", "qry_end"):
        whole = whole.withColumn(c, F.bround(c).cast("long"))
    whole = whole.withColumns({"ref_span": F.col("ref_end") - F.col("ref_start"), "qry_span": F.col("qry_end") - F.col("qry_start")}).drop("chain")
    return whole if ids else whole.withColumns({"ref_anchor_ids": F.array_join(F.col("rids").cast("array<string>"), ","), "qry_anchor_ids": F.array_join(F.col("qids").cast("array<string>"), ",")}).drop("rids", "qids")
