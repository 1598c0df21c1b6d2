"""Alignment records (PAF): qname, qlen, qstart, qend, strand, tname, tlen, tstart, tend, nmatch, alen, mapq, tags."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrspark.functions import cigar
from corrspark.functions.coords import lift

#: Codes of the na:i tag for records that could not be made, in the order in which they are looked for.
FAILURES = {"contig": 1, "empty": 2, "align": 3, "parse": 7, "bridge": 4, "trim": 5}


def best(records: DataFrame, by: list[str], order: str) -> DataFrame:
    """The record of each key with the greatest mapq, then alen; the first of equals."""
    w = Window.partitionBy(*by).orderBy(F.desc("mapq"), F.desc("alen"), order)
    return records.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def gap_candidates(records: DataFrame, most: int | None = None) -> DataFrame:
    """Gaps between neighbouring records of (tname, qname, strand): tname, qname, strand, gap_t, gap_q and both records' ends."""
    by = ["tname", "qname", "strand"]
    place = F.struct("tstart", "tend", "qstart", "qend")
    following = F.lead(place).over(Window.partitionBy(*by).orderBy("tstart", "tend", "qstart", "qend"))
    rows = records.select(*by, "tstart", "tend", "qstart", "qend", following.alias("_next")).where("_next is not null")
    gaps = rows.select(*by, "tend", "qend", F.col("_next.tstart").alias("next_tstart"), F.col("_next.qstart").alias("next_qstart")).withColumns({"gap_t": F.col("next_tstart") - F.col("tend"), "gap_q": F.col("next_qstart") - F.col("qend")})
    open_gaps = gaps.where("gap_t > 0 and gap_q > 0")
    return open_gaps if most is None else open_gaps.where(F.greatest("gap_t", "gap_q") <= most)


def lift_records(records: DataFrame, qry_begin: Column, qry_end: Column, ref_begin: Column, strand: Column) -> DataFrame:
    """Segment coordinates to those of the contigs; the record's strand becomes the bundle's, its own goes to ss:Z."""
    a, b = lift(F.col("qstart"), F.col("qend"), qry_begin, qry_end, strand)
    tags = F.concat(F.filter("tags", lambda t: ~t.startswith("id:Z:")), F.array(F.concat(F.lit("ss:Z:"), F.col("strand"))))
    return records.withColumns({"_a": a, "_b": b, "tstart": F.col("tstart") + ref_begin, "tend": F.col("tend") + ref_begin, "tags": tags, "_s": strand}).drop("qstart", "qend", "strand").withColumnsRenamed({"_a": "qstart", "_b": "qend", "_s": "strand"})


def retag(tags: Column, new: dict[str, Column]) -> Column:
    """Tags without those of the new names, then the new ones: name (like ``id:Z``) to value."""
    held = F.filter(tags, lambda t: ~F.array_contains(F.array(*[F.lit(n) for n in new]), F.substring_index(t, ":", 2)))
    return F.concat(held, F.array(*[F.concat(F.lit(f"{n}:"), v.cast("string")) for n, v in new.items()]))


def dedup(records: DataFrame, width: int, order: str) -> DataFrame:
    """One of the records whose ends fall into the same bins: the best by identity, then alen; the first of equals."""
    bins = [F.floor(F.col(c) / width).alias(f"_{c}") for c in ("tstart", "tend", "qstart", "qend")]
    keyed = records.select("*", *bins, (F.col("nmatch") / F.greatest(F.col("alen"), F.lit(1))).alias("_ident"))
    w = Window.partitionBy("tname", "qname", "strand", "_tstart", "_tend", "_qstart", "_qend").orderBy(F.desc("_ident"), F.desc("alen"), order)
    return keyed.withColumn("_i", F.row_number().over(w)).where("_i = 1").select(*records.columns)


def split_insertions(records: DataFrame, least: int) -> DataFrame:
    """A record whose CIGAR (column cigar) is =I= becomes its two matches, if both are long enough; others stay as they are.

    Half 0 is the left one; ``half`` is null for a whole record, ``hidden`` is the insertion's length.
    """
    ops = cigar.normalize(cigar.parse(F.col("cigar")))
    rows = records.withColumn("_ops", ops)
    left, ins, right = (F.try_element_at("_ops", F.lit(i))["n"] for i in (1, 2, 3))
    cuts = F.coalesce(cigar.is_pure_insertion(F.col("_ops")) & (left >= least) & (right >= least), F.lit(False))
    part = lambda h, ts, te, qs, qe, n: F.struct(F.lit(h).alias("half"), ts.alias("ts"), te.alias("te"), qs.alias("qs"), qe.alias("qe"), n.cast("long").alias("n"))
    c = F.col
    minus = c("strand") == "-"
    halves = F.array(
        part(0, c("tstart"), c("tstart") + left, F.when(minus, c("qend") - left).otherwise(c("qstart")), F.when(minus, c("qend")).otherwise(c("qstart") + left), left),
        part(1, c("tend") - right, c("tend"), F.when(minus, c("qstart")).otherwise(c("qend") - right), F.when(minus, c("qstart") + right).otherwise(c("qend")), right),
    )
    whole = rows.where(~cuts).drop("_ops").withColumns({"half": F.lit(None).cast("int"), "hidden": F.lit(None).cast("int")})
    split = rows.where(cuts).withColumns({"hidden": ins, "_h": F.explode(halves)})
    split = split.withColumns({"half": c("_h.half"), "tstart": c("_h.ts"), "tend": c("_h.te"), "qstart": c("_h.qs"), "qend": c("_h.qe"), "nmatch": c("_h.n"), "alen": c("_h.n"), "cigar": F.concat(c("_h.n").cast("string"), F.lit("="))}).drop("_h", "_ops")
    return whole.unionByName(split)


def bridges(aligned: DataFrame, tolerance: int) -> Column:
    """Whether an alignment of a gap's patch comes within ``tolerance`` of all its four ends."""
    c = F.col
    return (c("tstart") <= tolerance) & (c("tlen") - c("tend") <= tolerance) & (c("qstart") <= tolerance) & (c("qlen") - c("qend") <= tolerance)


def status_code(passed: dict[str, Column]) -> Column:
    """The code of the first step (see FAILURES) that was not passed, or 0."""
    out = F.lit(0)
    for name in reversed([x for x in FAILURES if x in passed]):
        out = F.when(~passed[name], FAILURES[name]).otherwise(out)
    return out


def resolve_contigs(wanted: DataFrame, contigs: DataFrame, name: str, forced: str | None = None) -> DataFrame:
    """Adds contig: the forced one, an equal name, the only contig there is, or the longest of the same base name.

    contigs: contig, length. A base name ends at the first ``:`` or ``__``.
    """
    base = lambda c: F.regexp_extract(c, r"^(.*?)(?::|__|$)", 1)
    if forced is not None:
        return wanted.withColumn("contig", F.lit(forced))
    exact = contigs.select(F.col("contig").alias("_exact"))
    w = Window.partitionBy("_base").orderBy(F.desc("length"), "contig")
    by_base = contigs.withColumn("_base", base(F.col("contig"))).withColumn("_i", F.row_number().over(w)).where("_i = 1").select("_base", F.col("contig").alias("_like"))
    single = contigs.agg(F.when(F.count(F.lit(1)) == 1, F.first("contig")).alias("_only"))  # one row
    joined = wanted.join(exact, F.col(name) == F.col("_exact"), "left").withColumn("_b", base(F.col(name))).join(by_base, F.col("_b") == F.col("_base"), "left").join(F.broadcast(single), F.lit(True), "left")  # an aggregate without keys has one row
    return joined.withColumn("contig", F.coalesce("_exact", "_only", "_like")).drop("_exact", "_b", "_base", "_like", "_only")


def from_pairs(pairs: DataFrame, half: int, keep: list[str] = ()) -> DataFrame:
    """A record of [center - half, center + half) on both axes, clipped, for each pair of centers (with both lengths).

    Tags are those of the pairs, if they have any; ``keep``: more columns that stay.
    """
    c = F.col
    at = lambda x, n: (F.greatest(F.bround(c(x)).cast("long") - half, F.lit(0)), F.least(F.bround(c(x)).cast("long") + half, c(n)))
    (ts, te), (qs, qe) = at("ref_center", "tlen"), at("qry_center", "qlen")
    rows = pairs.withColumns({"tstart": ts, "tend": te, "qstart": qs, "qend": qe}).where("tend > tstart and qend > qstart")
    n = F.least(c("tend") - c("tstart"), c("qend") - c("qstart"))
    return rows.select("qname", "qlen", "qstart", "qend", F.lit("+").alias("strand"), "tname", "tlen", "tstart", "tend", n.alias("nmatch"), n.alias("alen"), F.lit(60).alias("mapq"), (c("tags") if "tags" in pairs.columns else F.array().cast("array<string>")).alias("tags"), *keep)


def identity_cigar(t: str, q: str) -> str | None:
    """Matches and mismatches of two sequences of one length, else nothing."""
    if len(t) != len(q) or not t:
        return None
    runs = [(op, len(list(same))) for op, same in itertools.groupby("=" if a == b else "X" for a, b in zip(t, q, strict=True))]
    return "".join(f"{n}{op}" for op, n in runs)


def with_aligner(segments: DataFrame, align: Callable[[str, str], str | None] | None = None) -> DataFrame:
    """Adds cigar to rows with tseq and qseq by a function of both, by default identity_cigar()."""
    run_one = align or identity_cigar

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield x.assign(cigar=[run_one(t, q) if t and q else None for t, q in zip(x["tseq"], x["qseq"], strict=True)])

    return segments.mapInPandas(run, T.StructType([*segments.schema, T.StructField("cigar", T.StringType())]))
