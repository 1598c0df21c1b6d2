"""Families: a wide table with a row for each family and, for each sample s, chrom_s, center_s and anchor_id_s."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrspark.functions.text import numeric, safe_name
from corrspark.operators import records, signal


def samples(wide: DataFrame) -> list[str]:
    """Samples that have both chrom_ and center_ columns, in order of the columns."""
    return [c.removeprefix("chrom_") for c in wide.columns if c.startswith("chrom_") and len(c) > 6 and f"center_{c.removeprefix('chrom_')}" in wide.columns]


def _member(wide: DataFrame, sample: str) -> Column:
    c = lambda name: F.col(f"`{name}_{sample}`") if f"{name}_{sample}" in wide.columns else F.lit(None)
    center = c("center")
    if dict(wide.dtypes).get(f"center_{sample}") == "string":
        center = numeric(center)
    center = F.when(~F.isnan(center.cast("double")), center.cast("double"))
    return F.struct(F.lit(sample).alias("sample"), c("chrom").cast("string").alias("chrom"), center.alias("center"), c("anchor_id").cast("string").alias("anchor_id"))


def members(wide: DataFrame, family: str = "ref_anchor_id") -> DataFrame:
    """family, sample, chrom, center, anchor_id: a row for each sample that a family is placed in."""
    rows = wide.select(F.coalesce(F.col(family).cast("string"), F.lit(".")).alias("family"), F.explode(F.array(*[_member(wide, s) for s in samples(wide)])).alias("m"))
    return rows.select("family", "m.*").where("chrom is not null and center is not null")


def contig_sizes(placed: DataFrame, half: int) -> DataFrame:
    """sample, chrom, size: the greatest whole center and ``half`` more, at least 1."""
    return placed.groupBy("sample", "chrom").agg(F.greatest(F.max(F.col("center").cast("long")) + half, F.lit(1).cast("long")).alias("size"))


def sample_pairs(names: list[str], wanted: str | None = None) -> list[tuple[str, str]]:
    """(reference, target): those of ``wanted`` (a:b, joined by commas), else the first sample with each other one.

    Parts without a colon are passed over; a name that is no sample is an error.
    """
    if not wanted:
        return [(names[0], x) for x in names[1:]] if names else []
    found = []
    for ref, _, target in (p.strip().partition(":") for p in wanted.split(",") if ":" in p):
        if ref not in names or target not in names:
            raise ValueError(f"{ref}:{target} is not a pair of {names}")
        found.append((ref, target))
    return found


def family_records(wide: DataFrame, half: int, pairs: list[tuple[str, str]], family: str = "ref_anchor_id") -> DataFrame:
    """Records (see records.from_pairs) with ref_sample, target_sample and path_name, one for each family and pair of samples it is in.

    The reference is the record's query side, as it is written first. Pairs are made inside the row, so families do not shuffle;
    contig sizes are inferred from the table and joined.
    """
    c = F.col
    placed = members(wide, family)
    size = contig_sizes(placed, half)
    spread = F.explode(F.array(*[F.struct(_member(wide, a).alias("a"), _member(wide, b).alias("b")) for a, b in pairs]))
    both = wide.select(F.coalesce(c(family).cast("string"), F.lit(".")).alias("family"), spread.alias("p"))
    rows = both.select("family", *[c(f"p.{s}.{x}").alias(f"{s}_{x}") for s in "ab" for x in ("sample", "chrom", "center")]).where("a_chrom is not null and b_chrom is not null and a_center is not null and b_center is not null")
    for s in "ab":
        rows = rows.join(size.select(c("sample").alias(f"{s}_sample"), c("chrom").alias(f"{s}_chrom"), c("size").alias(f"{s}_size")), [f"{s}_sample", f"{s}_chrom"])
    whole = lambda x: c(x).cast("long").cast("double")
    named = rows.select(
        c("a_chrom").alias("qname"),
        c("a_size").alias("qlen"),
        c("b_chrom").alias("tname"),
        c("b_size").alias("tlen"),
        whole("a_center").alias("qry_center"),
        whole("b_center").alias("ref_center"),
        F.array(F.concat(F.lit("id:Z:"), c("family"))).alias("tags"),
        c("a_sample").alias("ref_sample"),
        c("b_sample").alias("target_sample"),
        F.concat(safe_name(c("a_sample")), F.lit("_vs_"), safe_name(c("b_sample"))).alias("path_name"),
    )
    return records.from_pairs(named, half, keep=["ref_sample", "target_sample", "path_name"])


def lanes(wide: DataFrame, centers: DataFrame, columns: dict[str, str], least: int = 2, scale: bool = True, family: str = "ref_anchor_id") -> DataFrame:
    """family, lane, anchor_id, x of the families that ``least`` lanes (and two at least) know.

    ``columns``: lane to the column with its anchor ids. ``centers``: lane, anchor_id, center; where an id repeats the greatest
    center counts. ``scale``: positions on [0, 1] of each lane.
    """
    known = centers.where(F.col("lane").isin(*columns)).groupBy("lane", "anchor_id").agg(F.max(F.col("center").cast("double")).alias("center"))
    known = signal.normalise(known, ["lane"], "center").select("lane", "anchor_id", F.col("scaled" if scale else "center").alias("x"))
    ids = F.explode(F.array(*[F.struct(F.lit(lane).alias("lane"), F.col(f"`{c}`").cast("string").alias("anchor_id")) for lane, c in columns.items()]))
    rows = wide.withColumn("_row", F.monotonically_increasing_id()).select("_row", F.coalesce(F.col(family).cast("string"), F.lit(".")).alias("family"), ids.alias("m")).select("_row", "family", "m.*")
    met = rows.join(known, ["lane", "anchor_id"])
    enough = met.groupBy("_row").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= max(least, 2))
    return met.join(enough.select("_row"), "_row", "left_semi").select("family", "lane", "anchor_id", "x")
