"""python -m corrspark COMMAND: the workflow over files, as a whole or by tool. Outputs are folders of part files."""

from __future__ import annotations

import argparse
from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrspark.functions.text import distinct_names, expand_inputs
from corrspark.operators import assembly, families, intervals, kmers, records
from corrspark.plans import pipeline
from corrspark.plans.pipeline import Settings
from corrspark.session import cut, get_session
from corrspark.sources import readers, writers

#: Options of the workflow's settings: flag, field, type.
_SETTINGS = (
    ("--padding", "padding", int),
    ("--merge-gap", "merge_gap", int),
    ("--window", "window", int),
    ("--percent", "percent", float),
    ("--radius", "radius", int),
    ("--span-factor", "span_factor", float),
    ("--max-expand", "max_expand", int),
    ("--half-span", "half_span", int),
    ("--min-anchor", "min_anchor", int),
    ("--unique-k", "unique_k", int),
    ("--max-count", "max_count", int),
    ("--group-k", "group_k", int),
    ("--gap-bin", "gap_bin", float),
    ("--longest-unique", "longest_unique", int),
    ("--target", "target", int),
    ("--distance", "distance", int),
    ("--min-links", "min_links", int),
    ("--gap", "gap", float),
    ("--min-span", "min_span", float),
    ("--parallel-slope", "parallel_slope", float),
    ("--merge-slope", "merge_slope", float),
    ("--merge-ref-gap", "merge_ref_gap", float),
    ("--merge-qry-gap", "merge_qry_gap", float),
    ("--merge-b0", "merge_b0", float),
)


def _add_settings(parser: argparse.ArgumentParser) -> None:
    known = {f.name: f.default for f in fields(Settings)}
    for flag, name, kind in _SETTINGS:
        parser.add_argument(flag, type=kind, default=None, help=f"{known[name]} unless given")
    parser.add_argument("--label", action="append", help="labels to look at")
    parser.add_argument("--contexts", type=int, help="the greatest k of contexts")
    parser.add_argument("--slope", type=float, nargs=2, help="least and greatest slope between links")
    parser.add_argument("--windows", help="windows of the last pass, joined by commas")
    parser.add_argument("--no-merge", action="store_true", help="leave parallel bundles apart")
    parser.add_argument("--merge-anywhere", action="store_true", help="merge bundles that are far apart on the query")
    parser.add_argument("--config", help="a file of key: value lines; options win over it")


def _settings(spark: SparkSession, args: argparse.Namespace) -> Settings:
    kinds = {name: kind for _, name, kind in _SETTINGS}
    chosen = {k: kinds[k](v) for k, v in (readers.settings(spark, args.config) if args.config else {}).items() if k in kinds}
    chosen |= {name: getattr(args, name) for name in kinds if getattr(args, name) is not None}
    if args.label:
        chosen["labels"] = tuple(args.label)
    if args.contexts:
        chosen["contexts"] = tuple(range(1, args.contexts + 1))
    if args.slope:
        chosen["slope"] = tuple(args.slope)
    if args.windows:
        chosen["windows"] = tuple(float(w) for w in args.windows.split(","))
    return replace(Settings(), **chosen, merge=not args.no_merge, merge_near=not args.merge_anywhere)


def _samples(args: argparse.Namespace, parser: argparse.ArgumentParser) -> list[tuple[str, str, str]]:
    fastas, beds = expand_inputs(args.fasta), expand_inputs(args.bed)
    names = args.names.split(",") if args.names else [f"{i:02d}_{n}" for i, n in enumerate(distinct_names([_stem(p) for p in fastas]))]
    if not len(fastas) == len(beds) == len(names):
        parser.error("sequences, intervals and names must be as many")
    return list(zip(distinct_names(names), fastas, beds, strict=True))


def _stem(path: str) -> str:
    from corrspark.functions.text import SUFFIXES

    name = path.rsplit("/", 1)[-1]
    return next((name.removesuffix(s) for s in SUFFIXES if name.endswith(s)), name)


def _read(spark: SparkSession, samples: list[tuple[str, str, str]]) -> tuple[DataFrame, DataFrame]:
    seqs, iv = None, None
    for name, fasta, bed in samples:
        own = readers.fasta(spark, fasta).select(F.lit(name).alias("sample"), F.col("name").alias("chrom"), "seq")
        rows = readers.bed(spark, bed).select(F.lit(name).alias("sample"), "chrom", "start", "end", "name", "strand")
        seqs, iv = (own, rows) if seqs is None else (seqs.unionByName(own), iv.unionByName(rows))
    return seqs, iv


def run(spark: SparkSession, args: argparse.Namespace, parser: argparse.ArgumentParser) -> None:
    """Masks, finds and groups anchors, finds what corresponds, and writes bundles and records."""
    s, samples = _settings(spark, args), _samples(args, parser)
    seqs, labelled = _read(spark, samples)
    hidden = cut(pipeline.masked_intervals(seqs, labelled, s), "hidden")
    masked = cut(pipeline.mask(seqs, hidden), "masked")
    anchors, high = pipeline.find_anchors(masked, hidden, s)
    anchors = cut(anchors, "anchors")
    found = pipeline.correspond(cut(pipeline.grouped_anchors(anchors, masked, s), "grouped"), samples[0][0], s)
    out = args.outdir
    writers.fasta(masked.select(F.concat_ws("|", "sample", "chrom").alias("name"), "seq"), f"{out}/masked")
    writers.delimited(anchors, f"{out}/anchors", by=["sample"])
    writers.delimited(high, f"{out}/repeats", by=["sample"])
    _write_found(found, out)
    writers.paf(pipeline.records_of(found, pipeline.lengths(seqs), samples[0][0], args.flank, args.max_bundle, args.keep_failed), f"{out}/records")


def _write_found(found: pipeline.Correspondence, out: str) -> None:
    writers.delimited(found.dictionary, f"{out}/dictionary", header=True)
    writers.delimited(found.assigned, f"{out}/assignments", header=True)
    writers.delimited(found.pairs, f"{out}/pairs", header=True, by=["qry_name"])
    writers.delimited(found.bundles, f"{out}/bundles", header=True, by=["qry_name"])


def mask(spark: SparkSession, args: argparse.Namespace, parser: argparse.ArgumentParser) -> None:
    """Masks what carries none of the labels (or, inverted, what carries one)."""
    seqs, iv = _read(spark, _samples(args, parser))
    s = replace(Settings(), labels=tuple(args.label or Settings.labels), padding=args.padding, merge_gap=args.merge_gap)
    hidden = pipeline.masked_intervals(seqs, iv, s)
    if args.invert:
        hidden = intervals.complement(hidden, pipeline.lengths(seqs), pipeline.KEY)
    masked = pipeline.mask(seqs, cut(hidden, "hidden"), args.char, args.soft)
    writers.fasta(masked.select(F.concat_ws("|", "sample", "chrom").alias("name"), "seq"), args.outdir)


def anchors(spark: SparkSession, args: argparse.Namespace, parser: argparse.ArgumentParser) -> None:
    """Anchors and repeats from a bedGraph track of one sample, with its coverage as a table."""
    s = _settings(spark, args)
    seqs = readers.fasta(spark, args.fasta).select(F.lit("s").alias("sample"), F.col("name").alias("chrom"), "seq")
    if args.first_only:
        first = readers.fasta_lengths(spark, args.fasta, first_only=True).select(F.col("name").alias("chrom"))
        seqs = seqs.join(first, "chrom", "left_semi").select("sample", "chrom", "seq")
    seqs = cut(seqs, "sequences")
    track = readers.bedgraph(spark, args.bedgraph).select(F.lit("s").alias("sample"), "chrom", "start", "end", "value")
    hidden = spark.createDataFrame([], "sample string, chrom string, start long, end long")
    if args.bed:
        iv = readers.bed(spark, args.bed).select(F.lit("s").alias("sample"), "chrom", "start", "end", "name")
        hidden = cut(pipeline.masked_intervals(seqs, iv, s), "hidden")
    smooth = pipeline.smoothed(track, seqs, hidden, s)
    found, high = pipeline.anchors_in(smooth, hidden, pipeline.lengths(seqs), s)
    bed = lambda df, name: df.select("chrom", "start", "end", name, "score", F.lit("+").alias("strand"))
    writers.delimited(bed(found, "anchor_id"), f"{args.outdir}/anchors")
    writers.delimited(bed(high, "name"), f"{args.outdir}/repeats")
    writers.coverage(smooth, f"{args.outdir}/coverage", ["chrom"])


def unique(spark: SparkSession, args: argparse.Namespace, parser: argparse.ArgumentParser) -> None:
    """The share of rare k-mers of each anchor sequence, counted over the whole sequences."""
    own = readers.fasta(spark, args.anchors).select(F.col("name").alias("anchor_id"), "seq")
    whole = readers.fasta(spark, args.fasta).select("name", "seq")
    rare = kmers.limited(kmers.count(whole, args.k), args.max_count)
    writers.metrics(kmers.unique_fraction(own, rare, ["anchor_id"], args.k), args.outdir)


def keep(spark: SparkSession, args: argparse.Namespace, parser: argparse.ArgumentParser) -> None:
    """Anchors whose metric is a number (and at least ``--least``), as BED, FASTA and a list of ids."""
    metric = readers.metrics(spark, args.metrics)
    bed = kmers.keep_ids(readers.bed(spark, args.bed).withColumnRenamed("name", "anchor_id"), metric, "anchor_id", "fraction", args.least)
    seqs = kmers.keep_ids(readers.fasta_dictionary(spark, args.fasta).withColumnRenamed("name", "anchor_id"), metric, "anchor_id", "fraction", args.least)
    bed = cut(kmers.check_ids(bed, seqs, "anchor_id", args.id_mismatch), "kept")
    writers.delimited(bed.select("chrom", "start", "end", "anchor_id", "score", "strand"), f"{args.outdir}/bed")
    writers.fasta(seqs.select(F.col("anchor_id").alias("name"), "seq"), f"{args.outdir}/fasta")
    writers.ids(bed, f"{args.outdir}/ids", "anchor_id")


def correspond(spark: SparkSession, args: argparse.Namespace, parser: argparse.ArgumentParser) -> None:
    """Dictionary, assignments, pairs and bundles from anchors (BED) and their sequences; the first sample is the reference."""
    s, samples = _settings(spark, args), _samples(args, parser)
    from corrspark.operators import sketch

    rows = None
    for name, fasta, bed in samples:
        seqs = readers.fasta_dictionary(spark, fasta, upper=True).withColumnRenamed("name", "anchor_id")
        iv = kmers.check_ids(readers.bed(spark, bed).withColumnRenamed("name", "anchor_id"), seqs, "anchor_id", args.id_mismatch)
        own = iv.join(sketch.minhash_groups(seqs, ["anchor_id"], s.group_k), "anchor_id", "left")
        own = own.select(F.lit(name).alias("sample"), "chrom", "anchor_id", ((F.col("start") + F.col("end")) / 2.0).alias("center"), "end", F.coalesce("group_id", F.lit("")).alias("gid"))
        rows = own if rows is None else rows.unionByName(own)
    _write_found(pipeline.correspond(cut(rows, "grouped"), samples[0][0], s), args.outdir)


def _contigs(spark: SparkSession, path: str) -> DataFrame:
    return readers.fasta(spark, path).select(F.col("name").alias("contig"), F.length("seq").cast("long").alias("length"), "seq")


def bundles_to_paf(spark: SparkSession, args: argparse.Namespace, parser: argparse.ArgumentParser) -> None:
    """Records of bundles by aligning their segments; without an aligner of one's own, segments of one length only."""
    table = readers.bundles(spark, args.bundles).withColumn("_i", F.monotonically_increasing_id())
    column = lambda name, other: F.coalesce(F.nullif(F.col(name), F.lit("")), other) if name in table.columns else other
    rows = table.select(column("bundle_id", F.format_string("BUND%06d", F.col("_i") + 1)).alias("bundle_id"), column("ref_name", F.lit("ref")).alias("ref_name"), column("qry_name", F.lit("qry")).alias("qry_name"), column("ref_chrom", F.col("chrom")).alias("ref_chrom"), column("qry_chrom", F.col("chrom")).alias("qry_chrom"), "strand", "ref_start", "ref_end", "qry_start", "qry_end")
    out = assembly.bundle_records(rows, None, _contigs(spark, args.ref), _contigs(spark, args.qry), args.flank, args.max_bundle, args.keep_failed, args.prefix, records.identity_cigar, args.ref_contig, args.qry_contig)
    writers.paf(out, args.outdir)


def patch_gaps(spark: SparkSession, args: argparse.Namespace, parser: argparse.ArgumentParser) -> None:
    """The records with patches for the gaps between them."""
    rows = cut(readers.paf(spark, args.paf), "records")
    align = {} if args.by_length else {"align": records.identity_cigar, "ref_contigs": _contigs(spark, args.ref), "qry_contigs": _contigs(spark, args.qry)}
    out = assembly.patch_gaps(rows.withColumn("place", F.monotonically_increasing_id()), args.flank, args.keep_overlap, args.max_gap, args.tolerance, split=args.split, least_split=args.least_split, keep_failed=args.keep_failed, **align)
    writers.paf(out.orderBy("source", "number", "half"), args.outdir)


def families_to_paf(spark: SparkSession, args: argparse.Namespace, parser: argparse.ArgumentParser) -> None:
    """Records of a family table, in a folder for each pair of samples."""
    wide = readers.families(spark, args.families)
    pairs = families.sample_pairs(families.samples(wide), args.pairs)
    writers.paf(families.family_records(wide, args.half, pairs), args.outdir, by=["path_name"])


def split(spark: SparkSession, args: argparse.Namespace, parser: argparse.ArgumentParser) -> None:
    """Sequences in two folders, long and short."""
    seqs = readers.fasta(spark, args.fasta).withColumn("length", F.length("seq"))
    for name, part in zip(("long", "short"), intervals.split_by_length(seqs, "length", args.least), strict=True):
        writers.fasta(part.select("name", "seq"), f"{args.outdir}/{name}")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="corrspark", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, action) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=action.__doc__.split(".")[0], description=action.__doc__)
        p.add_argument("--outdir", required=True)
        p.set_defaults(action=action)
        return p

    def with_samples(p: argparse.ArgumentParser) -> None:
        p.add_argument("--fasta", action="append", required=True, help="sequences, one file for each sample; the first is the reference")
        p.add_argument("--bed", action="append", required=True, help="intervals, in the order of the sequences")
        p.add_argument("--names", help="sample names, joined by commas")

    def with_records(p: argparse.ArgumentParser, flank: int) -> None:
        p.add_argument("--flank", type=int, default=flank)
        p.add_argument("--keep-failed", action="store_true", help="also write what could not be aligned, with its code")

    whole = command("run", run)
    with_samples(whole), _add_settings(whole), with_records(whole, 0)
    whole.add_argument("--max-bundle", type=int, default=100_000_000)
    p = command("mask", mask)
    with_samples(p)
    p.add_argument("--label", action="append")
    p.add_argument("--padding", type=int, default=0)
    p.add_argument("--merge-gap", type=int, default=0)
    p.add_argument("--char", default="n")
    p.add_argument("--soft", action="store_true")
    p.add_argument("--invert", action="store_true")
    p = command("anchors", anchors)
    p.add_argument("--bedgraph", required=True)
    p.add_argument("--fasta", required=True)
    p.add_argument("--bed", help="label intervals; all else is masked")
    p.add_argument("--first-only", action="store_true", help="the first record of the sequences alone")
    _add_settings(p)
    p = command("unique", unique)
    p.add_argument("--anchors", required=True)
    p.add_argument("--fasta", required=True)
    p.add_argument("-k", type=int, default=Settings.unique_k)
    p.add_argument("--max-count", type=int, default=Settings.max_count)
    p = command("filter", keep)
    p.add_argument("--bed", required=True)
    p.add_argument("--fasta", required=True)
    p.add_argument("--metrics", required=True)
    p.add_argument("--least", type=float)
    p.add_argument("--id-mismatch", choices=("error", "warn", "off"), default="error")
    p = command("correspond", correspond)
    with_samples(p), _add_settings(p)
    p.add_argument("--id-mismatch", choices=("error", "warn", "off"), default="error")
    p = command("bundles-to-paf", bundles_to_paf)
    with_records(p, 0)
    p.add_argument("--bundles", required=True)
    p.add_argument("--ref", required=True)
    p.add_argument("--qry", required=True)
    p.add_argument("--max-bundle", type=int, default=3_000_000)
    p.add_argument("--prefix", action="store_true", help="names as sample:contig")
    p.add_argument("--ref-contig")
    p.add_argument("--qry-contig")
    p = command("patch-gaps", patch_gaps)
    with_records(p, 10_000)
    p.add_argument("--paf", required=True)
    p.add_argument("--ref")
    p.add_argument("--qry")
    p.add_argument("--by-length", action="store_true", help="align by lengths alone, without sequences")
    p.add_argument("--keep-overlap", type=int, default=200)
    p.add_argument("--max-gap", type=int, default=70_000)
    p.add_argument("--tolerance", type=int, default=500)
    p.add_argument("--split", action="store_true", help="cut what is one insertion between matches in two")
    p.add_argument("--least-split", type=int, default=500)
    p = command("families-to-paf", families_to_paf)
    p.add_argument("--families", required=True)
    p.add_argument("--half", type=int, default=50)
    p.add_argument("--pairs", help="reference:target, joined by commas")
    p = command("split", split)
    p.add_argument("--fasta", required=True)
    p.add_argument("--least", type=int, required=True)

    args = parser.parse_args(argv)
    args.action(get_session(), args, parser)


if __name__ == "__main__":
    main()
