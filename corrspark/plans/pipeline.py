"""The whole workflow over tables: masking, anchors, groups, correspondence, records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrspark.functions import sequence
from corrspark.functions.labels import matches_label
from corrspark.operators import assembly, chaining, context, intervals, kmers, matching, signal, sketch, uniqueness
from corrspark.session import cut

KEY = ["sample", "chrom"]


@dataclass(frozen=True)
class Settings:
    """Lengths are in bases. ``gap_bin``: size of a gap bin; ``distance``: edits allowed between contexts (0: exact only).

    ``radius``: None takes it from ``window``. ``target``: unique substrings apart that a reference context must have. ``windows``: around
    bundles, for the last pass.
    """

    labels: tuple[str, ...] = ("hsat2",)
    padding: int = 0
    merge_gap: int = 0
    frequency_k: int = 6
    window: int = 50
    percent: float = 30.0
    radius: int | None = None
    span_factor: float = 1.2
    max_expand: int | None = None
    half_span: int | None = None
    min_anchor: int = 20
    score_scale: float = 100.0
    unique_k: int = 31
    max_count: int = 5
    group_k: int = 31
    gap_bin: float = 50.0
    contexts: tuple[int, ...] = (1, 2, 3, 4, 5)
    longest_unique: int = 50
    distance: int = 0
    min_links: int = 5
    gap: float = 5_000.0
    slope: tuple[float, float] = (0.99, 1.01)
    min_span: float = 1_000.0
    target: int = 1
    refine: bool = True
    windows: tuple[float, ...] = (10_000.0, 20_000.0, 50_000.0, 100_000.0)
    parallel_slope: float = 0.08
    merge: bool = True
    merge_slope: float = 0.06
    merge_ref_gap: float = 50_000.0
    merge_qry_gap: float = 50_000.0
    merge_b0: float = 5_000.0
    merge_near: bool = True


def lengths(seqs: DataFrame) -> DataFrame:
    return seqs.select(*KEY, F.length("seq").cast("long").alias("length"))


def masked_intervals(seqs: DataFrame, labelled: DataFrame, s: Settings) -> DataFrame:
    """What carries none of the labels. A contig without any of them is masked as a whole."""
    size = lengths(seqs)
    wanted = intervals.pad(labelled.where(matches_label(F.col("name"), list(s.labels))), size, KEY, s.padding)
    return intervals.complement(intervals.merge(wanted, KEY, s.merge_gap), size, KEY)


def mask(seqs: DataFrame, hidden: DataFrame, char: str = "n", soft: bool = False) -> DataFrame:
    per = hidden.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_iv"))
    joined = seqs.join(per, KEY, "left")
    return joined.withColumn("seq", F.when(F.col("_iv").isNull(), F.col("seq")).otherwise(sequence.mask(F.col("seq"), F.col("_iv"), char, soft))).drop("_iv")


def smoothed(track: DataFrame, seqs: DataFrame, hidden: DataFrame, s: Settings) -> DataFrame:
    """sample, chrom, pos, value, sm, masked of each position; track: sample, chrom, start, end, value. Written, as thresholds, minima and runs read it."""
    dense = signal.densify(track, lengths(seqs), KEY)
    inside = signal.spread_ranges(hidden.where("end > start"), KEY).distinct().withColumn("masked", F.lit(True))
    smooth = signal.moving_average(dense, KEY, s.window).join(inside, [*KEY, "pos"], "left").withColumn("masked", F.coalesce("masked", F.lit(False)))
    return cut(signal.mask_override(smooth, KEY), "smoothed")


def anchors_in(smooth: DataFrame, hidden: DataFrame, sizes: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Anchors in the valleys of a smoothed signal, and the runs above the threshold."""
    radius = signal.radius(s.window, s.radius)
    limits = signal.percentile_threshold(smooth, KEY, s.percent)
    valleys = signal.suppress(signal.local_minima(smooth, limits, KEY, radius), KEY, radius)
    if s.half_span is None:
        spans = signal.valley_spans(valleys, signal.low_islands(smooth, limits, KEY, s.span_factor), KEY, s.max_expand)
    else:
        spans = signal.apart(signal.fixed_spans(valleys, sizes, KEY, s.half_span), KEY)
    clear = intervals.overlapping(spans, hidden, KEY, keep=False)
    return signal.anchors(clear, KEY, s.score_scale, s.min_anchor), signal.high_runs(smooth, limits, KEY, 5, s.score_scale)


def find_anchors(seqs: DataFrame, hidden: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Anchors in the valleys of the k-mer frequency, and the runs above the threshold."""
    track = kmers.frequency_track(seqs, KEY, s.frequency_k).select(*KEY, F.col("pos").cast("long").alias("pos"), F.col("n").cast("double").alias("value"))
    runs = track.select(*KEY, F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "value")
    return anchors_in(smoothed(runs, seqs, hidden, s), hidden, lengths(seqs), s)


def with_sequences(anchors: DataFrame, seqs: DataFrame) -> DataFrame:
    return anchors.join(seqs, KEY).withColumn("seq", sequence.fetch(F.col("seq"), F.col("start"), F.col("end")))


def grouped_anchors(anchors: DataFrame, seqs: DataFrame, s: Settings) -> DataFrame:
    """sample, chrom, anchor_id, center, gid of the anchors with k-mers of which some fraction is rare."""
    own = with_sequences(anchors, seqs)
    rare = kmers.limited(kmers.count(seqs, s.unique_k), s.max_count)
    metric = kmers.unique_fraction(own, rare, [*KEY, "anchor_id"], s.unique_k)
    valid = own.join(metric.where("fraction is not null").select(*KEY, "anchor_id"), [*KEY, "anchor_id"], "left_semi")
    groups = sketch.minhash_groups(valid, [*KEY, "anchor_id"], s.group_k)
    return valid.join(groups, [*KEY, "anchor_id"]).select(*KEY, "anchor_id", ((F.col("start") + F.col("end")) / 2.0).alias("center"), "end", F.col("group_id").alias("gid"))


@dataclass(frozen=True)
class Correspondence:
    """The reference's dictionary, assignments of the first pass, pairs of each pass, bundles of all samples, and the links of each bundle."""

    dictionary: DataFrame
    assigned: DataFrame
    pairs: DataFrame
    bundles: DataFrame
    links: DataFrame


def _links(pairs: DataFrame, query: DataFrame, ref: DataFrame, sizes: DataFrame) -> DataFrame:
    """qry_name, chrom, strand, ref_center, qry_center (along the strand), rid, qid, size: each pair's link on both strands.

    Pairs without a finite center on either side make none. The contig is the reference's, else the query's; the query's length is that of
    its contig of the same name, else its greatest center.
    """
    c = F.col
    finite = lambda x: c(x).isNotNull() & ~F.isnan(x) & (F.abs(c(x)) < float("inf"))
    q = query.select("qry_name", c("anchor_id").alias("qid"), c("chrom").alias("_q_chrom"), c("center").cast("double").alias("qry_center")).where(finite("qry_center"))
    r = ref.select(c("anchor_id").alias("rid"), c("chrom").alias("_r_chrom"), c("center").cast("double").alias("ref_center")).where(finite("ref_center"))
    items = pairs.select("qry_name", "qid", "rid").distinct().join(q, ["qry_name", "qid"]).join(r, "rid").withColumn("chrom", F.coalesce(F.nullif("_r_chrom", F.lit("")), "_q_chrom")).drop("_r_chrom", "_q_chrom")
    greatest = items.groupBy("qry_name", "chrom").agg(F.ceil(F.max("qry_center")).cast("long").alias("_greatest"))
    sized = items.join(sizes, ["qry_name", "chrom"], "left").join(greatest, ["qry_name", "chrom"]).withColumn("size", F.coalesce("size", "_greatest")).drop("_greatest")
    return chaining.both_strands(sized, "size")


def correspond(anchors: DataFrame, reference: str, s: Settings) -> Correspondence:
    """What anchors of all other samples correspond to in the reference's. anchor ids are made unique by sample and contig.

    anchors: sample, chrom, anchor_id, center, gid, and end where known. Three passes find pairs: by context; in the gaps between
    bundles; around bundles, kept where they lie parallel to one. Bundles of all pairs close the work.
    """
    c = F.col
    named = anchors.withColumn("anchor_id", F.concat_ws("|", c("sample").cast("string"), "chrom", "anchor_id"))
    ks = list(s.contexts)
    ordered = context.order(named, s.gap_bin)
    signed = cut(context.signatures(ordered, max(ks)), "signatures")
    is_ref = c("sample") == reference
    own = ordered.where(is_ref)
    known = cut(uniqueness.dictionary(uniqueness.least_context(own, uniqueness.minimal_unique(context.tokens(own), s.longest_unique), max(ks), s.longest_unique, s.target)), "dictionary")
    ref = cut(signed.where(is_ref).join(known.select(*KEY, "anchor_id", "k_min"), [*KEY, "anchor_id"]), "reference")
    query = signed.where(~is_ref).withColumn("qry_name", c("sample").cast("string"))
    end = "end" if "end" in anchors.columns else "center"
    sizes = named.where(~is_ref).groupBy(c("sample").cast("string").alias("qry_name"), "chrom").agg(F.ceil(F.max(end)).cast("long").alias("size"))

    index = matching.unique_index(ref, ks)
    near = [matching.near_hits(query, ref, ks, s.distance, i) for i in (False, True)] if s.distance else [None, None]
    choices = matching.arbitrate(matching.exact_hits(query, index, ks), matching.exact_hits(query, index, ks, invert=True), *near)
    choices = cut(choices.join(query.select(c("anchor_id").alias("qid"), "qry_name"), "qid"), "choices")
    assigned = cut(matching.assign(query, choices, ks, by=("qry_name",)).join(query.select(c("anchor_id").alias("qid"), "qry_name"), "qid"), "assigned")
    pairs = cut(assigned.where("status = 'assign'").select("qry_name", "qid", "rid", F.lit(1).alias("found_in")), "pairs")
    by = ["qry_name", "chrom", "strand"]
    chain = {"gap_ref": s.gap, "gap_qry": s.gap, "slope": s.slope}

    def bundled(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        links = cut(_links(found, query, ref, sizes), "links")
        chained = cut(chaining.chain(links, by, **chain), "chained")
        return links, chained, cut(chaining.bundle_stats(chained, by, s.min_links, s.min_span), "bundles")

    if s.refine:
        along = chaining.both_strands(query.join(sizes, ["qry_name", "chrom"]).withColumn("qry_center", c("center").cast("double")), "size").drop("center").withColumnRenamed("qry_center", "center")
        open_ = cut(along.join(pairs.select(c("qid").alias("anchor_id")), "anchor_id", "left_anti"), "open")
        _, _, first = bundled(pairs)
        for strand in ("+", "-"):
            side = c("strand") == strand
            more = matching.refine_gaps(open_.where(side).drop("strand"), ref, first.where(side), pairs.where("found_in = 1").select("qry_name", "rid"), ks, strand == "-", s.distance, ("qry_name", "chrom"))
            pairs = pairs.unionByName(more.select("qry_name", "qid", "rid", F.lit(2).alias("found_in")))
        pairs = cut(pairs.groupBy("qry_name", "qid", "rid").agg(F.min("found_in").alias("found_in")), "pairs")
        links, _, second = bundled(pairs)
        left = open_.join(pairs.select(c("qid").alias("anchor_id")), "anchor_id", "left_anti")
        more = matching.refine_around(left, ref, second, links, pairs.select("qry_name", "rid"), list(s.windows), ks, chain, (s.min_links, s.min_span), s.parallel_slope, bound=s.distance, by=("qry_name", "chrom"))
        pairs = cut(pairs.unionByName(more.select("qry_name", "qid", "rid", F.lit(3).alias("found_in"))).groupBy("qry_name", "qid", "rid").agg(F.min("found_in").alias("found_in")), "pairs")

    links, _, stats = bundled(pairs)
    size = links.groupBy("qry_name", "chrom").agg(F.max("size").alias("size"))
    bundles = chaining.raw_bundles(stats.join(size, ["qry_name", "chrom"]), "size").drop("size")
    if s.merge:
        bundles = chaining.merge_parallel(bundles, ["qry_name", "chrom"], s.merge_slope, s.merge_ref_gap, s.merge_qry_gap, s.merge_b0, s.merge_near)
    bundles = cut(bundles, "merged")
    emitted = chaining.emit(bundles, ["qry_name"])
    owned = chaining.emit(bundles, ["qry_name"], ids=True).select("qry_name", "chrom", "bundle_id", "strand", F.explode(F.arrays_zip("rids", "qids")).alias("_p"))
    centers = links.where("strand = '+'").select("qry_name", "chrom", "rid", "qid", "ref_center", "qry_center")
    in_bundles = owned.select("qry_name", "chrom", "bundle_id", "strand", "_p.rids", "_p.qids").withColumnsRenamed({"rids": "rid", "qids": "qid"}).join(centers, ["qry_name", "chrom", "rid", "qid"])
    return Correspondence(known, assigned, pairs, emitted, in_bundles)


def records_of(found: Correspondence, sizes: DataFrame, reference: str, flank: int = 0, max_bundle: int = 100_000_000, keep_failed: bool = False, prefix: bool = False) -> DataFrame:
    """Records of all bundles by their links, with qry_name; sizes: sample, chrom, length."""
    c = F.col
    key = F.concat_ws("|", "qry_name", "bundle_id")
    bundles = found.bundles.select(key.alias("bundle_id"), F.lit(reference).alias("ref_name"), "qry_name", F.concat_ws("|", F.lit(reference), "chrom").alias("ref_chrom"), F.concat_ws("|", "qry_name", "chrom").alias("qry_chrom"), "strand", "ref_start", "ref_end", "qry_start", "qry_end")
    links = found.links.select(key.alias("bundle_id"), "strand", "ref_center", "qry_center")
    contigs = sizes.select(F.concat_ws("|", c("sample").cast("string"), "chrom").alias("contig"), c("length").cast("long").alias("length"))
    return assembly.bundle_records(bundles, links, contigs, contigs, flank, max_bundle, keep_failed, prefix)
