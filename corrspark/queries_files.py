"""Registered queries that write the test tables in the text formats, to the shared folder, and read them again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrspark.functions import coords, text
from corrspark.functions.labels import matches_label
from corrspark.operators import chaining, intervals, kmers, matching, signal
from corrspark.plans import substrates as sub
from corrspark.queries import CHAIN, IV, LOW, MINK, PAF, SEQ, SIGN, _bundles, _chained, _contexts, _minima, merged_sql, query
from corrspark.session import shared_dir
from corrspark.sources import readers, writers
from corrspark.streaming import ingest


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _written(df: DataFrame, name: str, **options) -> str:
    path = _path(df.sparkSession, name)
    writers.delimited(df, path, **options)
    return path


# --- sequences -----------------------------------------------------------------------------------------------------


@query(f"with {SEQ} select name::varchar as name, md5(seq) as md5, length(seq)::bigint as length from seqs where length(seq) > 0")
def fasta_round_trip(spark, sf_dir):
    path = _path(spark, "fasta")
    writers.fasta(sub.sequences(spark, sf_dir).where("length(seq) > 0").select(F.col("name").cast("string"), F.lower("seq").alias("seq")), path, compress=True)
    lengths = readers.fasta_lengths(spark, path).select("name", "length")
    return readers.fasta(spark, path).select("name", F.md5("seq").alias("md5")).join(lengths, "name")


@query(f"with {SEQ} select chrom, count(*) as n, sum(length(seq))::bigint as bases from (select 'c' || (name % 7) as chrom, lower(seq) as seq from seqs where length(seq) > 0) where contains(seq, 'acgtac') group by chrom")
def fasta_case_kept(spark, sf_dir):
    path = _path(spark, "fasta")
    rows = sub.sequences(spark, sf_dir).where("length(seq) > 0").select(F.concat(F.lit("c"), (F.col("name") % 7).cast("string"), F.lit(" doc "), F.col("name").cast("string")).alias("name"), F.lower("seq").alias("seq"))
    writers.fasta(rows, path)
    kept = readers.fasta(spark, path, upper=False).where(F.col("seq").contains("acgtac"))
    return kept.groupBy(F.col("name").alias("chrom")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("seq")).cast("long").alias("bases"))


@query(f"with {SEQ} select name::varchar as name, length(seq)::bigint as length from seqs")
def fai_round_trip(spark, sf_dir):
    seqs = sub.sequences(spark, sf_dir)
    return readers.fai(spark, _written(seqs.select("name", F.length("seq"), F.lit(0), F.lit(60), F.lit(61)), "fai"))


# --- intervals and tracks ------------------------------------------------------------------------------------------


@query(f"with {IV} select chrom, name, count(*) as n, sum((s + e) / 2.0) as centers from iv where chrom = 'c3' and not contains(lower(name), 'eco') group by chrom, name")
def bed_contig_label_centers(spark, sf_dir):
    iv = sub.intervals(spark, sf_dir)
    bed = readers.bed(spark, _written(iv.select("chrom", "start", "end", "name", F.lit("0"), F.lit("+")), "bed"), strict=True)
    own = bed.where((F.col("chrom") == "c3") & matches_label(F.col("name"), ["eco"], invert=True))
    return own.groupBy("chrom", "name").agg(F.count(F.lit(1)).alias("n"), F.sum(coords.center(F.col("start"), F.col("end"))).alias("centers"))


@query(f"with {IV}, eco as (select * from iv where contains(lower(name), 'eco')), {merged_sql('eco', 'm')} select chrom, s as start, least(e, 4000) as \"end\", 1.0::double as \"value\" from m union all select chrom, s, e, 0.0 from (select chrom, coalesce(lag(e) over (partition by chrom order by s), 0) as s, s as e from m union all select chrom, max(e), 4000 from m group by chrom) t where e > s")
def bedgraph_flag_track(spark, sf_dir):
    iv = sub.intervals(spark, sf_dir)
    runs = intervals.flag_runs(iv.where(matches_label(F.col("name"), ["eco"])), sub.lengths(iv), ["chrom"])
    return readers.bedgraph(spark, _written(runs.select("chrom", "start", "end", "flag"), "bedgraph", compress=True))


@query(f"with {IV} select chrom, name, count(*) as n, sum(e - s)::bigint as bases from iv group by chrom, name")
def label_totals(spark, sf_dir):
    return ingest.label_totals(sub.intervals(spark, sf_dir))


@query(f"with {LOW}, lens as (select distinct chrom from sm), spans as (select chrom, pos, sm, greatest(pos - 6, 0) as s, least(pos + 7, 4000) as e from sm where not masked and pos % 500 = 20) select chrom, s as start, e as \"end\", pos, round(sm, 9) as sm from spans")
def fixed_width_spans(spark, sf_dir):
    sig, _, _ = _minima(spark, sf_dir)
    some = sig.where("not masked and pos % 500 = 20").select("chrom", "pos", "sm")
    return signal.fixed_spans(some, sub.lengths(sig), ["chrom"], 6).select("chrom", "start", "end", "pos", F.round("sm", 9).alias("sm"))


@query("with sig as (select l_returnflag as chrom, datediff('day', date '1992-01-01', cast(l_shipdate as date))::bigint as pos, count(*) as v from lineitem group by 1, 2), sm as (select *, sum(v) over w / count(v) over w as sm from sig window w as (partition by chrom order by pos rows between 25 preceding and 25 following)) select chrom, pos + 1 as pos1, printf('%.6f', v::double) as coverage_raw, substr(printf('%.9f', sm), 1, 5) as coverage_smooth from sm")
def coverage_table(spark, sf_dir):
    smooth = signal.moving_average(sub.signal(spark, sf_dir), ["chrom"], 50)
    path = _path(spark, "coverage")
    writers.coverage(smooth, path, ["chrom"])
    rows = readers.table(spark, path, ["pos1", "coverage_raw", "coverage_smooth"])
    return rows.select("chrom", F.col("pos1").cast("long").alias("pos1"), "coverage_raw", F.substring("coverage_smooth", 1, 5).alias("coverage_smooth"))


# --- tables of anchors ---------------------------------------------------------------------------------------------


@query("select doc_id::varchar as anchor_id, round(case when n_chars % 5 = 0 then null else n_chars / 7.0 end, 6)::double as fraction, n_chars::bigint as n_unique, (n_chars * 2)::bigint as n_kmers from documents")
def metrics_round_trip(spark, sf_dir):
    docs = sub.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("anchor_id"), F.when(F.col("n_chars") % 5 != 0, F.col("n_chars") / 7.0).cast("double").alias("fraction"), F.col("n_chars").cast("long").alias("n_unique"), (F.col("n_chars") * 2).cast("long").alias("n_kmers"))
    path = _path(spark, "metrics")
    writers.metrics(docs, path)
    return readers.metrics(spark, path)


@query("select doc_id, lang from documents where n_chars % 5 <> 0 and round(n_chars / 7.0, 6) >= 200 and doc_id in (select doc_id from documents)")
def metrics_file_filter(spark, sf_dir):
    docs = sub.table(spark, sf_dir, "documents")
    path = _path(spark, "metrics")
    writers.metrics(docs.select(F.col("doc_id").alias("anchor_id"), F.when(F.col("n_chars") % 5 != 0, F.col("n_chars") / 7.0).alias("fraction"), F.lit(1).alias("n_unique"), F.lit(1).alias("n_kmers")), path)
    kept = kmers.keep_ids(docs.withColumn("anchor_id", F.col("doc_id").cast("string")), readers.metrics(spark, path), "anchor_id", "fraction", 200.0)
    return kmers.check_ids(kept, docs.select(F.col("doc_id").cast("string").alias("anchor_id")), "anchor_id", "error").select("doc_id", "lang")


@query("select doc_id::varchar as anchor_id, (n_chars % 9)::bigint as n_unique, 9::bigint as n_kmers, (n_chars % 9) / 9.0::double as fraction from documents")
def kmer_existence_file(spark, sf_dir):
    docs = sub.table(spark, sf_dir, "documents")
    n = (F.col("n_chars") % 9).cast("int")
    return readers.kmer_existence(spark, _written(docs.select("doc_id", F.lit(9), F.lit(4), n), "existence"))


@query("select distinct doc_id::varchar as id from documents where n_chars > 500")
def id_list_round_trip(spark, sf_dir):
    path = _path(spark, "ids")
    writers.ids(sub.table(spark, sf_dir, "documents").where("n_chars > 500"), path, "doc_id")
    return spark.read.text(path).withColumnRenamed("value", "id")


@query("select c_name as label, 'VS:' || lpad((c_nationkey)::varchar, 6, '0') as group_id from customer")
def cluster_file(spark, sf_dir):
    c = sub.table(spark, sf_dir, "customer")
    star = F.lit("*")
    return readers.clusters(spark, _written(c.select(F.lit("H"), "c_nationkey", F.lit(9), F.lit(99).alias("p"), F.lit("+"), F.lit(0), F.lit(0).alias("_"), star.alias("s"), "c_name", star.alias("t")), "uc"))


@query("select 'o' || o_orderkey as qseqid, 'c' || o_custkey as sseqid, (o_orderkey % 100)::double as pident, (o_custkey % 77)::bigint as length, (o_orderkey % 7)::bigint as mismatch from orders")
def hit_table_file(spark, sf_dir):
    o = sub.table(spark, sf_dir, "orders")
    rows = o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("s"), (F.col("o_orderkey") % 100).alias("p"), (F.col("o_custkey") % 77).alias("l"), (F.col("o_orderkey") % 7).alias("m"))
    return readers.blast6(spark, _written(rows, "hits")).select("qseqid", "sseqid", "pident", "length", "mismatch")


@query("select d.doc_id::varchar as anchor_id, 's' as sample, d.lang as group_id, case when l.doc_id is null then '' else 'q' || quality end as chrom, case when l.doc_id is null then 'nan'::double else toxic + 5.0 end as center, case when l.doc_id is null then '' else '+' end as strand, case when n_chars % 3 = 0 then 0 else length(text) end::int as len from documents d left join labels l using (doc_id) where text is not null")
def anchor_table_defaults(spark, sf_dir):
    docs = sub.table(spark, sf_dir, "documents").where("text is not null").select(F.lit("s").alias("sample"), F.col("doc_id").cast("string").alias("anchor_id"), F.col("lang").alias("group_id"), F.col("text").alias("seq"), "n_chars")
    labels = sub.table(spark, sf_dir, "labels").select(F.lit("s").alias("sample"), F.col("doc_id").cast("string").alias("anchor_id"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("chrom"), F.col("toxic").cast("long").alias("start"), (F.col("toxic") + 10).cast("long").alias("end"), F.lit("+").alias("strand"))
    return kmers.anchor_table(docs.select("sample", "anchor_id", "group_id"), labels, docs.where("n_chars % 3 <> 0"))


# --- records and bundles -------------------------------------------------------------------------------------------


@query(f"with {PAF} select qname, strand, tname, count(*) as n, sum(qstart)::bigint as qstart, sum(tend)::bigint as tend, sum(nmatch)::bigint as nmatch, sum(mapq)::bigint as mapq, sum(l_orderkey)::bigint as ids from paf group by qname, strand, tname")
def paf_round_trip(spark, sf_dir):
    path = _path(spark, "paf")
    writers.paf(sub.records(spark, sf_dir).withColumn("tags", F.array(F.lit("tp:A:P"), F.concat(F.lit("id:Z:"), F.col("l_orderkey").cast("string")))), path)
    rows = readers.paf(spark, path).withColumn("id", readers.tag_map(F.col("tags"))["id:Z"].cast("long"))
    return rows.groupBy("qname", "strand", "tname").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).cast("long").alias(c) for c in ("qstart", "tend", "nmatch", "mapq")], F.sum("id").alias("ids"))


@query(
    f"""with {CHAIN}, kp as (select st.chrom, chain, o.r, o.q, rid from st join o on o.chrom = st.chrom and o.i = st.i where kept), s as (select chrom, chain, min(r) as r0, max(r) as r1, min(q) as q0, max(q) as q1, count(*) as n, string_agg(rid::varchar, ',' order by r, q, rid) as rids from kp group by chrom, chain having count(*) >= 5)
 select chrom::varchar as chrom, 'B' || lpad((row_number() over (partition by chrom order by r0, chain))::varchar, 6, '0') as bundle_id, round_even(r0, 0)::bigint as ref_start, round_even(r1, 0)::bigint as ref_end, round_even(q0, 0)::bigint as qry_start, round_even(q1, 0)::bigint as qry_end, '+' as strand, n::varchar as n_links, rids as ref_anchor_ids from s"""
)
def bundle_table_round_trip(spark, sf_dir):
    emitted = chaining.emit(_bundles(spark, sf_dir), ["chrom"]).drop("ref_span", "qry_span")
    rows = readers.bundles(spark, _written(emitted, "bundles", header=True))
    return rows.select("chrom", "bundle_id", "ref_start", "ref_end", "qry_start", "qry_end", "strand", "n_links", "ref_anchor_ids")


@query(
    f"""with {CHAIN}, kp as (select st.chrom, chain, o.r, o.q, rid from st join o on o.chrom = st.chrom and o.i = st.i where kept), d as (select *, r - lag(r) over w as dr, q - lag(q) over w as dq from kp window w as (partition by chrom, chain order by r, q)),
 a as (select chrom, chain, coalesce(median(dq / dr) filter (dr > 0), 1) as slope from d group by chrom, chain), b as (select chrom, chain, median(q - slope * r) as b0 from d join a using (chrom, chain) group by chrom, chain),
 e as (select chrom, chain, q - (slope * r + b0) as res, rid, r, q from d join a using (chrom, chain) join b using (chrom, chain)), m as (select chrom, chain, median(res) as m from e group by chrom, chain)
 select chrom, chain::bigint as chain, round(median(abs(res - m)), 6) as resid_mad, string_agg(rid::varchar, ',' order by r, q, rid) as ids from e join m using (chrom, chain) group by chrom, chain"""
)
def bundle_residuals(spark, sf_dir):
    stats = chaining.bundle_stats(_chained(spark, sf_dir), ["chrom"])
    return stats.select("chrom", "chain", F.round("resid_mad", 6).alias("resid_mad"), F.array_join(F.col("rids").cast("array<string>"), ",").alias("ids"))


@query(
    f"""with {CHAIN}, kp as (select st.chrom, chain, o.r, o.q, rid from st join o on o.chrom = st.chrom and o.i = st.i where kept), d as (select *, r - lag(r) over w as dr, q - lag(q) over w as dq from kp window w as (partition by chrom, chain order by r, q)),
 a as (select chrom, chain, coalesce(median(dq / dr) filter (dr > 0), 1) as slope, max(dr) as gr, max(abs(dq)) as gq, min(r) as r0, max(r) as r1, min(q) as q0, max(q) as q1, count(*) as n, string_agg(rid::varchar, ',' order by r, q, rid) as rids from d group by chrom, chain having count(*) >= 5),
 b as (select chrom, chain, median(q - slope * r) as b0 from d join a using (chrom, chain) group by chrom, chain), z as (select a.*, b0, row_number() over (partition by chrom order by r0, chain) as i from a join b using (chrom, chain)),
 mg(chrom, i, run, first, seed, slope, b0, r0, r1, q0, q1, gr, gq, n, rids) as (select chrom, i, 1, chain, slope, slope, b0, r0, r1, q0, q1, gr, gq, n, rids from z where i = 1 union all
  select z.chrom, z.i, case when fit then m.run else m.run + 1 end, case when fit then m.first else z.chain end, case when fit then m.seed else z.slope end, case when fit then (m.slope + z.slope) / 2 else z.slope end, case when fit then m.b0 else z.b0 end,
   case when fit then least(m.r0, z.r0) else z.r0 end, case when fit then greatest(m.r1, z.r1) else z.r1 end, case when fit then least(m.q0, z.q0) else z.q0 end, case when fit then greatest(m.q1, z.q1) else z.q1 end,
   case when fit then greatest(m.gr, z.gr) else z.gr end, case when fit then greatest(m.gq, z.gq) else z.gq end, case when fit then m.n + z.n else z.n end, case when fit then m.rids || ',' || z.rids else z.rids end
  from mg m join z on z.chrom = m.chrom and z.i = m.i + 1, lateral (select abs(z.slope - m.seed) <= 0.5 and abs(z.b0 - m.b0) <= 5000 and z.r0 <= m.r1 + 600 and z.q0 <= m.q1 + 600 and m.q0 <= z.q1 + 600 as fit) t),
 e as (select * from mg qualify row_number() over (partition by chrom, run order by i desc) = 1)
 select chrom, 'B' || lpad((row_number() over (partition by chrom order by r0, first))::varchar, 6, '0') as bundle_id, round_even(r0, 0)::bigint as ref_start, round_even(r1, 0)::bigint as ref_end, round_even(q0, 0)::bigint as qry_start, round_even(q1, 0)::bigint as qry_end,
  (round_even(r1, 0) - round_even(r0, 0))::bigint as ref_span, (round_even(q1, 0) - round_even(q0, 0))::bigint as qry_span, n::bigint as n_links, round(slope, 6) as slope_med, round(b0, 6) as b0_med, gr as max_gap_ref, round(gq, 6) as max_gap_qry, rids as ref_anchor_ids from e"""
)
def merge_parallel_bundles(spark, sf_dir):
    merged = chaining.emit(chaining.merge_parallel(_bundles(spark, sf_dir), ["chrom"], 0.5, 600.0, 600.0, 5000.0), ["chrom"])
    short = [F.round(c, 6).alias(c) for c in ("slope_med", "b0_med", "max_gap_qry")]
    return merged.select("chrom", "bundle_id", "ref_start", "ref_end", "qry_start", "qry_end", "ref_span", "qry_span", "n_links", "max_gap_ref", "ref_anchor_ids", *short)


@query(
    f"""with {MINK}, {SIGN[SIGN.index('nb as'):]}, kr as (select anchor_id, coalesce(k_min, 0) as k_min from mink where sample = 0),
 ix as (select gid, k, l, r, min(c.anchor_id) as rid, min(k_min) as k_min from ctx c join kr using (anchor_id) where k_min > 0 group by gid, k, l, r having count(*) = 1)
 select q.anchor_id as qid, q.k, rid from ctx q join ix using (gid, k, l, r) where sample = 1 and q.k >= ix.k_min"""
)
def exact_match_gated(spark, sf_dir):
    from corrspark.queries import _signed

    q, r = _signed(spark, sf_dir)
    least = _contexts(spark, sf_dir).where("sample = 0").select("anchor_id", "k_min")
    return matching.exact_hits(q, matching.unique_index(r.drop("k_min").join(least, "anchor_id"), [1, 2]), [1, 2])


# --- names ---------------------------------------------------------------------------------------------------------


@query(
    """select page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1) || '.fa.gz', '(\\.fasta\\.gz|\\.fa\\.gz|\\.fna\\.gz|\\.fasta|\\.fa|\\.fna)$', '') as stem, regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') as safe,
 case when length(url) < 25 then 'short' when length(url) < 40 then 'medium' else 'long' end as size from pages where url is not null"""
)
def names_and_sizes(spark, sf_dir):
    pages = sub.table(spark, sf_dir, "pages").where("url is not null")
    return pages.select("page_id", text.stem(F.concat("url", F.lit(".fa.gz"))).alias("stem"), text.safe_name(F.col("url")).alias("safe"), text.size_class(F.length("url"), [(40, "medium"), (25, "short")], "long").alias("size"))
