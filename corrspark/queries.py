"""Registered queries of the core operators over the star-schema tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrspark.functions import cigar, coords, sequence
from corrspark.functions.labels import matches_label
from corrspark.operators import chaining, context, intervals, kmers, matching, records, signal, sketch, uniqueness
from corrspark.plans import substrates as sub
from corrspark.session import cut

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- intervals -------------------------------------------------------------------------------------------------

IV = """iv as (select 'c' || (l_suppkey % 20) as chrom, datediff('day', date '1992-01-01', cast(l_shipdate as date)) as s,
  datediff('day', date '1992-01-01', cast(l_shipdate as date)) + cast(l_quantity as bigint) as e, p_type as name, l_orderkey, l_linestatus, l_discount, l_quantity
  from lineitem join part on l_partkey = p_partkey)"""


def merged_sql(source: str, out: str, gap: int = 0) -> str:
    return f"""{out}_m as (select *, max(e) over (partition by chrom order by s, e rows between unbounded preceding and 1 preceding) pe from {source} where e > s),
 {out}_i as (select *, sum(case when pe is null or s - pe > {gap} then 1 else 0 end) over (partition by chrom order by s, e rows unbounded preceding) isl from {out}_m),
 {out} as (select chrom, min(s) as s, max(e) as e, count(*) as n from {out}_i group by chrom, isl)"""


ECO = "eco as (select * from iv where contains(lower(name), 'eco'))"
COMPLEMENT = """gaps as (select chrom, coalesce(lag(t_end) over (partition by chrom order by t_start, last), 0) as s, t_start as e from
   (select chrom, greatest(s, 0) as t_start, least(e, 4000) as t_end, 0 as last from m union all select distinct chrom, 4000, null, 1 from iv) t),
 comp as (select chrom, s, e from gaps where e > s)"""


def _eco(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sub.intervals(spark, sf_dir).where(matches_label(F.col("name"), ["eco"]))


@query(f"with {IV}, {ECO}, {merged_sql('eco', 'm')} select chrom, s as start, e as \"end\", n from m")
def interval_merge_by_label(spark, sf_dir):
    return intervals.merge(_eco(spark, sf_dir), ["chrom"])


@query(f"with {IV}, {ECO}, p as (select chrom, greatest(s - 2, 0) as s, least(e + 2, 4000) as e from eco), {merged_sql('p', 'm', 1)} select chrom, s as start, e as \"end\", n from m")
def interval_pad_merge(spark, sf_dir):
    iv = _eco(spark, sf_dir)
    return intervals.merge(intervals.pad(iv, sub.lengths(sub.intervals(spark, sf_dir)), ["chrom"], 2), ["chrom"], 1)


@query(f"with {IV}, {ECO}, {merged_sql('eco', 'm')}, {COMPLEMENT} select chrom, s as start, e as \"end\" from comp")
def interval_complement(spark, sf_dir):
    return intervals.complement(_eco(spark, sf_dir), sub.lengths(sub.intervals(spark, sf_dir)), ["chrom"])


_HIT = "exists (select 1 from m where m.chrom = x.chrom and m.s < x.e and x.s < m.e)"
_SIDES = f"""with {IV}, promo as (select * from iv where contains(lower(name), 'promo')), {merged_sql('promo', 'm')}, x as (select * from iv where not contains(lower(name), 'promo'))"""


def _sides(spark, sf_dir):
    iv = sub.intervals(spark, sf_dir)
    return iv.where(matches_label(F.col("name"), ["promo"], invert=True)), iv.where(matches_label(F.col("name"), ["promo"]))


@query(f"{_SIDES} select chrom, count(*) as n, sum(x.e - x.s)::bigint as bases from x where {_HIT} group by chrom")
def interval_overlap_semi(spark, sf_dir):
    return intervals.overlapping(*_sides(spark, sf_dir), ["chrom"]).groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("bases"))


@query(f"{_SIDES} select chrom, s as start, e as \"end\", name from x where not {_HIT}")
def interval_overlap_anti(spark, sf_dir):
    return intervals.overlapping(*_sides(spark, sf_dir), ["chrom"], keep=False).select("chrom", "start", "end", "name")


@query(f"with {IV}, {ECO}, {merged_sql('eco', 'm')}, {COMPLEMENT} select chrom, s as start, e as \"end\", 0 as flag from comp union all select chrom, s, least(e, 4000), 1 from m")
def interval_flag_runs(spark, sf_dir):
    return intervals.flag_runs(_eco(spark, sf_dir), sub.lengths(sub.intervals(spark, sf_dir)), ["chrom"])


@query(
    f"""with {IV}, {ECO}, {merged_sql('eco', 'm')}, {COMPLEMENT}, b as (select * from comp qualify row_number() over (partition by chrom order by e - s desc, s) = 1)
 select chrom, s as start, e as "end", greatest(s, (s + e) // 2 - 250) as view_start, least(e, greatest(s, (s + e) // 2 - 250) + 500) as view_end from b"""
)
def longest_unmasked_view(spark, sf_dir):
    comp = intervals.complement(_eco(spark, sf_dir), sub.lengths(sub.intervals(spark, sf_dir)), ["chrom"])
    return intervals.longest(comp, ["chrom"], 500)


@query(f"with {IV} select name, count(*) as n from iv where not contains(lower(name), 'eco') group by name")
def label_invert_filter(spark, sf_dir):
    return sub.intervals(spark, sf_dir).where(matches_label(F.col("name"), ["eco"], invert=True)).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {IV} select chrom, count(*) filter (e - s >= 25) as n_long, count(*) filter (e - s < 25) as n_short from iv group by chrom")
def length_split(spark, sf_dir):
    iv = sub.intervals(spark, sf_dir).withColumn("length", F.col("end") - F.col("start"))
    long, short = intervals.split_by_length(iv, "length", 25)
    both = long.select("chrom", F.lit(1).alias("l"), F.lit(0).alias("s")).unionByName(short.select("chrom", F.lit(0).alias("l"), F.lit(1).alias("s")))
    return both.groupBy("chrom").agg(F.sum("l").alias("n_long"), F.sum("s").alias("n_short"))


@query(f"with {IV} select chrom, w as \"window\", count(*) as n, sum(greatest(s - w, 0))::bigint as sum_start, sum(e + w)::bigint as sum_end from iv, (values (10), (20)) t(w) group by chrom, w")
def window_expand(spark, sf_dir):
    return intervals.expand(sub.intervals(spark, sf_dir), [10, 20]).groupBy("chrom", "window").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("sum_start"), F.sum("end").alias("sum_end"))


# --- sequences and k-mers ------------------------------------------------------------------------------------------

SEQ = "seqs as (select doc_id as name, translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') as seq from documents)"
RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"
KMERS = f"""{SEQ}, w as (select name, p as pos, substr(seq, p + 1, 12) as k from (select name, seq, unnest(range(0, greatest(length(seq) - 11, 0))) as p from seqs)),
 km as (select name, pos, least(k, {RC.format('k')}) as kmer from w), counts as (select kmer, count(*) as n from km group by kmer)"""


@query(f"with {SEQ} select name, md5(repeat('n', least(3, length(seq))) || substr(seq, 4, 4) || repeat('n', greatest(least(length(seq), 12) - 7, 0)) || substr(seq, 13)) as md5 from seqs")
def mask_hard(spark, sf_dir):
    iv = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 3), (7, 12))])
    return sub.sequences(spark, sf_dir).select("name", F.md5(sequence.mask(F.col("seq"), iv)).alias("md5"))


@query(f"with {SEQ} select name, md5(lower(substr(seq, 1, 3)) || substr(seq, 4)) as md5, length(replace(seq, 'N', ''))::bigint as n_bases from seqs")
def mask_soft(spark, sf_dir):
    iv = F.array(F.struct(F.lit(0).alias("start"), F.lit(3).alias("end")))
    return sub.sequences(spark, sf_dir).select("name", F.md5(sequence.mask(F.col("seq"), iv, soft=True)).alias("md5"), sequence.non_n_length(F.col("seq")).alias("n_bases"))


@query(f"with {SEQ} select name, md5({RC.format('seq')}) as md5, substr(seq, 6, 10) as part from seqs")
def reverse_complement_fetch(spark, sf_dir):
    return sub.sequences(spark, sf_dir).select("name", F.md5(sequence.reverse_complement(F.col("seq"))).alias("md5"), sequence.fetch(F.col("seq"), F.lit(5), F.lit(15)).alias("part"))


@query(f"with {KMERS} select * from counts")
def kmer_count_canonical(spark, sf_dir):
    return kmers.count(sub.sequences(spark, sf_dir), 12)


@query(f"with {KMERS} select n, count(*) as kmers from counts group by n")
def kmer_histogram(spark, sf_dir):
    return kmers.histogram(kmers.count(sub.sequences(spark, sf_dir), 12))


@query(f"with {KMERS} select kmer from counts where n <= 3")
def kmer_limited(spark, sf_dir):
    return kmers.limited(kmers.count(sub.sequences(spark, sf_dir), 12), 3).select("kmer")


_RUNS = "select name, pos, n, pos - row_number() over (partition by name, n order by pos) as g from km join counts using (kmer)"


@query(f"with {KMERS}, r as ({_RUNS}) select name, min(pos)::bigint as start, (max(pos) + 1)::bigint as \"end\", n as \"value\" from r group by name, n, g")
def kmer_frequency_track(spark, sf_dir):
    return kmers.frequency_runs(sub.sequences(spark, sf_dir), ["name"], 12)


@query(f"with {KMERS} select s.name, coalesce(n_kmers, 0) as n_kmers, coalesce(n_unique, 0) as n_unique, n_unique / n_kmers as fraction from seqs s left join (select name, count(*) as n_kmers, count(*) filter (n <= 1) as n_unique from km join counts using (kmer) group by name) using (name)")
def unique_kmer_fraction(spark, sf_dir):
    seqs = sub.sequences(spark, sf_dir)
    return kmers.single_fraction(seqs, ["name"], 12)


@query(f"with {KMERS} select s.name, coalesce(n_kmers, 0) as n_kmers, coalesce(n_unique, 0) as n_unique, n_unique / n_kmers as fraction from seqs s left join (select name, count(*) as n_kmers, count(*) filter (n <= 2) as n_unique from km join counts using (kmer) group by name) using (name)")
def rare_kmer_fraction(spark, sf_dir):
    seqs = sub.sequences(spark, sf_dir)
    return kmers.unique_fraction(seqs, kmers.limited(kmers.count(seqs, 12), 2), ["name"], 12)


@query(f"with {KMERS}, hit as (select name as chrom, pos as s, pos + 12 as e from km join counts using (kmer) where n <= 1), {merged_sql('hit', 'm')} select chrom as name, s::bigint as start, e::bigint as \"end\" from m")
def unique_runs(spark, sf_dir):
    seqs = sub.sequences(spark, sf_dir)
    runs = kmers.unique_runs(seqs, kmers.limited(kmers.count(seqs, 12), 1), ["name"], 12)
    return runs.select("name", F.col("start").cast("long"), F.col("end").cast("long"))


@query("select count(*) filter (l.doc_id is null) as only_left, count(*) filter (d.doc_id is null) as only_right, count(*) filter (l.doc_id is not null and d.doc_id is not null) as both from (select distinct doc_id from documents) d full join (select distinct doc_id from labels) l using (doc_id)")
def id_consistency_counts(spark, sf_dir):
    return kmers.id_consistency(sub.table(spark, sf_dir, "documents"), sub.table(spark, sf_dir, "labels"), "doc_id")


@query("select doc_id, lang, n_chars from documents where doc_id in (select doc_id from labels where quality >= 1)")
def semi_join_keep_ids(spark, sf_dir):
    labels = sub.table(spark, sf_dir, "labels").withColumn("metric", F.col("quality").cast("double"))
    return kmers.keep_ids(sub.table(spark, sf_dir, "documents"), labels, "doc_id", "metric", 1.0).select("doc_id", "lang", "n_chars")


@query("select l_orderkey, count(*) as n from lineitem group by 1 having count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return kmers.duplicates(sub.table(spark, sf_dir, "lineitem"), "l_orderkey")


@query(
    f"""with {SEQ}, km as (select distinct name, least(k, {RC.format('k')}) as kmer from (select name, substr(seq, p + 1, 12) as k from (select name, seq, unnest(range(0, greatest(length(seq) - 11, 0))) as p from seqs))),
 mins as (select name, min(md5('0:' || kmer)) as a, min(md5('1:' || kmer)) as b from km group by name)
 select seqs.name, 'LSH:' || md5(coalesce(a || '-' || b, '')) as group_id from seqs left join mins using (name)"""
)
def minhash_groups_md5(spark, sf_dir):
    return sketch.md5_groups(sub.sequences(spark, sf_dir), ["name"], 12)


@query()
def minhash_groups_blake2(spark, sf_dir):
    return sketch.minhash_groups(sub.sequences(spark, sf_dir), ["name"], 12)


# --- signals -------------------------------------------------------------------------------------------------------

SIG = "sig as (select l_returnflag as chrom, datediff('day', date '1992-01-01', cast(l_shipdate as date))::bigint as pos, count(*) as v from lineitem group by 1, 2)"
SMOOTH = f"""{SIG}, sm0 as (select *, sum(v) over w / count(v) over w as sm from sig window w as (partition by chrom order by pos rows between 25 preceding and 25 following)),
 sm as (select chrom, pos, v, pos % 97 < 5 as masked, case when pos % 97 < 5 then max(sm) over (partition by chrom) + 1 else sm end as sm from sm0)"""
THR = f"""{SMOOTH}, thr as (select chrom, sm as thr from (select *, row_number() over (partition by chrom order by sm) - 1 as i, count(*) over (partition by chrom) as n from sm where not masked)
 where i = least(floor(n * 30 / 100)::bigint, n - 1))"""
LOW = f"""{THR}, isl as (select sm.*, thr, pos - row_number() over (partition by chrom order by pos) as g from sm join thr using (chrom) where sm <= thr * 1.2),
 islands as (select chrom, min(pos) as s, max(pos) + 1 as e, min(sm) as low, min_by(pos, (sm, pos)) as low_pos from isl group by chrom, g)"""
MINIMA = f"""{THR}, lm as (select sm.*, thr, min(case when not masked then sm end) over (partition by chrom order by pos rows between 20 preceding and 20 following) as least from sm join thr using (chrom)),
 minima as (select chrom, pos, sm from lm where not masked and sm <= thr and sm <= least + 1e-12)"""


@query(f"with {SIG}, r as (select *, pos - row_number() over (partition by chrom, v order by pos) as g from sig) select chrom, min(pos) as start, max(pos) + 1 as \"end\", v as \"value\" from r group by chrom, v, g")
def signal_runs_encode(spark, sf_dir):
    return signal.encode_runs(sub.signal(spark, sf_dir), ["chrom"])


@query(f"with {SIG}, spine as (select chrom, unnest(range(0, 4000)) as pos from (select distinct chrom from sig)) select chrom, pos::bigint as pos, coalesce(v, 0)::double as \"value\" from spine left join sig using (chrom, pos)")
def signal_densify(spark, sf_dir):
    sig = sub.signal(spark, sf_dir)
    runs = signal.encode_runs(sig, ["chrom"]).withColumn("value", F.col("value").cast("double"))
    return signal.densify(runs, sub.lengths(sig), ["chrom"])


@query(f"with {SMOOTH} select chrom, pos, masked, round(sm, 9) as sm from sm")
def moving_average_51(spark, sf_dir):
    return sub.masked_signal(spark, sf_dir).select("chrom", "pos", "masked", F.round("sm", 9).alias("sm"))


@query(f"with {THR} select chrom, round(thr, 9) as thr from thr")
def percentile_index_threshold(spark, sf_dir):
    return signal.percentile_threshold(sub.masked_signal(spark, sf_dir), ["chrom"], 30).select("chrom", F.round("thr", 9).alias("thr"))


def _minima(spark, sf_dir):
    sig = cut(sub.masked_signal(spark, sf_dir), "signal")  # thresholds, minima and islands read it
    thr = signal.percentile_threshold(sig, ["chrom"], 30)
    return sig, thr, signal.local_minima(sig, thr, ["chrom"], 20)


@query(f"with {MINIMA} select chrom, pos, round(sm, 9) as sm from minima")
def local_minima_masked(spark, sf_dir):
    return _minima(spark, sf_dir)[2].select("chrom", "pos", F.round("sm", 9).alias("sm"))


@query(f"with {LOW} select chrom, s as start, e as \"end\", round(low, 9) as low, low_pos from islands")
def valley_islands(spark, sf_dir):
    sig, thr, _ = _minima(spark, sf_dir)
    return signal.low_islands(sig, thr, ["chrom"], 1.2).withColumn("low", F.round("low", 9))


_NMS = f"""with recursive {MINIMA}, ranked as (select *, row_number() over (partition by chrom order by sm, pos) as i from minima),
 step(chrom, i, kept) as (select distinct chrom, 0::bigint, []::bigint[] from ranked union all
  select r.chrom, r.i, case when len(list_filter(kept, lambda x: abs(x - r.pos) <= 20)) = 0 then list_append(kept, r.pos) else kept end from step join ranked r on r.chrom = step.chrom and r.i = step.i + 1),
 nms as (select r.chrom, r.pos, r.sm from ranked r join (select chrom, kept from step qualify row_number() over (partition by chrom order by i desc) = 1) k on k.chrom = r.chrom and list_contains(k.kept, r.pos))"""


@query(f"{_NMS} select chrom, pos, round(sm, 9) as sm from nms")
def valley_nms(spark, sf_dir):
    return signal.suppress(_minima(spark, sf_dir)[2], ["chrom"], 20).select("chrom", "pos", F.round("sm", 9).alias("sm"))


@query(
    f"""{_NMS}, isl as (select sm.*, thr, pos - row_number() over (partition by chrom order by pos) as g from sm join thr using (chrom) where sm <= thr * 1.2),
 islands as (select chrom, min(pos) as s, max(pos) + 1 as e from isl group by chrom, g),
 spans as (select n.chrom, s, e, n.pos, n.sm from nms n join islands i on n.chrom = i.chrom and n.pos >= s and n.pos < e qualify row_number() over (partition by n.chrom, s order by n.sm, n.pos) = 1)
 select chrom, s as start, e as "end", 'anchor_' || (pos + 1) as anchor_id, round_even(sm * 100, 0)::bigint as score, '+' as strand from spans where e - s >= 3"""
)
def anchors_from_valleys(spark, sf_dir):
    sig, thr, minima = _minima(spark, sf_dir)
    spans = signal.valley_spans(signal.suppress(minima, ["chrom"], 20), signal.low_islands(sig, thr, ["chrom"], 1.2), ["chrom"])
    return signal.anchors(spans, ["chrom"], 100, 3)


@query(
    f"""with {THR}, hi as (select sm.*, pos - row_number() over (partition by chrom order by pos) as g from sm join thr using (chrom) where not masked and sm > thr),
 runs as (select chrom, min(pos) as s, max(pos) + 1 as e, avg(sm) as mean from hi group by chrom, g having count(*) >= 5)
 select chrom, s as start, e as "end", 'repeat_' || row_number() over (partition by chrom order by s) as name, round_even(mean, 0)::bigint as score from runs"""
)
def high_coverage_runs(spark, sf_dir):
    sig, thr, _ = _minima(spark, sf_dir)
    return signal.high_runs(sig, thr, ["chrom"], 5, 1.0)


# --- contexts ------------------------------------------------------------------------------------------------------

ANC = """anc as (select (user_id % 2)::int as sample, user_id // 2 as chrom, event_id as anchor_id, ((epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 60000000)::double as center, event_type as gid from events),
 ord as (select *, row_number() over w - 1 as idx, count(*) over (partition by sample, chrom) as n, lead(center) over w - center as gap, round_even((lead(center) over w - center) / 720, 0)::int as b
  from anc window w as (partition by sample, chrom order by center, anchor_id))"""
SIGN = f"""{ANC}, nb as (select *, lag(gid, 1) over w as g1, lag(b, 1) over w as b1, lag(gid, 2) over w as g2, lag(b, 2) over w as b2, lead(gid, 1) over w as h1, b as c1, lead(gid, 2) over w as h2, lead(b, 1) over w as c2
  from ord window w as (partition by sample, chrom order by idx)),
 ctx as (select sample, chrom, anchor_id, gid, idx, n, 1 as k, g1 || ':' || b1 as l, h1 || ':' || c1 as r from nb where idx >= 1 and idx + 1 < n
  union all select sample, chrom, anchor_id, gid, idx, n, 2, g1 || ':' || b1 || ',' || g2 || ':' || b2, h1 || ':' || c1 || ',' || h2 || ':' || c2 from nb where idx >= 2 and idx + 2 < n)"""
INDEX = f"{SIGN}, ix as (select gid, k, l, r, min(anchor_id) as rid from ctx where sample = 0 group by all having count(*) = 1)"
HITS = f"""{INDEX}, fwd as (select q.anchor_id as qid, k, rid from ctx q join ix using (gid, k, l, r) where sample = 1),
 inv as (select q.anchor_id as qid, q.k, rid from ctx q join ix on q.gid = ix.gid and q.k = ix.k and q.l = ix.r and q.r = ix.l where sample = 1)"""


def _signed(spark, sf_dir, most: int = 2):
    ordered = context.order(sub.anchors(spark, sf_dir), 720)
    signed = context.signatures(ordered, most)
    return signed.where("sample = 1"), signed.where("sample = 0").withColumn("k_min", F.lit(1))


@query(f"with {ANC} select sample, chrom, anchor_id, idx, gap, b as bin from ord")
def anchor_order_gaps(spark, sf_dir):
    return context.order(sub.anchors(spark, sf_dir), 720).select("sample", "chrom", "anchor_id", "idx", "gap", "bin")


def _tokens_sql(t: str) -> str:
    return f"""with {ANC} select sample, chrom, ({t})::bigint as t, token from (select *, 2 * idx as t0, 'G:' || gid as token from ord union all select *, 2 * idx + 1, 'D:' || b from ord where b is not null)"""


@query(_tokens_sql("t0"))
def token_sequence(spark, sf_dir):
    return context.tokens(context.order(sub.anchors(spark, sf_dir), 720)).drop("anchor_id")


@query(_tokens_sql("2 * n - 2 - t0"))
def token_sequence_inverted(spark, sf_dir):
    return context.tokens(context.order(sub.anchors(spark, sf_dir), 720), reverse=True).drop("anchor_id")


def _text(side: str):
    return F.array_join(F.transform(side, lambda x: F.concat(x["g"], F.lit(":"), x["b"].cast("string"))), ",")


@query(f"with {SIGN} select sample, anchor_id, k, l, r from ctx")
def context_signatures(spark, sf_dir):
    signed = context.signatures(context.order(sub.anchors(spark, sf_dir), 720), 2)
    return matching.contexts(signed, [1, 2]).select("sample", "anchor_id", "k", _text("l").alias("l"), _text("r").alias("r"))


TOK = f"""{ANC}, tok as (select sample, chrom, 2 * idx as t, 'G:' || gid as token from ord union all select sample, chrom, 2 * idx + 1, 'D:' || b from ord where b is not null),
 win as (select sample, chrom, t, list(token) over (partition by sample, chrom order by t rows between current row and 5 following) as ahead from tok),
 ss as (select sample, chrom, t, size, array_to_string(ahead[1:size], '|') as text from (select *, unnest(range(1, len(ahead) + 1)) as size from win)),
 cnt as (select sample, chrom, size, text, count(*) as n, min(t) as t from ss group by all),
 mus as (select sample, chrom, t as s, t + min(size) - 1 as e from cnt where n = 1 group by sample, chrom, t)"""
TOK = TOK.replace("select sample, chrom, size, text, count(*) as n, min(t) as t from ss group by all", "select sample, chrom, size, text, count(*) as n, min(t) as t from ss group by sample, chrom, size, text")


def _tokens(spark, sf_dir):
    ordered = context.order(sub.anchors(spark, sf_dir), 720)
    return ordered, context.tokens(ordered)


@query(f"with {TOK} select sample, chrom, size::int as size, text, n from cnt")
def token_substring_counts(spark, sf_dir):
    return uniqueness.substring_counts(_tokens(spark, sf_dir)[1], 6)


@query(f"with {TOK} select sample, chrom, s::bigint as s, e::bigint as e from mus")
def minimal_unique_substrings(spark, sf_dir):
    return uniqueness.minimal_unique(_tokens(spark, sf_dir)[1], 6)


MINK = f"""{TOK}, near as (select o.sample, o.chrom, o.anchor_id, min(greatest(ceil(greatest(2 * idx - s, e - 2 * idx) / 2), 1))::int as need from ord o join mus m on m.sample = o.sample and m.chrom = o.chrom and s >= 2 * idx - 6 and e <= 2 * idx + 6 group by all),
 mink as (select o.sample, o.chrom, o.anchor_id, o.idx, case when need <= least(idx, n - 1 - idx, 3) then need else 0 end as k_min from ord o left join near using (sample, chrom, anchor_id))""".replace("group by all)", "group by o.sample, o.chrom, o.anchor_id)")


def _contexts(spark, sf_dir, longest: int = 6):
    ordered, tokens = _tokens(spark, sf_dir)
    return uniqueness.least_context(ordered, uniqueness.minimal_unique(tokens, longest), 3, longest)


# substrings of all lengths that the widest window (2 * idx - 6 to 2 * idx + 6) can hold: 13 tokens
@query(f"with {MINK} select sample, chrom, anchor_id, coalesce(k_min, 0)::int as k_min from mink".replace("and 5 following", "and 12 following"))
def ref_min_k(spark, sf_dir):
    return _contexts(spark, sf_dir, uniqueness.window_tokens(3)).select("sample", "chrom", "anchor_id", "k_min")


@query(f"with {MINK} select sample, anchor_id, coalesce(k_min, 0) = 0 as ambiguous, case when coalesce(k_min, 0) = 0 then '' else 'anchor' || lpad((sum(case when coalesce(k_min, 0) > 0 then 1 else 0 end) over (partition by sample order by chrom, idx))::varchar, 5, '0') end as uid from mink")
def ref_uid_dictionary(spark, sf_dir):
    return uniqueness.dictionary(_contexts(spark, sf_dir)).select("sample", "anchor_id", "ambiguous", "uid")


@query(
    f"""with {TOK} select sample, chrom, list_reduce(list({{'s': s::bigint, 'e': e::bigint, 'n': 1::bigint}} order by e, s), lambda a, b: case when b.s > a.e then {{'s': b.s, 'e': b.e, 'n': a.n + 1}} else a end).n as n
 from mus group by sample, chrom"""
)
def disjoint_unique_substrings(spark, sf_dir):
    mus = uniqueness.minimal_unique(_tokens(spark, sf_dir)[1], 6)
    return mus.groupBy("sample", "chrom").agg(uniqueness.disjoint_count(F.collect_list(F.struct("s", "e"))).alias("n"))


@query(f"with {HITS} select qid, k, rid from fwd")
def exact_context_match_fwd(spark, sf_dir):
    q, r = _signed(spark, sf_dir)
    return matching.exact_hits(q, matching.unique_index(r, [1, 2]), [1, 2])


@query(f"with {HITS} select qid, k, rid from inv")
def exact_context_match_inv(spark, sf_dir):
    q, r = _signed(spark, sf_dir)
    return matching.exact_hits(q, matching.unique_index(r, [1, 2]), [1, 2], invert=True)


@query(
    f"""with {SIGN}, c2 as (select *, string_split(l, ',') as la, string_split(r, ',') as ra from ctx where k = 2)
 select q.anchor_id as qid, r.anchor_id as rid from c2 q join c2 r on q.gid = r.gid and q.sample = 1 and r.sample = 0
 where (q.la[1] <> r.la[1])::int + (q.la[2] <> r.la[2])::int + (q.ra[1] <> r.ra[1])::int + (q.ra[2] <> r.ra[2])::int <= 1"""
)
def context_ed_match(spark, sf_dir):
    q, r = _signed(spark, sf_dir)
    return matching.near_hits(q, r, [2], 1).select("qid", "rid")


ARB = f"""{HITS}, f as (select qid, k, list(distinct rid) as f from fwd group by qid, k), i as (select qid, k, list(distinct rid) as i from inv group by qid, k),
 s as (select qid, k, coalesce(f, []) as f, coalesce(i, []) as i from f full join i using (qid, k)),
 arb as (select qid, k, case when len(f) = 1 and (len(i) <> 1 or f[1] = i[1]) then f when len(i) = 1 and len(f) <> 1 then i else list_distinct(list_concat(f, i)) end as pool,
  case when len(f) = 1 and (len(i) <> 1 or f[1] = i[1]) then 'token_mum' when len(i) = 1 and len(f) <> 1 then 'token_mum_inv' else 'token_mum_mix' end as method,
  case when len(i) = 1 and len(f) <> 1 then '-' when len(f) >= len(i) then '+' else '-' end as strand from s),
 ch as (select qid, k, case when len(pool) = 1 then pool[1] end as rid, method, strand, len(pool)::int as n_cand from arb)"""


def _choices(spark, sf_dir):
    q, r = _signed(spark, sf_dir)
    index = matching.unique_index(r, [1, 2])
    return q, matching.arbitrate(matching.exact_hits(q, index, [1, 2]), matching.exact_hits(q, index, [1, 2], invert=True))


@query(f"with {ARB} select * from ch")
def orientation_arbitration(spark, sf_dir):
    return _choices(spark, sf_dir)[1]


@query(
    f"""with {ARB}, c1 as (select * from ch where k = 1 and rid is not null), s1 as (select *, count(*) over (partition by rid) = 1 as ok from c1),
 c2 as (select * from ch where k = 2 and rid is not null and qid not in (select qid from s1 where ok)), s2 as (select *, count(*) over (partition by rid) = 1 as ok from c2),
 fin as (select * from s1 where ok union all select * from s2)
 select a.anchor_id as qid, case when ok then 'assign' when ok is null then 'unmatched' else 'discordant' end as status, case when ok then method else '' end as method, case when ok then rid end as rid, coalesce(k, 0)::int as used_k
 from (select anchor_id from anc where sample = 1) a left join fin on qid = anchor_id"""
)
def conflict_expand_assign(spark, sf_dir):
    q, choices = _choices(spark, sf_dir)
    return matching.assign(q, choices, [1, 2]).select("qid", "status", "method", "rid", "used_k")


# --- chains --------------------------------------------------------------------------------------------------------

LNK = "lnk as (select user_id // 20 as chrom, ((epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 60000000)::double as r, ((epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 60000000)::double + value / 10 as q, event_id as rid from events)"
CHAIN = f"""recursive {LNK}, o as (select *, row_number() over (partition by chrom order by r, q, rid) as i from lnk),
 st(chrom, i, r, q, skip, chain, kept) as (select chrom, i, r, q, 0, 0, true from o where i = 1 union all
  select o.chrom, o.i, case when ok or st.skip >= 5 then o.r else st.r end, case when ok or st.skip >= 5 then o.q else st.q end, case when ok or st.skip >= 5 then 0 else st.skip + 1 end, case when not ok and st.skip >= 5 then st.chain + 1 else st.chain end, ok or st.skip >= 5
  from st join o on o.chrom = st.chrom and o.i = st.i + 1, lateral (select o.r - st.r > 0 and o.r - st.r <= 60 * (st.skip + 1) and abs(o.q - st.q) <= 60 * (st.skip + 1) and (o.q - st.q) / (o.r - st.r) between 0.5 and 2 as ok) t)"""


def _chained(spark, sf_dir):
    return chaining.chain(sub.links(spark, sf_dir), ["chrom"], 60, 60, (0.5, 2))


@query(f"with {CHAIN} select chrom, chain::bigint as chain, count(*) as n_links, min(r) as ref_start, max(r) as ref_end, round(min(q), 6) as qry_start, round(max(q), 6) as qry_end from st where kept group by chrom, chain")
def colinear_chains(spark, sf_dir):
    stats = chaining.bundle_stats(_chained(spark, sf_dir), ["chrom"])
    return stats.select("chrom", "chain", "n_links", "ref_start", "ref_end", F.round("qry_start", 6).alias("qry_start"), F.round("qry_end", 6).alias("qry_end"))


@query(
    f"""with {CHAIN}, d as (select *, r - lag(r) over w as dr, q - lag(q) over w as dq from st where kept window w as (partition by chrom, chain order by r, q)),
 a as (select chrom, chain, median(dq / dr) filter (dr > 0) as slope, max(dr) as gap_r, max(abs(dq)) as gap_q from d group by chrom, chain),
 b as (select chrom, chain, median(q - coalesce(slope, 1) * r) as b0 from d join a using (chrom, chain) group by chrom, chain)
 select chrom, chain::bigint as chain, round(slope, 6) as slope_med, round(b0, 6) as b0_med, coalesce(gap_r, 0) as max_gap_ref, round(coalesce(gap_q, 0), 6) as max_gap_qry from a join b using (chrom, chain)"""
)
def colinear_chain_stats(spark, sf_dir):
    stats = chaining.bundle_stats(_chained(spark, sf_dir), ["chrom"])
    return stats.select("chrom", "chain", F.round("slope_med", 6).alias("slope_med"), F.round("b0_med", 6).alias("b0_med"), "max_gap_ref", F.round("max_gap_qry", 6).alias("max_gap_qry"))


@query(f"with {LNK}, o as (select chrom, rid, row_number() over (partition by chrom order by r, rid) - 1 as i, count(*) over (partition by chrom) as n from lnk) select chrom, rid from o where i % greatest(ceil(n / 200)::bigint, 1) = 0")
def link_downsample(spark, sf_dir):
    return signal.downsample(sub.links(spark, sf_dir), ["chrom"], ["ref_center", "rid"], 200).select("chrom", "rid")


def _bundles(spark, sf_dir):
    return chaining.bundle_stats(_chained(spark, sf_dir), ["chrom"], min_links=5).withColumn("strand", F.lit("+"))


# --- records -------------------------------------------------------------------------------------------------------

CIG = """cig as (select l_orderkey, string_agg(cast(l_quantity as int) || case l_returnflag when 'A' then '=' when 'N' then 'I' else 'X' end, '' order by l_linenumber, l_partkey, l_suppkey, cast(l_quantity as int), case l_returnflag when 'A' then '=' when 'N' then 'I' else 'X' end) as cigar from lineitem group by l_orderkey),
 ops as (select l_orderkey, i, unnest(regexp_extract_all(cigar, '([0-9]+)[M=XID]', 1))::int as n, unnest(regexp_extract_all(cigar, '[0-9]+([M=XID])', 1)) as op, unnest(range(1, len(regexp_extract_all(cigar, '[M=XID]')) + 1)) as i from (select *, 0 as i from cig))"""
CIG = CIG.replace("select l_orderkey, i, unnest(regexp", "select l_orderkey, unnest(regexp").replace("from (select *, 0 as i from cig)", "from cig")


@query(f"with {CIG} select l_orderkey, sum(n) filter (op in ('=', 'X', 'D'))::bigint as ref, coalesce(sum(n) filter (op in ('=', 'X', 'I')), 0)::bigint as qry, coalesce(sum(n) filter (op = '='), 0)::bigint as same, sum(n)::bigint as alen from ops group by l_orderkey".replace("sum(n) filter (op in ('=', 'X', 'D'))::bigint", "coalesce(sum(n) filter (op in ('=', 'X', 'D')), 0)::bigint"))
def cigar_parse_counts(spark, sf_dir):
    ops = cigar.parse(F.col("cigar"))
    return sub.cigars(spark, sf_dir).withColumn("o", ops).select("l_orderkey", cigar.reference_bases(F.col("o")).alias("ref"), cigar.query_bases(F.col("o")).alias("qry"), cigar.matches(F.col("o")).alias("same"), cigar.alignment_length(F.col("o")).alias("alen"))


@query(
    f"""with {CIG}, g as (select *, i - row_number() over (partition by l_orderkey, op order by i) as isl from ops), m as (select l_orderkey, op, isl, min(i) as i, sum(n) as n from g group by l_orderkey, op, isl)
 select l_orderkey, string_agg(n || op, '' order by i) as cigar, min_by(op, (-n, i)) as longest from m group by l_orderkey"""
)
def cigar_normalize(spark, sf_dir):
    ops = cigar.normalize(cigar.parse(F.col("cigar")))
    return sub.cigars(spark, sf_dir).withColumn("o", ops).select("l_orderkey", cigar.render(F.col("o")).alias("cigar"), cigar.dominant(F.col("o"))["op"].alias("longest"))


@query(
    f"""with {CIG}, g as (select *, i - row_number() over (partition by l_orderkey, op order by i) as isl from ops), m as (select l_orderkey, op, isl, min(i) as i, sum(n)::bigint as n from g group by l_orderkey, op, isl),
 t as (select l_orderkey, coalesce(sum(n) filter (where op in ('=', 'X')), 0) as mx, coalesce(sum(n) filter (where op = 'I'), 0) as ins, coalesce(sum(n) filter (where op = 'X'), 0) as x, string_agg(n || op, '' order by i) as raw, string_agg(op, '' order by i) as shape from m group by l_orderkey),
 d as (select l_orderkey, min(i) as spot from (select *, rank() over (partition by l_orderkey order by n desc) as r from m where op = 'I') where r = 1 group by l_orderkey),
 l as (select m.l_orderkey, coalesce(sum(n) filter (where op in ('=', 'X') and i < spot), 0) as lft from m join d using (l_orderkey) group by m.l_orderkey),
 s as (select t.*, coalesce(lft, 0) as lft, mx - coalesce(lft, 0) as rgt, ins >= 100 and x <= 200 as simple from t left join l using (l_orderkey)),
 c as (select *, (simple or shape = '=I=') and lft >= 20 and rgt >= 20 as cuts, case when simple then '1I' else 'raw' end as mode from s)
 select l_orderkey, mode, null::int as half, null::int as hidden, 0::bigint as tstart, mx::bigint as tend, 0::bigint as qstart, (mx + ins)::bigint as qend,
  case when simple then (case when lft > 0 then lft || '=' else '' end) || ins || 'I' || (case when rgt > 0 then rgt || '=' else '' end) else raw end as cigar from c where not cuts
 union all select l_orderkey, mode, 0, ins::int, 0, lft::bigint, 0, lft::bigint, lft || '=' from c where cuts
 union all select l_orderkey, mode, 1, ins::int, (mx - rgt)::bigint, mx::bigint, (mx + ins - rgt)::bigint, (mx + ins)::bigint, rgt || '=' from c where cuts"""
)
def cigar_simplify_split(spark, sf_dir):
    rows = sub.cigars(spark, sf_dir).withColumn("o", cigar.normalize(cigar.parse(F.col("cigar")))).withColumn("s", cigar.simplify(F.col("o")))
    # written, so that what follows does not repeat the folds in each of its conditions
    rows = cut(rows.select("l_orderkey", cigar.render(F.col("s.ops")).alias("cigar"), "s.mode"), "simplified")
    n = cigar.parse(F.col("cigar"))
    placed = rows.withColumns({"tname": F.lit("t"), "qname": F.lit("q"), "strand": F.lit("+"), "tstart": F.lit(0).cast("long"), "tend": cigar.reference_bases(n), "qstart": F.lit(0).cast("long"), "qend": cigar.query_bases(n), "nmatch": cigar.matches(n), "alen": cigar.alignment_length(n)})
    return records.split_insertions(placed, 20).select("l_orderkey", "mode", "half", "hidden", "tstart", "tend", "qstart", "qend", "cigar")


PAF = f"""{IV}, paf as (select 'q' || (l_orderkey % 5) as qname, s as qstart, e as qend, case when l_linestatus = 'O' then '+' else '-' end as strand, chrom as tname, s as tstart, e as tend,
 (l_quantity - floor(l_discount * 100)::bigint % 3)::bigint as nmatch, l_quantity::bigint as alen, round(l_discount * 600)::int as mapq, l_orderkey from iv)"""


@query(f"with {PAF} select tname, qname, strand, mapq, alen from paf qualify row_number() over (partition by tname, qname, strand order by mapq desc, alen desc, l_orderkey, tstart) = 1")
def paf_best_alignment(spark, sf_dir):
    rows = sub.records(spark, sf_dir).withColumn("_order", F.struct("l_orderkey", "tstart"))
    return records.best(rows, ["tname", "qname", "strand"], "_order").select("tname", "qname", "strand", "mapq", "alen")


@query(f"with {PAF} select tname, qname, strand, count(*) as n, sum(case when strand = '-' then 4000 - qend else qstart end)::bigint as fwd_start, sum(case when strand = '-' then 5000 - qend else 1000 + qstart end)::bigint as lifted, sum(4000 - qend)::bigint as inv_start from paf group by tname, qname, strand")
def paf_lift_forward_inverse(spark, sf_dir):
    c = F.col
    forward = coords.strand_forward(c("qstart"), c("qend"), c("qlen"), c("strand"))[0]
    lifted = coords.lift(c("qstart"), c("qend"), F.lit(1000), F.lit(5000), c("strand"))[0]
    inverse = coords.invert(c("qstart"), c("qend"), c("qlen"))[0]
    return sub.records(spark, sf_dir).groupBy("tname", "qname", "strand").agg(F.count(F.lit(1)).alias("n"), F.sum(forward).alias("fwd_start"), F.sum(lifted).alias("lifted"), F.sum(inverse).alias("inv_start"))


@query(
    f"""with {PAF}, nx as (select tname, qname, strand, tend, qend, lead(tstart) over w as nt, lead(qstart) over w as nq from paf window w as (partition by tname, qname, strand order by tstart, tend, qstart, qend))
 select tname, qname, strand, tend, qend, nt - tend as gap_t, nq - qend as gap_q from nx where nt - tend > 0 and nq - qend > 0 and greatest(nt - tend, nq - qend) <= 500"""
)
def paf_gap_candidates(spark, sf_dir):
    return records.gap_candidates(sub.records(spark, sf_dir), 500).select("tname", "qname", "strand", "tend", "qend", "gap_t", "gap_q")


@query(f"with {PAF} select tname, qname, strand, tstart // 200 as bin, tend // 200 as bin_end, nmatch, alen from paf qualify row_number() over (partition by tname, qname, strand, tstart // 200, tend // 200 order by nmatch / greatest(alen, 1) desc, alen desc, l_orderkey, tstart) = 1")
def paf_dedup_bins(spark, sf_dir):
    rows = sub.records(spark, sf_dir).withColumn("_order", F.struct("l_orderkey", "tstart"))
    return records.dedup(rows, 200, "_order").select("tname", "qname", "strand", F.floor(F.col("tstart") / 200).alias("bin"), F.floor(F.col("tend") / 200).alias("bin_end"), "nmatch", "alen")


@query(
    """with hosts as (select page_id, regexp_extract(url, '://([^/?#]*)', 1) as host from pages), contigs as (select host as contig, count(*) as length from hosts where host like 'www.%' or host like 'm.%' group by host),
 w as (select page_id, regexp_replace(host, '^www[.]', 'm.') as name from hosts)
 select page_id, name, case when name in (select contig from contigs) then name end as contig from w"""
)
def contig_resolution(spark, sf_dir):
    hosts = sub.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))
    contigs = hosts.where("host like 'www.%' or host like 'm.%'").groupBy(F.col("host").alias("contig")).agg(F.count(F.lit(1)).alias("length"))
    return records.resolve_contigs(hosts.select("page_id", F.regexp_replace("host", "^www[.]", "m.").alias("name")), contigs, "name").select("page_id", "name", "contig")


@query("select o_orderkey, greatest(o_orderkey - 50, 0)::bigint as tstart, least(o_orderkey + 50, 1000000000)::bigint as tend, greatest(o_custkey - 50, 0)::bigint as qstart, (least(o_custkey + 50, 1000000000))::bigint as qend, least(least(o_orderkey + 50, 1000000000) - greatest(o_orderkey - 50, 0), least(o_custkey + 50, 1000000000) - greatest(o_custkey - 50, 0))::bigint as nmatch from orders")
def pairs_to_records(spark, sf_dir):
    orders = sub.table(spark, sf_dir, "orders")
    pairs = orders.select(F.col("o_orderkey").cast("string").alias("qname"), F.lit("t").alias("tname"), F.lit(10**9).cast("long").alias("qlen"), F.lit(10**9).cast("long").alias("tlen"), F.col("o_orderkey").cast("double").alias("ref_center"), F.col("o_custkey").cast("double").alias("qry_center"))
    return records.from_pairs(pairs, 50).select(F.col("qname").cast("long").alias("o_orderkey"), "tstart", "tend", "qstart", "qend", "nmatch")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: anchors from the valleys of a signal."""
    return anchors_from_valleys(spark, sf_dir)
