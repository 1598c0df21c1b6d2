"""Registered queries that make alignment records: from bundles, for gaps, from family tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrspark.operators import assembly, chaining
from corrspark.plans import substrates as sub
from corrspark.queries import CHAIN, _chained, query

# --- bundles to records --------------------------------------------------------------------------------------------

_BUNDLES = f"""with {CHAIN}, kept as (select *, max(round_even(q, 0)::bigint) over (partition by chrom, chain order by r, q rows unbounded preceding) as qq from st where kept),
 b as (select chrom, chain, 'b' || chrom || '_' || chain as id, chain % 2 = 1 as minus, min(r)::bigint as rs, max(r)::bigint as re, round_even(min(q), 0)::bigint as qs0, round_even(max(q), 0)::bigint as qe0, min(qq) as a0, max(qq) as b0 from kept group by chrom, chain having count(*) >= 3),
 c as (select *, case when minus then 50000 - qe0 else qs0 end as qs, case when minus then 50000 - qs0 else qe0 end as qe, chrom % 7 <> 3 as there from b),
 d as (select *, case when there then greatest(rs - 30, 0) else rs end as r0, case when there then least(re + 30, 43190) else re end as r1, case when there then greatest(qs - 30, 0) else qs end as q0, case when there then least(qe + 30, 50000) else qe end as q1 from c),
 e as (select *, least(r1 - r0, q1 - q0) as span from d where not there or least(r1 - r0, q1 - q0) between 1 and 2500),
 sp as (select chrom, chain, row_number() over w as i, r::bigint - lag(r::bigint) over w as dt, qq - lag(qq) over w as dq from kept window w as (partition by chrom, chain order by r, qq)),
 op as (select chrom, chain, 2 * i as i, least(dt, dq) as n, '=' as op from sp where dt is not null union all select chrom, chain, 2 * i + 1, abs(dt - dq), case when dt > dq then 'D' else 'I' end from sp where dt is not null),
 pos as (select *, row_number() over (partition by chrom, chain order by i) - row_number() over (partition by chrom, chain, op order by i) as isl from op where n > 0),
 m as (select chrom, chain, op, min(i) as i, sum(n)::bigint as n from pos group by chrom, chain, op, isl),
 cg as (select chrom, chain, string_agg(n || op, '' order by i) as cg, coalesce(sum(n) filter (op = '='), 0)::bigint as same, sum(n)::bigint as alen from m group by chrom, chain)"""


@query(
    f"""{_BUNDLES} select 'q' || chrom || ':all' as qname, 50000::bigint as qlen, case when minus then 50000 - b0 else a0 end as qstart, case when minus then 50000 - a0 else b0 end as qend, case when minus then '-' else '+' end as strand,
  'r' || chrom || ':all' as tname, 43190::bigint as tlen, rs as tstart, re as tend, same as nmatch, alen, 60 as mapq, 'cg:Z:' || cg || ' id:Z:' || id || ' bs:i:' || span || ' fl:i:30 ss:Z:+ rb:Z:r' || chrom || ':all qb:Z:q' || chrom || ':all' as tags
  from e join cg using (chrom, chain) where there and re <= r1
 union all select case when there then 'q' || chrom || ':all' else 'q' || chrom end, case when there then 50000 else 0 end, q0, q1, case when minus then '-' else '+' end, case when there then 'r' || chrom || ':all' else 'r' || chrom end, case when there then 43190 else 0 end, r0, r1, 0, 0, 0,
  'id:Z:' || id || ' na:i:' || case when there then 3 else 1 end from e left join cg using (chrom, chain) where not there or cg is null or re > r1"""
)
def bundles_to_records(spark, sf_dir):
    c = F.col
    chained = _chained(spark, sf_dir)
    ident = F.concat(F.lit("b"), c("chrom").cast("string"), F.lit("_"), c("chain").cast("string"))
    minus = c("chain") % 2 == 1
    stats = chaining.bundle_stats(chained, ["chrom"], min_links=3).withColumns({"bundle_id": ident, "strand": F.when(minus, "-").otherwise("+")})
    whole = {x: F.bround(x).cast("long") for x in ("ref_start", "ref_end", "qry_start", "qry_end")}
    stats = stats.withColumns(whole).withColumns({"qry_start": F.when(minus, 50000 - c("qry_end")).otherwise(c("qry_start")), "qry_end": F.when(minus, 50000 - c("qry_start")).otherwise(c("qry_end"))})
    name = lambda x: F.concat(F.lit(x), c("chrom").cast("string"))
    bundles = stats.select("bundle_id", F.lit("ref").alias("ref_name"), F.lit("qry").alias("qry_name"), name("r").alias("ref_chrom"), name("q").alias("qry_chrom"), "strand", *whole)
    links = chained.select(ident.alias("bundle_id"), F.when(minus, "-").otherwise("+").alias("strand"), "ref_center", F.when(minus, 50000 - c("qry_center")).otherwise(c("qry_center")).alias("qry_center"))
    there = sub.links(spark, sf_dir).select("chrom").distinct().where("chrom % 7 <> 3")
    contigs = lambda x, n: there.select(F.concat(name(x), F.lit(":all")).alias("contig"), F.lit(n).cast("long").alias("length"))
    out = assembly.bundle_records(bundles, links, contigs("r", 43190), contigs("q", 50000), flank=30, max_bundle=2500, keep_failed=True)
    return out.withColumn("tags", F.array_join("tags", " "))


# --- gaps between records ------------------------------------------------------------------------------------------

_PATCHES = """with rec as (select l_orderkey * 10 + l_linenumber as place, 'q' || (l_orderkey % 5) as qname, 'c' || (l_suppkey % 20) as tname, case when l_linestatus = 'O' then '+' else '-' end as strand,
  datediff('day', date '1992-01-01', cast(l_shipdate as date)) + 500 as ts, datediff('day', date '1992-01-01', cast(l_shipdate as date)) + 500 + l_quantity::bigint as te, (l_orderkey % 40) * 3 as j, l_quantity::bigint as len from lineitem),
 r as (select *, ts + j as f0, te + j as f1, case when strand = '-' then 6000 - te - j else ts + j end as qs, case when strand = '-' then 6000 - ts - j else te + j end as qe from rec),
 nx as (select *, lead(ts) over w as nt, lead(f0) over w as nf, row_number() over w as i from r window w as (partition by tname, qname, strand order by ts, te, qs, qe, place)),
 gp as (select *, greatest(nt - te, 0) as gt, greatest(nf - f1, 0) as gq from nx where nt is not null and greatest(nt - te, nf - f1, 0) <= 110),
 gr as (select tname, qname, strand, min(place) as first from r group by all), gc as (select tname, qname, strand, count(*) as n from gp group by all),
 bf as (select tname, qname, strand, coalesce(sum(n) over (order by first, tname, qname, strand rows between unbounded preceding and 1 preceding), 0)::bigint as before from gr join gc using (tname, qname, strand)),
 nb as (select g.*, before + row_number() over (partition by tname, qname, strand order by ts, te, qs, qe, place) as number, te - 200 as t0, nt + 200 as t1, f1 - 200 as w0, nf + 200 as w1 from gp g join bf using (tname, qname, strand)),
 al as (select *, least(t1 - t0, w1 - w0) // 2 as a, least(t1 - t0, w1 - w0) - least(t1 - t0, w1 - w0) // 2 as z, abs((t1 - t0) - (w1 - w0)) as g, case when t1 - t0 > w1 - w0 then 'D' else 'I' end as op from nb),
 tr as (select *, a - 50 as l, z - 50 as rr, t0 + 50 as u0, t1 - 50 as u1, w0 + 50 as v0, w1 - 50 as v1 from al),
 sm as (select *, g >= 100 as simple, case when strand = '-' then 6000 - v1 else v0 end as x0, case when strand = '-' then 6000 - v0 else v1 end as x1, case when g = 0 then (l + rr) || '=' else l || '=' || g || op || rr || '=' end as cg, (case when g = 0 then (l + rr) || '=' else l || '=' || g || op || rr || '=' end) as merged,
  case when g = 0 then l || '=' || rr || '=' else l || '=' || g || op || rr || '=' end as raw, case when g >= 100 then '1' || op else 'raw' end as mode, (l + rr) / (l + rr + g) as ident, l + rr + g as alen from tr),
 kp as (select *, min(number) over b as first, row_number() over (b order by ident desc, alen desc, number) as k from sm window b as (partition by tname, qname, strand, u0 // 150, u1 // 150, x0 // 150, x1 // 150)),
 tg as (select *, ' tp:Z:gapua id:Z:GAPUA' || lpad(number::varchar, 6, '0') || ' gt:i:' || gt || ' gq:i:' || gq || ' fl:i:200 ko:i:150 bt:i:500 ' as t, g > 0 and op = 'I' and l >= 120 and rr >= 120 as cuts from kp where k = 1)"""


@query(
    f"""{_PATCHES} select qname, qs as qstart, qe as qend, strand, tname, ts as tstart, te as tend, len as nmatch, len as alen, 60 as mapq, 'xx' as tags, 0 as source, place::bigint as number, 0 as half from r
 union all select qname, x0, x1, strand, tname, u0, u1, l + rr, alen, 60, 'cg:Z:' || cg || ' cr:Z:' || raw || t || 'tr:Z:gap_only sm:Z:' || mode, 2, first, 0 from tg where not cuts
 union all select qname, case when strand = '-' then x1 - l else x0 end, case when strand = '-' then x1 else x0 + l end, strand, tname, u0, u0 + l, l, l, 60, 'cg:Z:' || l || '= cr:Z:' || raw || t || 'tr:Z:splitI_left hi:i:' || g || ' sm:Z:splitI', 2, first, 0 from tg where cuts
 union all select qname, case when strand = '-' then x0 else x1 - rr end, case when strand = '-' then x0 + rr else x1 end, strand, tname, u1 - rr, u1, rr, rr, 60, 'cg:Z:' || rr || '= cr:Z:' || raw || t || 'tr:Z:splitI_right hi:i:' || g || ' sm:Z:splitI', 2, first, 1 from tg where cuts"""
)
def patched_records(spark, sf_dir):
    c = F.col
    lines = sub.table(spark, sf_dir, "lineitem")
    start = F.datediff(c("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long") + 500
    minus = c("strand") == "-"
    rows = lines.select(
        (c("l_orderkey") * 10 + c("l_linenumber")).cast("long").alias("place"),
        F.concat(F.lit("q"), (c("l_orderkey") % 5).cast("string")).alias("qname"),
        F.concat(F.lit("c"), (c("l_suppkey") % 20).cast("string")).alias("tname"),
        F.when(c("l_linestatus") == "O", "+").otherwise("-").alias("strand"),
        start.alias("tstart"),
        (start + c("l_quantity").cast("long")).alias("tend"),
        ((c("l_orderkey") % 40) * 3).cast("long").alias("j"),
        c("l_quantity").cast("long").alias("nmatch"),
        c("l_quantity").cast("long").alias("alen"),
        F.lit(6000).cast("long").alias("tlen"),
        F.lit(6000).cast("long").alias("qlen"),
        F.lit(60).alias("mapq"),
        F.array(F.lit("xx")).alias("tags"),
    )
    rows = rows.withColumns({"qstart": F.when(minus, 6000 - c("tend") - c("j")).otherwise(c("tstart") + c("j")), "qend": F.when(minus, 6000 - c("tstart") - c("j")).otherwise(c("tend") + c("j"))})
    out = assembly.patch_gaps(rows, flank=200, keep=150, most=110, tolerance=500, split=True, least_split=120)
    return out.drop("tlen", "qlen").withColumn("tags", F.array_join("tags", " "))
