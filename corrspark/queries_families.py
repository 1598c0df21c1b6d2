"""Registered queries of family tables, of contexts by several targets, and of spans that must not overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrspark.operators import families, signal, uniqueness
from corrspark.plans import substrates as sub
from corrspark.queries import LOW, MINIMA, TOK, _minima, _tokens, query

# --- families ------------------------------------------------------------------------------------------------------


def _wide(spark, sf_dir):
    """A family for each order, with three samples: a in all, b without every third, c in some without a center."""
    c = F.col
    return sub.table(spark, sf_dir, "orders").select(
        c("o_orderkey").alias("ref_anchor_id"),
        F.concat(F.lit("x"), (c("o_custkey") % 5).cast("string")).alias("chrom_a"),
        (c("o_custkey") * 1.5).alias("center_a"),
        F.concat(F.lit("A"), (c("o_custkey") % 1000).cast("string")).alias("anchor_id_a"),
        F.when(c("o_orderkey") % 3 != 0, F.concat(F.lit("y"), (c("o_orderkey") % 7).cast("string"))).alias("chrom_b"),
        (c("o_orderkey") / 4).alias("center_b"),
        F.concat(F.lit("B"), (c("o_orderkey") % 2000).cast("string")).alias("anchor_id_b"),
        F.lit("z").alias("chrom_c"),
        F.when(c("o_orderkey") % 4 != 0, (c("o_orderkey") % 977).cast("double")).alias("center_c"),
        F.concat(F.lit("C"), (c("o_orderkey") % 977).cast("string")).alias("anchor_id_c"),
    )


_WIDE = """w as (select o_orderkey as id, 'x' || (o_custkey % 5) as xa, (o_custkey * 1.5)::double as ca, case when o_orderkey % 3 <> 0 then 'y' || (o_orderkey % 7) end as xb, (o_orderkey / 4)::double as cb, 'z' as xc, case when o_orderkey % 4 <> 0 then (o_orderkey % 977)::double end as cc, o_custkey, o_orderkey from orders)"""


def _family_sql(target: str) -> str:
    return f"""select id, 'a' as ref_sample, '{target}' as target_sample, w.xa as qname, sa.size as qlen, greatest(trunc(ca)::bigint - 200, 0) as qstart, least(trunc(ca)::bigint + 200, sa.size) as qend,
  w.x{target} as tname, st.size as tlen, greatest(trunc(c{target})::bigint - 200, 0) as tstart, least(trunc(c{target})::bigint + 200, st.size) as tend from w join sa on sa.x = w.xa join s{target} st on st.x = w.x{target} where ca is not null and c{target} is not null"""


@query(
    f"""with {_WIDE}, {', '.join(f"s{s} as (select x{s} as x, greatest(max(trunc(c{s})::bigint) + 200, 1) as size from w where x{s} is not null and c{s} is not null group by x{s})" for s in 'abc')}, r as ({_family_sql('b')} union all {_family_sql('c')})
 select qname, qlen, qstart, qend, '+' as strand, tname, tlen, tstart, tend, least(qend - qstart, tend - tstart) as nmatch, least(qend - qstart, tend - tstart) as alen, 60 as mapq, 'id:Z:' || id as tags, 'a_vs_' || target_sample as path_name from r where qend > qstart and tend > tstart"""
)
def families_to_records(spark, sf_dir):
    wide = _wide(spark, sf_dir)
    out = families.family_records(wide, 200, families.sample_pairs(families.samples(wide)))
    return out.drop("ref_sample", "target_sample").withColumn("tags", F.array_join("tags", " "))


@query(
    """with c as (select 'a' as lane, 'A' || (c_custkey % 1000) as id, max(c_acctbal)::double as v from customer where c_custkey % 1000 < 600 group by 2 union all select 'b', 'B' || (p_partkey % 2000), max(p_retailprice)::double from part group by 2),
 n as (select lane, id, (v - min(v) over l) / (max(v) over l - min(v) over l) as x from c window l as (partition by lane)),
 m as (select o_orderkey as k, 'a' as lane, 'A' || (o_custkey % 1000) as id from orders union all select o_orderkey, 'b', 'B' || (o_orderkey % 2000) from orders), j as (select k, lane, id, x from m join n using (lane, id))
 select k::varchar as family, lane, id as anchor_id, round(x, 9) as x from j where k in (select k from j group by k having count(*) >= 2)"""
)
def family_lanes(spark, sf_dir):
    c = F.col
    customers = sub.table(spark, sf_dir, "customer").where("c_custkey % 1000 < 600").select(F.lit("a").alias("lane"), F.concat(F.lit("A"), (c("c_custkey") % 1000).cast("string")).alias("anchor_id"), c("c_acctbal").cast("double").alias("center"))
    parts = sub.table(spark, sf_dir, "part").select(F.lit("b").alias("lane"), F.concat(F.lit("B"), (c("p_partkey") % 2000).cast("string")).alias("anchor_id"), c("p_retailprice").cast("double").alias("center"))
    out = families.lanes(_wide(spark, sf_dir), customers.unionByName(parts), {"a": "anchor_id_a", "b": "anchor_id_b"})
    return out.withColumn("x", F.round("x", 9))


# --- contexts for several targets ----------------------------------------------------------------------------------

_PICKS = """near as (select o.sample, o.chrom, o.anchor_id, o.idx, o.n, s, e, greatest(ceil(greatest(2 * idx - s, e - 2 * idx) / 2), 1)::int as need from ord o join mus m on m.sample = o.sample and m.chrom = o.chrom and s >= 2 * idx - 6 and e <= 2 * idx + 6),
 win as (select sample, chrom, anchor_id, idx, k, list_reduce(list({'s': s::bigint, 'e': e::bigint} order by e, s), lambda a, x: case when x.s > a.e then {'s': a.s + 1, 'e': x.e, 'u': case when a.s < 3 then list_append(a.u, '(' || x.s || ', ' || x.e || ')') else a.u end} else a end, {'s': 0::bigint, 'e': -1::bigint, 'u': []::varchar[]}) as p
  from near, (values (1), (2), (3)) t(k) where need <= k and k <= least(idx, n - 1 - idx) group by all),
 best as (select sample, chrom, anchor_id, target, min(k) as k, min_by(p, k) as p from win, (values (1), (2), (3)) t(target) where p.s >= target group by sample, chrom, anchor_id, target)"""


@query(
    f"""with {TOK.replace('win as (', 'ahd as (').replace('from win)', 'from ahd)')}, {_PICKS}
 select o.sample, o.chrom, o.anchor_id, t.target, coalesce(k, 0)::int as k_min, coalesce(p.s, 0)::bigint as alpha, case when k is null then '' else 'chrom=' || o.chrom || ' win=[' || (2 * o.idx - 2 * k) || ',' || (2 * o.idx + 2 * k) || '] mus_picked=[' || array_to_string(p.u, ', ') || '] (n=' || p.s || ')' end as evidence
 from ord o cross join (values (1), (2), (3)) t(target) left join best b on b.sample = o.sample and b.chrom = o.chrom and b.anchor_id = o.anchor_id and b.target = t.target"""
)
def context_targets_evidence(spark, sf_dir):
    ordered, tokens = _tokens(spark, sf_dir)
    return uniqueness.least_contexts(ordered, uniqueness.minimal_unique(tokens, 6), 3, [1, 2, 3]).drop("idx", "gid")


# --- spans that do not overlap -------------------------------------------------------------------------------------


@query(
    f"""with recursive {MINIMA}, {LOW[LOW.index('isl as'):]}, sp as (select m.chrom, m.pos, m.sm, greatest(i.s, m.pos - 12) as s, least(i.e, m.pos + 13) as e from minima m join islands i on m.chrom = i.chrom and m.pos >= i.s and m.pos < i.e),
 ranked as (select *, row_number() over (partition by chrom order by sm, pos) as i from sp),
 step(chrom, i, kept) as (select distinct chrom, 0::bigint, []::bigint[] from ranked union all
  select r.chrom, r.i, case when (select count(*) from ranked o where o.chrom = r.chrom and list_contains(kept, o.pos) and o.s < r.e and r.s < o.e) = 0 then list_append(kept, r.pos) else kept end from step join ranked r on r.chrom = step.chrom and r.i = step.i + 1)
 select r.chrom, r.s as start, r.e as "end", r.pos, round(r.sm, 9) as sm from ranked r join (select chrom, kept from step qualify row_number() over (partition by chrom order by i desc) = 1) k on k.chrom = r.chrom and list_contains(k.kept, r.pos)"""
)
def spans_apart(spark, sf_dir):
    sig, thr, minima = _minima(spark, sf_dir)
    return signal.valley_spans(minima, signal.low_islands(sig, thr, ["chrom"], 1.2), ["chrom"], 12).withColumn("sm", F.round("sm", 9))
