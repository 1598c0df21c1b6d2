"""Registered queries of the later passes: near contexts, gaps between bundles, windows around bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrspark.operators import matching
from corrspark.plans import substrates as sub
from corrspark.queries import ARB, SIGN, _signed, query
from corrspark.session import cut

# --- near contexts -------------------------------------------------------------------------------------------------

_NEAR3 = f"""{SIGN}, n3 as (select *, lag(gid, 1) over w as g1, lag(b, 1) over w as b1, lag(gid, 2) over w as g2, lag(b, 2) over w as b2, lag(gid, 3) over w as g3, lag(b, 3) over w as b3,
  lead(gid, 1) over w as h1, b as c1, lead(gid, 2) over w as h2, lead(b, 1) over w as c2, lead(gid, 3) over w as h3, lead(b, 2) over w as c3 from ord window w as (partition by sample, chrom order by idx)),
 sym as (select s, chr(48 + row_number() over (order by s)::int) as c from (select distinct gid || ':' || b as s from ord, (select distinct b from ord where b is not null) t(b))),
 c3 as (select sample, anchor_id, gid, s1.c || s2.c || s3.c as l, t1.c || t2.c || t3.c as r from n3 join sym s1 on s1.s = g1 || ':' || b1 join sym s2 on s2.s = g2 || ':' || b2 join sym s3 on s3.s = g3 || ':' || b3
  join sym t1 on t1.s = h1 || ':' || c1 join sym t2 on t2.s = h2 || ':' || c2 join sym t3 on t3.s = h3 || ':' || c3 where idx >= 3 and idx + 3 < n)""".replace("from ord, (select distinct b from ord where b is not null) t(b)", "from (select distinct gid from ord), (select distinct b from ord where b is not null)")


@query(f"with {_NEAR3} select q.anchor_id as qid, r.anchor_id as rid from c3 q join c3 r on q.gid = r.gid and q.sample = 1 and r.sample = 0 where levenshtein(q.l, r.l) + levenshtein(q.r, r.r) <= 3")
def context_ed_match_bound3(spark, sf_dir):
    q, r = _signed(spark, sf_dir, 3)
    return matching.near_hits(q, r, [3], 3).select("qid", "rid")


# --- gaps between bundles ------------------------------------------------------------------------------------------

#: Pass 1: fin has what is settled (ok) or not, by qid.
ASSIGNED = f"""{ARB}, c1 as (select * from ch where k = 1 and rid is not null), s1 as (select *, count(*) over (partition by rid) = 1 as ok from c1),
 c2 as (select * from ch where k = 2 and rid is not null and qid not in (select qid from s1 where ok)), s2 as (select *, count(*) over (partition by rid) = 1 as ok from c2),
 fin as (select * from s1 where ok union all select * from s2), used as (select distinct rid from fin where ok), open as (select * from anc where sample = 1 and anchor_id not in (select qid from fin where ok))"""


def _settle_sql(name: str, source: str, key: str, k: int, before: list[tuple[str, bool]]) -> str:
    """Who gets whom at k, given the steps before (and whether their query anchors are done): CTEs of which the last is ``name`` with key, qid, rid."""
    free = "".join(f" and not exists (select 1 from {x} b where b.{' and b.'.join(f'{c} = x.{c}' for c in key.split(', '))} and (b.rid = x.rid{f' or b.qid = x.qid' if same else ''}))" for x, same in before)
    return f""" {name}_o as (select * from {source} x where k = {k}{free}),
 {name}_p as (select {key}, qid, case when bool_or(exact) then list(distinct rid) filter (exact) else list(distinct rid) end as pool from {name}_o group by {key}, qid),
 {name} as (select {key}, min(qid) as qid, {k}::int as k, pool[1] as rid from {name}_p where len(pool) = 1 group by {key}, pool[1] having count(*) = 1)"""


#: Candidates in ranges rng (key, strand, chrom, rf, rt, qf, qt) of placed query anchors qa (with strand) and reference anchors: exact ones, and those with one symbol changed.
def _candidates_sql(key: str) -> str:
    k = ", ".join(f"g.{c}" for c in key.split(", "))
    same = " and ".join(f"q.{c} = r.{c}" for c in key.split(", "))
    return f"""qin as (select {k}, c.k, c.gid, q.anchor_id as qid, case when q.strand = '-' then c.r else c.l end as l, case when q.strand = '-' then c.l else c.r end as r
  from rng g join qa q on q.chrom = g.chrom and q.strand = g.strand and q.center > qf and q.center < qt join ctx c on c.anchor_id = q.anchor_id and c.sample = 1),
 rin as (select {k}, c.k, c.gid, a.anchor_id as rid, l, r from rng g join anc a on a.sample = 0 and a.chrom = g.chrom and a.center > rf and a.center < rt join ctx c on c.anchor_id = a.anchor_id and c.sample = 0),
 cnd as (select {k.replace('g.', 'q.')}, qid, q.k, r.rid, ix.rid is not null as exact from qin q join rin r on {same} and q.k = r.k and q.gid = r.gid left join ix on ix.gid = q.gid and ix.k = q.k and ix.l = q.l and ix.r = q.r and ix.rid = r.rid
  where r.rid not in (select rid from used) and list_sum(list_transform(list_zip(string_split(q.l || ',' || q.r, ','), string_split(r.l || ',' || r.r, ',')), lambda z: (z[1] <> z[2])::int)) <= 1)"""


def _pass_one(spark, sf_dir):
    """Query anchors that are not assigned yet, reference anchors, and assigned pairs."""
    q, r = (cut(df, "signed") for df in _signed(spark, sf_dir))
    index = matching.unique_index(r, [1, 2])
    choices = matching.arbitrate(matching.exact_hits(q, index, [1, 2]), matching.exact_hits(q, index, [1, 2], invert=True))
    done = matching.assign(q, choices, [1, 2])
    pairs = done.where("status = 'assign'").select("qid", "rid")
    return q.join(pairs.select(F.col("qid").alias("anchor_id")), "anchor_id", "left_anti"), r, pairs


def _days(spark, sf_dir, first: int):
    """Ranges of 1,000 minutes, one in each 10,000, as bundles of each contig."""
    c = F.col
    at = sub.anchors(spark, sf_dir).select("chrom").distinct().withColumn("chain", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    start = (c("chain") * 10_000 + first).cast("double")
    return at.select("chrom", "chain", start.alias("ref_start"), (start + 1000).alias("ref_end"), start.alias("qry_start"), (start + 1000).alias("qry_end"), F.lit(1.0).alias("slope_med"))


@query(
    f"""with {ASSIGNED}, qa as (select *, '+' as strand from open), rng as (select '+' as strand, chrom, gap::bigint as gap, 10000.0 * gap - 9000 as rf, 10000.0 * gap as rt, 10000.0 * gap - 9000 as qf, 10000.0 * gap as qt from (select distinct chrom from anc), range(1, 5) t(gap)),
 {_candidates_sql('chrom, gap')}, {_settle_sql('g1', 'cnd', 'chrom, gap', 1, [])}, {_settle_sql('g2', 'cnd', 'chrom, gap', 2, [('g1', True)])}
 select chrom, gap, qid, k, rid from g1 union all select chrom, gap, qid, k, rid from g2"""
)
def gap_refine(spark, sf_dir):
    q, r, pairs = _pass_one(spark, sf_dir)
    gaps = matching.refine_gaps(q, r, _days(spark, sf_dir, 0), pairs, [1, 2], bound=1)
    return gaps.select("chrom", (F.col("gap") - 1).alias("gap"), "qid", "k", "rid")


# --- windows around bundles ----------------------------------------------------------------------------------------

_KEY = "chrom, strand, seed"
_STEPS = [("a1", 1, 1000), ("a2", 2, 1000), ("b1", 1, 1900), ("b2", 2, 1900)]


def _around_steps() -> str:
    out, before = [], []
    for name, k, window in _STEPS:
        # a query anchor waits within its window only; a reference anchor that is taken stays so
        seen = [(x, w == window) for x, _, w in before]
        out.append(f" {name}_w as (select * from cnd where win = {window})," + _settle_sql(name, f"{name}_w", _KEY, k, seen))
        before.append((name, k, window))
    return ",".join(out)


_AROUND_CHAIN = """o as (select *, row_number() over (partition by chrom, strand, seed order by r, q, rid) as i from (select chrom, strand, seed, r, q, rid, qid from new_at union all select chrom, strand, seed, r, q, rid, qid from old_at)),
 st(chrom, strand, seed, i, r, q, rid, qid, lr, lq, skip, chain, kept) as (select chrom, strand, seed, i, r, q, rid, qid, r, q, 0, 0, true from o where i = 1 union all
  select o.chrom, o.strand, o.seed, o.i, o.r, o.q, o.rid, o.qid, case when ok or st.skip >= 5 then o.r else st.lr end, case when ok or st.skip >= 5 then o.q else st.lq end, case when ok or st.skip >= 5 then 0 else st.skip + 1 end, case when not ok and st.skip >= 5 then st.chain + 1 else st.chain end, ok or st.skip >= 5
  from st join o on o.chrom = st.chrom and o.strand = st.strand and o.seed = st.seed and o.i = st.i + 1, lateral (select o.r - st.lr > 0 and o.r - st.lr <= 20000 * (st.skip + 1) and abs(o.q - st.lq) <= 20000 * (st.skip + 1) and (o.q - st.lq) / (o.r - st.lr) between 0.1 and 10 as ok) t)"""


@query(
    f"""with recursive {ASSIGNED}, qa as (select sample, chrom, anchor_id, gid, '+' as strand, center from open union all select sample, chrom, anchor_id, gid, '-', 43200 - center from open),
 seeds as (select case when f = 0 then '+' else '-' end as strand, chrom, seed::bigint as seed, 10000.0 * seed + f as s, 10000.0 * seed + f + 1000 as e from (select distinct chrom from anc), range(0, 5) t(seed), (values (0), (5000)) u(f)),
 rng as (select strand, chrom, seed, w as win, s - w as rf, e + w as rt, s - w as qf, e + w as qt from seeds, (values (1000), (1900)) t(w)), {_candidates_sql('chrom, strand, seed, win')}, {_around_steps()},
 new as (select distinct chrom, strand, seed, qid, rid from (select * from a1 union all select * from a2 union all select * from b1 union all select * from b2)),
 new_at as (select n.chrom, n.strand, seed, a.center as r, q.center as q, rid, qid from new n join anc a on a.anchor_id = rid join qa q on q.anchor_id = qid and q.strand = n.strand),
 lk as (select a.chrom, st.strand, a.center as r, case when st.strand = '-' then 43200 - b.center else b.center end as q, rid, qid from fin join anc a on a.anchor_id = rid join anc b on b.anchor_id = qid and b.chrom = a.chrom, (values ('+'), ('-')) st(strand) where ok),
 old_at as (select l.chrom, l.strand, s.seed, r, q, rid, qid from lk l join seeds s on s.chrom = l.chrom and s.strand = l.strand and r between s - 1900 and e + 1900 and q between s - 1900 and e + 1900 where (s.chrom, s.strand, s.seed) in (select (chrom, strand, seed) from new)),
 {_AROUND_CHAIN},
 d as (select *, r - lag(r) over w as dr, q - lag(q) over w as dq from st where kept window w as (partition by chrom, strand, seed, chain order by r, q, rid)),
 bs as (select chrom, strand, seed, chain, median(dq / dr) filter (dr > 0) as slope, min(r) as r0, max(r) as r1, count(*) as n from d group by chrom, strand, seed, chain),
 fit as (select b.* from bs b join seeds s using (chrom, strand, seed) where n >= 2 and abs(slope - 1) <= 0.8 and r1 >= s - 500 and e + 500 >= r0)
 select distinct d.chrom, d.qid, d.rid from d join fit using (chrom, strand, seed, chain) join new n on n.chrom = d.chrom and n.strand = d.strand and n.seed = d.seed and n.qid = d.qid and n.rid = d.rid"""
)
def around_refine(spark, sf_dir):
    c = F.col
    q, r, pairs = _pass_one(spark, sf_dir)
    bundles = _days(spark, sf_dir, 0).withColumn("strand", F.lit("+")).unionByName(_days(spark, sf_dir, 5000).withColumn("strand", F.lit("-")))
    both = lambda df, at: df.withColumn("strand", F.explode(F.array(F.lit("+"), F.lit("-")))).withColumn(at, F.when(c("strand") == "-", 43200 - c(at)).otherwise(c(at)))
    anchors = sub.anchors(spark, sf_dir)
    links = pairs.join(anchors.select(c("anchor_id").alias("rid"), "chrom", c("center").alias("ref_center")), "rid").join(anchors.select(c("anchor_id").alias("qid"), "chrom", c("center").alias("qry_center")), ["qid", "chrom"])
    chaining = {"gap_ref": 20_000, "gap_qry": 20_000, "slope": (0.1, 10)}
    return matching.refine_around(both(q, "center"), r, bundles, both(links, "qry_center"), pairs, [1000, 1900], [1, 2], chaining, (2, 0.0), 0.8, 500.0, bound=1)
