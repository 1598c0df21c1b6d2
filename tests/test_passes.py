"""The later passes against a plain walk through ranges, seeds, windows and contexts."""

import random

import pytest
from corrspark.operators import chaining, context, matching
from pyspark.sql import functions as F

BOUND, KS = 1, [1, 2]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def signed(spark):
    rng = random.Random(8)
    rows = [(s, c, f"{s}{c}{i}", float(rng.randrange(0, 4000)), rng.choice("ab")) for s in (0, 1) for c in "xy" for i in range(90)]
    df = spark.createDataFrame(rows, "sample int, chrom string, anchor_id string, center double, gid string")
    found = context.signatures(context.order(df, 100), 2)
    return spark.createDataFrame(found.collect(), found.schema)


def plain(rows):
    out = {}
    for r in rows:
        side = lambda xs: [(x["g"], x["b"]) for x in xs]
        out[r["anchor_id"]] = {"chrom": r["chrom"], "center": r["center"], "gid": r["gid"], "l": side(r["left"]), "r": side(r["right"]), "k_max": r["k_max"]}
    return out


def step(q, r, open_q, refs, k, taken, index, invert):
    """(qid, rid) that are settled at one k."""
    wants = {}
    for i in open_q:
        a = q[i]
        if a["k_max"] < k:
            continue
        left, right = (a["r"], a["l"]) if invert else (a["l"], a["r"])
        key = (a["gid"], k, tuple(left[:k]), tuple(right[:k]))
        exact = index.get(key)
        pool = [exact] if exact in refs and exact not in taken else []
        if not pool:
            pool = [j for j in refs if j not in taken and r[j]["gid"] == a["gid"] and r[j]["k_max"] >= k and distance(left[:k], r[j]["l"][:k]) + distance(right[:k], r[j]["r"][:k]) <= BOUND]
        if len(pool) == 1:
            wants.setdefault(pool[0], []).append(i)
    return [(v[0], j) for j, v in wants.items() if len(v) == 1]


def unique(r):
    seen = {}
    for j, a in r.items():
        for k in KS:
            if a["k_max"] >= k:
                seen.setdefault((a["gid"], k, tuple(a["l"][:k]), tuple(a["r"][:k])), []).append(j)
    return {k: v[0] for k, v in seen.items() if len(v) == 1}


def test_gaps(spark, signed):
    q, r = signed.where("sample = 1"), signed.where("sample = 0").withColumn("k_min", F.lit(1))
    spans = [(c, i, 1000.0 * i, 1000.0 * i + 150, 900.0 * i, 900.0 * i + 200) for c in "xy" for i in range(4)] + [("x", 9, 50.0, 60.0, 10.0, 20.0)]
    bundles = spark.createDataFrame(spans, "chrom string, chain long, ref_start double, ref_end double, qry_start double, qry_end double")
    used = spark.createDataFrame([("0x3",), ("0y4",)], "rid string")
    for invert in (False, True):
        got = {tuple(x) for x in matching.refine_gaps(q, r, bundles, used, KS, invert, BOUND).select("chrom", "qid", "rid").collect()}
        pq, pr = plain(q.collect()), plain(r.collect())
        index, want = unique(pr), set()
        for c in "xy":
            own = sorted(b for b in spans if b[0] == c)
            own.sort(key=lambda b: (b[2], b[1]))
            for before, after in zip(own, own[1:]):
                if before[3] >= after[2] or before[5] >= after[4]:
                    continue
                open_q = {i for i, a in pq.items() if a["chrom"] == c and before[5] < a["center"] < after[4]}
                refs, taken = {j for j, a in pr.items() if a["chrom"] == c and before[3] < a["center"] < after[2]} - {"0x3", "0y4"}, set()
                for k in KS:
                    new = step(pq, pr, open_q, refs, k, taken, index, invert)
                    want |= {(c, i, j) for i, j in new}
                    taken |= {j for _, j in new}
                    open_q -= {i for i, _ in new}
        assert got == want and len(want) > 10


@pytest.mark.parametrize("rows_of_an_island", [10**6, 0])
def test_around(spark, signed, monkeypatch, rows_of_an_island):
    monkeypatch.setattr(matching, "ISLAND_ROWS", rows_of_an_island)
    size, windows = 4000.0, [100.0, 400.0]
    q, r = signed.where("sample = 1"), signed.where("sample = 0").withColumn("k_min", F.lit(1))
    seeds = [(c, s, i, 700.0 * i + 60 * (s == "-"), 700.0 * i + 250, 700.0 * i, 700.0 * i + 200, 1.0) for c in "xy" for s in "+-" for i in range(5)]
    bundles = spark.createDataFrame(seeds, "chrom string, strand string, chain long, ref_start double, ref_end double, qry_start double, qry_end double, slope_med double")
    both = q.withColumn("strand", F.explode(F.array(F.lit("+"), F.lit("-")))).withColumn("center", F.when(F.col("strand") == "-", size - F.col("center")).otherwise(F.col("center")))
    rng = random.Random(3)
    old = [(c, s, float(x), float(x + rng.randrange(-20, 20)), f"o{c}{s}{x}", f"p{c}{s}{x}") for c in "xy" for s in "+-" for x in range(0, 4000, 170)]
    links = spark.createDataFrame(old, "chrom string, strand string, ref_center double, qry_center double, rid string, qid string")
    used = spark.createDataFrame([("0x7",)], "rid string")
    limits = {"gap_ref": 800.0, "gap_qry": 800.0, "slope": (0.3, 3.0)}
    got = {tuple(x) for x in matching.refine_around(both, r, bundles, links, used, windows, KS, limits, (3, 50.0), 0.5, 30.0, BOUND).collect()}

    pq, pr = plain(q.collect()), plain(r.collect())
    index, want = unique(pr), set()
    for c in "xy":
        taken = {"0x7"}
        for _, s, i, r0, r1, q0, q1, slope in sorted((x for x in seeds if x[0] == c), key=lambda x: (x[1], x[3])):
            at = {k: (size - a["center"] if s == "-" else a["center"]) for k, a in pq.items()}
            new = []
            for w in windows:
                open_q = {k for k, a in pq.items() if a["chrom"] == c and q0 - w < at[k] < q1 + w}
                refs = {j for j, a in pr.items() if a["chrom"] == c and r0 - w < a["center"] < r1 + w}
                for k in KS:
                    found = step(pq, pr, open_q, refs, k, taken, index, s == "-")
                    new += found
                    taken |= {j for _, j in found}
                    open_q -= {x for x, _ in found}
            if not new:
                continue
            w = max(windows)
            rows = [(pr[j]["center"], at[k], j, k) for k, j in set(new)] + [(a, b, x, y) for cc, ss, a, b, x, y in old if (cc, ss) == (c, s) and r0 - w <= a <= r1 + w and q0 - w <= b <= q1 + w]
            frame = spark.createDataFrame([("k", *x) for x in rows], "by string, ref_center double, qry_center double, rid string, qid string")
            stats = chaining.bundle_stats(chaining.chain(frame, ["by"], **limits), ["by"], 3, 50.0).collect()
            kept = {p for b in stats if b["slope_med"] is not None and abs(b["slope_med"] - slope) <= 0.5 and b["ref_end"] >= r0 - 30 and r1 + 30 >= b["ref_start"] for p in zip(b["qids"], b["rids"])}
            want |= {(c, k, j) for k, j in new if (k, j) in kept}
    assert got == want and len(want) > 5


@pytest.mark.parametrize("bound", [0, 1, 2, 3, 4])
def test_near_pairs_of_any_bound(spark, bound):
    rng = random.Random(bound)
    symbols = "abcd"
    make = lambda n: [(rng.choice("gh"), 4, [rng.choice(symbols) for _ in range(4)], [rng.choice(symbols) for _ in range(4)]) for _ in range(n)]
    q, r = make(120), make(120)
    schema = "gid string, k int, {0}l array<string>, {0}r array<string>"
    got = matching.near_pairs(spark.createDataFrame(q, schema.format("q")).distinct(), spark.createDataFrame(r, schema.format("r")).distinct(), ["gid"], bound)
    want = {(g, tuple(a), tuple(b), tuple(c), tuple(d)) for g, _, a, b in q for h, _, c, d in r if g == h and distance(a, c) + distance(b, d) <= bound}
    rows = [(x["gid"], tuple(x["ql"]), tuple(x["qr"]), tuple(x["rl"]), tuple(x["rr"])) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and (bound < 2 or want)


def test_near_pairs_whose_symbols_share_characters(spark, monkeypatch):
    monkeypatch.setattr(matching, "_sign", lambda s: F.concat(F.lit("000"), F.hex(F.pmod(F.xxhash64(s), F.lit(2)) + 0x10000)))
    rng = random.Random(7)
    make = lambda n: [("g", 3, [rng.choice("abcd") for _ in range(3)], [rng.choice("abcd") for _ in range(3)]) for _ in range(n)]
    q, r = make(60), make(60)
    schema = "gid string, k int, {0}l array<string>, {0}r array<string>"
    got = matching.near_pairs(spark.createDataFrame(q, schema.format("q")).distinct(), spark.createDataFrame(r, schema.format("r")).distinct(), ["gid"], 2)
    want = {(tuple(a), tuple(b), tuple(c), tuple(d)) for _, _, a, b in q for _, _, c, d in r if distance(a, c) + distance(b, d) <= 2}
    rows = [(tuple(x["ql"]), tuple(x["qr"]), tuple(x["rl"]), tuple(x["rr"])) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 5
