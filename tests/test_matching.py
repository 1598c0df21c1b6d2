import random
import time

import numpy as np
import pandas as pd
import pyarrow as pa
from corrspark.operators import chaining, context, matching, uniqueness


def anchors(spark, rows):
    return spark.createDataFrame(rows, "sample int, chrom string, anchor_id long, center double, gid string")


def test_gap_bins_round_half_to_even(spark):
    got = context.order(anchors(spark, [(0, "c", 1, 0.0, "a"), (0, "c", 2, 125.0, "a"), (0, "c", 3, 300.0, "a")]), 50).orderBy("idx").collect()
    assert [r["bin"] for r in got] == [2, 4, None]
    assert context.tokens(context.order(anchors(spark, [(0, "c", i, 10.0 * i, "g") for i in range(5)]), 10)).count() == 9


def test_disjoint_count(spark):
    df = spark.createDataFrame([([(0, 2), (1, 1), (2, 3), (4, 4)],)], "x array<struct<s:int,e:int>>")
    assert df.select(uniqueness.disjoint_count(df.x).alias("n")).first()["n"] == 3


def test_inverted_copy_is_found(spark):
    rng = random.Random(3)
    groups = [rng.choice("abcdef") for _ in range(30)]
    steps = [rng.randrange(1, 9) * 10.0 for _ in range(30)]
    at, ref = 0.0, []
    for i in range(30):
        ref.append((0, "c", i, at, groups[i]))
        at += steps[i]
    qry = [(1, "c", 100 + i, at - c, g) for _, _, i, c, g in ref]
    signed = context.signatures(context.order(anchors(spark, ref + qry), 10), 3).cache()
    from pyspark.sql import functions as F

    q, r = signed.where("sample = 1"), signed.where("sample = 0").withColumn("k_min", F.lit(1))
    index = matching.unique_index(r, [3])
    fwd, inv = matching.exact_hits(q, index, [3]), matching.exact_hits(q, index, [3], invert=True)
    found = matching.assign(q, matching.arbitrate(fwd, inv), [3]).where("status = 'assign'").collect()
    assert len(found) > 15 and all(x["qid"] == x["rid"] + 100 and x["strand"] == "-" for x in found)


def test_rivals_are_tried_again(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "anchor_id long")
    choices = spark.createDataFrame([(1, 1, 9, "token_mum", "+", 1), (2, 1, 9, "token_mum", "+", 1), (1, 2, 9, "token_mum", "+", 1), (2, 2, None, "token_mum", "+", 2)], "qid long, k int, rid long, method string, strand string, n_cand int")
    got = {r["qid"]: (r["status"], r["rid"], r["used_k"]) for r in matching.assign(q, choices, [1, 2]).collect()}
    assert got == {1: ("assign", 9, 2), 2: ("unmatched", None, 0), 3: ("unmatched", None, 0)}


def test_chain_drops_what_is_off_the_line(spark):
    links = spark.createDataFrame([("c", float(r), float(q), r, r) for r, q in ((0, 0), (1, 1), (2, 2), (3, 90), (4, 4))], "chrom string, ref_center double, qry_center double, rid long, qid long")
    kept = chaining.chain(links, ["chrom"], 10, 10, (0.5, 2))
    assert sorted(r["rid"] for r in kept.collect()) == [0, 1, 2, 4]
    stats = chaining.bundle_stats(kept, ["chrom"]).first()
    assert (stats["n_links"], stats["slope_med"], stats["b0_med"], stats["resid_mad"], stats["max_gap_ref"]) == (4, 1.0, 0.0, 0.0, 2.0)


def test_chains_by_segments_are_those_of_one_walk(spark):
    rng = random.Random(11)
    links, want = [], {}
    for key in range(12):
        at, rows = 0.0, []
        for i in range(rng.choice((1, 3, 9, 60))):
            at += rng.choice((0, 1, 3, 3, 3, 10, 12, 90)) if key else 2
            rows.append((at, at * rng.choice((1, 1, 1, 1.4)) + rng.choice((0, 0, 0, 40)), i))
        links += [(f"k{key}", r, q, i, i) for r, q, i in rows]
        last, skipped, number = None, 0, 0
        for r, q, i in sorted(rows):
            if last is not None:
                dr, dq = r - last[0], q - last[1]
                if not (0 < dr <= 4 * (skipped + 1) and abs(dq) <= 9 * (skipped + 1) and 0.5 <= dq / dr <= 2):
                    if skipped < 2:
                        skipped += 1
                        continue
                    number += 1
            last, skipped = (r, q), 0
            want[f"k{key}", i] = number
    df = spark.createDataFrame(links, "chrom string, ref_center double, qry_center double, rid long, qid long")
    got = {(r["chrom"], r["rid"]): r["chain"] for r in chaining.chain(df, ["chrom"], 4, 9, (0.5, 2), max_skip=2).collect()}
    assert got == want and max(want.values()) > 3


def test_parallel_bundles_merge(spark):
    rows = [("c", i, 100.0 * i, 100.0 * i + 50, 100.0 * i, 100.0 * i + 50, 5, s, 0.0, 0.0, 1.0, 1.0, [i], [i], "+") for i, s in enumerate((1.0, 1.01, 2.0))]
    df = spark.createDataFrame(rows, "chrom string, chain long, ref_start double, ref_end double, qry_start double, qry_end double, n_links long, slope_med double, b0_med double, resid_mad double, max_gap_ref double, max_gap_qry double, rids array<long>, qids array<long>, strand string")
    out = chaining.emit(chaining.merge_parallel(df, ["chrom"]), ["chrom"]).orderBy("bundle_id").collect()
    assert [(r["bundle_id"], r["n_links"], r["ref_start"], r["ref_end"]) for r in out] == [("B000001", 10, 0, 150), ("B000002", 5, 200, 250)]


def test_tasks_grow_with_the_anchors(spark, monkeypatch):
    # partitions were coalesced by the weight of the anchors, and each token then became a row for each of its substrings
    from corrspark.operators import context, uniqueness

    monkeypatch.setattr(context, "TASK_ROWS", 20)
    rows = [(0, c, c * 100 + i, float(i * 7), "abc"[(i * i + c) % 3]) for c in range(40) for i in range(5)]
    ordered = context.order(spark.createDataFrame(rows, "sample int, chrom long, anchor_id long, center double, gid string"), 5)
    counts = uniqueness.substring_counts(context.tokens(ordered), 6)
    assert counts.rdd.getNumPartitions() > 200 // 20
    assert sum(r["n"] for r in counts.collect()) == 40 * sum(min(6, 9 - t) for t in range(9))


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def _near_case(spark, bound, signs, monkeypatch):
    from pyspark.sql import functions as F

    if signs:  # symbols share characters
        monkeypatch.setattr(matching, "_sign", lambda s: F.concat(F.lit("000"), F.hex(F.pmod(F.xxhash64(s), F.lit(signs)) + 0x10000)))
        monkeypatch.setattr(matching, "CONTEXT_ROWS", 2)
    rng = random.Random(bound)
    side = lambda k: [(rng.choice("abc"), rng.randrange(2)) for _ in range(k)]
    rows = [(i % 2, "c", i, "g" if i % 5 else "h", side(k), side(k), k, 1) for i in range(160) for k in [rng.choice((1, 2, 3, 4))]]
    rows += [(s, c, i + 1000, *x) for s, c, i, *x in rows[:40]]
    signed = spark.createDataFrame(rows, "sample int, chrom string, anchor_id long, gid string, left array<struct<g:string,b:int>>, right array<struct<g:string,b:int>>, k_max int, k_min int")
    ks = [1, 2, 3, 4]
    got = [(r["qid"], r["k"], r["rid"]) for r in matching.near_hits(signed.where("sample = 1"), signed.where("sample = 0"), ks, bound).collect()]
    want = {(q[2], k, r[2]) for q in rows for r in rows for k in ks if q[0] == 1 and r[0] == 0 and q[3] == r[3] and min(q[6], r[6]) >= k and _edits(q[4][:k], r[4][:k]) + _edits(q[5][:k], r[5][:k]) <= bound}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_near_hits_are_those_of_all_pairs(spark, monkeypatch):
    for bound in (1, 4):
        _near_case(spark, bound, 0, monkeypatch)


def test_near_hits_where_symbols_share_characters(spark, monkeypatch):
    _near_case(spark, 3, 3, monkeypatch)


def test_measuring_does_not_carry_symbols(spark):
    """Contexts that meet carry a text for each side, and no distance is made of arrays but for shared characters."""
    sym = "array<struct<g:string,b:int>>"
    q = spark.createDataFrame([("g", 2, [("a", 1), ("b", 2)], [("a", 1), ("b", 1)], [7])], f"gid string, k int, ql {sym}, qr {sym}, qids array<long>")
    r = spark.createDataFrame([("g", 2, [("a", 1), ("b", 2)], [("a", 1), ("b", 3)], [8])], f"gid string, k int, rl {sym}, rr {sym}, rids array<long>")
    got = matching._close_pairs(q, r, ["gid"], 1)
    assert got.columns == ["gid", "k", "qids", "rids"] and [tuple(x) for x in got.collect()] == [("g", 2, [7], [8])]


def test_medians_of_a_long_chain(spark):
    """Medians that stand in a lambda are evaluated once, not for each link."""
    rng = np.random.default_rng(4)
    r = np.cumsum(rng.integers(1, 9, 20_000)).astype(float)
    q = r + rng.integers(-500, 500, len(r)) / 10
    rows = spark.createDataFrame(pd.DataFrame({"c": "x", "chain": 0, "ref_center": r, "qry_center": q, "rid": range(len(r)), "qid": range(len(r))}))
    began = time.time()
    (alone,) = chaining.bundle_stats(rows, ["c"]).select("resid_mad").collect()
    took = time.time() - began
    (got,) = chaining.bundle_stats(rows, ["c"]).select("n_links", "slope_med", "b0_med", "resid_mad").collect()
    slope = np.median(np.diff(q) / np.diff(r))
    b0 = np.median(q - slope * r)
    resid = q - (slope * r + b0)
    assert got["n_links"] == len(r) and (got["slope_med"], got["b0_med"], got["resid_mad"]) == (slope, b0, alone["resid_mad"]) and alone["resid_mad"] == np.median(np.abs(resid - np.median(resid)))
    assert took < 30


def test_many_short_keys_are_chained_in_one_stream(spark):
    n = 40_000
    links = spark.range(2 * n).selectExpr("id div 2 as key", "cast(id % 2 as double) as ref_center", "cast(id % 2 as double) as qry_center", "id as rid", "id as qid")
    began = time.time()
    got = chaining.chain(links, ["key"], 10, 10, (0.5, 2)).groupBy("chain").count().collect()
    assert [tuple(x) for x in got] == [(0, 2 * n)]
    assert time.time() - began < 30


def test_chains_do_not_depend_on_batches(spark):
    rng = random.Random(5)
    links = spark.createDataFrame([(k, float(rng.randrange(0, 900)), float(rng.randrange(0, 900)), i, i) for k in "ab" for i in range(300)], "key string, ref_center double, qry_center double, rid long, qid long")
    run = lambda: sorted(map(tuple, chaining.chain(links, ["key"], 1, 200, (0.1, 9), max_skip=1).collect()))
    want = run()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert run() == want and len(want) > 100
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_islands_do_not_depend_on_batches():
    rng = random.Random(6)
    rows = sorted((i, t, w, k, rng.randrange(9), rng.randrange(9), rng.random() < 0.3) for i in range(4) for t in (1, 2) for w in (5.0, 9.0) for k in (1, 2) for _ in range(rng.randrange(1, 8)))
    table = pa.table({c: list(v) for c, v in zip(["island", "turn", "window", "k", "qid", "rid", "exact"], zip(*rows, strict=True), strict=True)})
    table = table.append_column("_first", pa.array([i == 0 or rows[i][0] != rows[i - 1][0] for i in range(len(rows))]))
    found = [[x for b in matching._around(iter(table.to_batches(size)), ["island", "turn", "qid", "rid"]) for x in b.to_pylist()] for size in (1, 3, len(rows))]
    assert found[0] == found[1] == found[2] and len(found[0]) > 8


def test_choices_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(q, k, q % 7 if k == 1 else q, "token_mum", "+", 1) for q in range(20) for k in (1, 2)]
    choices = spark.createDataFrame(rows, "qid long, k int, rid long, method string, strand string, n_cand int")
    got = matching.assign(spark.range(20).withColumnRenamed("id", "anchor_id"), choices.mapInArrow(counted, choices.schema), [1, 2]).collect()
    assert all(x["status"] == "assign" and x["rid"] == x["qid"] for x in got)
    assert seen.value == len(rows)


def test_least_contexts_count_all_substrings_of_the_window(spark, tmp_path):
    from datetime import datetime, timedelta

    import __spark_entry__ as entry

    rng = random.Random(5)
    groups = [[rng.choice("ab") for _ in range(n)] for n in (40, 70)]
    # contig c, groups half a day apart: all gap bins are 1
    rows = [(1000 * c + i, datetime(2024, 1, 1) + timedelta(hours=12 * i), 2 * c, g) for c, own in enumerate(groups) for i, g in enumerate(own)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")

    def least(own, longest):
        tokens = [x for g in own for x in (g, "1")][:-1]
        count = lambda a: sum(tokens[i : i + len(a)] == a for i in range(len(tokens) - len(a) + 1))
        for i in range(len(own)):
            fits = lambda k: any(count(tokens[s : s + n]) == 1 for s in range(2 * i - 2 * k, 2 * i + 2 * k + 1) for n in range(1, min(longest, 2 * i + 2 * k + 1 - s) + 1))
            yield next((k for k in (1, 2, 3) if 2 * i >= 2 * k and 2 * i + 2 * k < len(tokens) and fits(k)), 0)

    got = {(r["chrom"], r["anchor_id"]): r["k_min"] for r in entry.queries()["ref_min_k"](spark, str(tmp_path)).collect()}
    want, cut_at_6 = ({(c, 1000 * c + i): k for c, own in enumerate(groups) for i, k in enumerate(least(own, n))} for n in (13, 6))
    assert got == want != cut_at_6


def test_pairs_of_a_hot_context_are_dealt_out(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(matching, "CONTEXT_ROWS", 16)
    monkeypatch.setattr(matching, "PAIR_ROWS", 1 << 11, raising=False)
    # anchors 0 to 199 of each sample share one context, the last two have contexts of their own, one of them near it
    side = lambda i: [("a", 1), ("c" if i == 200 else "b" if i < 200 else "d", 2 if i < 201 else 9)]
    rows = [(s, "x", 1000 * s + i, "g", side(i), [("a", 1), ("a", 7 if i > 200 else 1)], 2, 1) for s in (0, 1) for i in range(202)]
    signed = spark.createDataFrame(rows, "sample int, chrom string, anchor_id long, gid string, left array<struct<g:string,b:int>>, right array<struct<g:string,b:int>>, k_max int, k_min int")
    q, r = signed.where("sample = 1").drop("k_min"), signed.where("sample = 0")
    found = matching.near_hits(q, r, [2], 1).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((x["qid"], x["rid"]) for x in found) == sorted([(1000 + i, j) for i in range(201) for j in range(201)] + [(1201, 201)])
    tasks = {}
    for x in found:
        tasks[x["task"]] = tasks.get(x["task"], 0) + 1
    assert len(tasks) > 10 and max(tasks.values()) < 6000
