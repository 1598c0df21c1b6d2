"""Hard-negative mining against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from corrspark.llm import negatives
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("length", T.StringType()), T.StructField("v", T.LongType())]
)


def brute(rows, m):
    """rows: (vec_id, embedding, label) -> Counter of result rows."""
    good = []
    for i, x, label in rows:
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        label = (label + 1) % m.classes if i % m.relabel == 0 else label
        good.append((i, label, tuple(math.floor(m.scale * float(np.float32(c))) for c in x)))
    out = Counter()
    for i, label, x in {r for r in good if r[0] % m.anchors == 0}:
        scored = [(-max(1 - 2**63, min(2**63 - 1, sum(a * b for a, b in zip(x, y)))), j, other) for j, other, y in good if j != i]
        positives = sorted((s, j) for s, j, other in scored if other == label)[: m.positives]
        for s, j in positives:
            fit = sorted((t, k) for t, k, other in scored if other != label and m.low * -s <= 100 * -t <= m.high * -s)[: m.negatives]
            out.update((i, j, rank, k, -s, -t) for rank, (t, k) in enumerate(fit, 1))
    return out


def clustered(seed, n, width=12, spread=0.15):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, width)) * rng.choice([0.3, 1, 3], 12)[:, None]
    at = rng.integers(0, 12, n)
    x = (centers[at] + rng.normal(size=(n, width)) * spread).astype(np.float32)
    labels = np.where(rng.random(n) < 0.7, at % 10, rng.integers(0, 10, n))
    return [(i, v, int(c)) for i, v, c in zip(range(n), x.tolist(), labels)]


def mined(spark, rows, m):
    return Counter(tuple(r) for r in negatives.mine(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), m).collect())


@pytest.mark.parametrize("m", [negatives.Mining(anchors=5, bucket=16, tile_buckets=2, tile_anchors=20), negatives.Mining(anchors=9, bucket=50, focus=2)])
def test_against_brute_force(spark, m):
    rows = clustered(3, 500)
    random.Random(1).shuffle(rows)
    want = brute(rows, m)
    assert len(want) > 300 and mined(spark, rows, m) == want


def test_awkward_rows(spark):
    rows = clustered(4, 120, 4)
    hot = [(1000 + i, [1.0, 0.5, 0.25, 0.0], i % 3) for i in range(90)]
    odd = [(200, None, 1), (201, [1.0, None, 0.0, 0.0], 1), (202, [float("nan")] * 4, 2), (203, [float("inf"), 0.0, 0.0, 0.0], 2), (204, [1.0] * 4, None), (None, [1.0] * 4, 1)]
    odd += [(205, [0.0] * 4, 1), (210, [0.0] * 4, 1), (211, [], 1), (215, [2.0, 1.0], 1), (220, [1.0, 1.0, 1.0, 1.0, 1.0, 1.0], 1), (225, [-0.001] * 4, -3), (0, rows[0][1], rows[0][2]), (5, [0.1, 0.2, 0.3, 0.4], 7)]
    rows = rows + hot + odd + rows[:3] + hot[:2]
    m = negatives.Mining(anchors=5, bucket=8, tile_buckets=3, tile_anchors=7)
    want = brute(rows, m)
    assert want and mined(spark, rows, m) == want


def test_products_beyond_doubles(spark):
    big = [(i, [3e8 * (1 + i % 7), 1.0 + i, 2.0e7], i % 2) for i in range(30)]
    m = negatives.Mining(anchors=5)
    big += [(40 + i, [4e6 * (1 + i % 3), 5.0, 1e7 / (1 + i)], i % 2) for i in range(20)]
    want = brute(big, m)
    assert want and mined(spark, big, m) == want


def test_candidates_hold_all_and_prune():
    rows = clustered(5, 400, 8, 0.05)
    x = np.array([v for _, v, _ in rows])
    x = np.floor(5000 * x / np.sqrt((x * x).sum(1, keepdims=True)))  # of like length, as in a bucket
    bucket = negatives.Bucket(1, np.arange(400), x)
    anchors, lengths = x[:60], bucket.lengths[:60]
    scores = anchors @ x.T
    least = np.sort(scores, axis=1)[:, -6]
    keep = least > 0
    found = bucket.candidates(anchors[keep], lengths[keep], least[keep], 4)
    pruned = 0
    for rows_, s, low in zip(found, scores[keep], least[keep]):
        if rows_ is not None:
            assert set(np.flatnonzero(s >= low)) <= set(rows_.tolist())
            pruned += len(rows_) < 200
    assert pruned > 20


def test_nothing(spark):
    assert mined(spark, [], negatives.Mining()) == Counter()
    assert mined(spark, [(1, [1.0], 1), (50, [1.0], 2)], negatives.Mining()) == Counter()
    assert negatives.mine(spark.createDataFrame([], SCHEMA)).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
