"""Ranked lexical search against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from helpers import corpus, empty, frame
from corrspark.llm import balltree

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=20):
    parts = [(d, Counter(t), len(t)) for d, t in ((d, split(x)) for d, x in docs) if t]
    n, total = len(parts), sum(k for *_, k in parts)
    df = Counter(t for _, c, _ in parts for t in c)
    out = Counter()
    for item, text in items:
        scored = []
        for d, c, k in parts:
            m = 75 + 25 * k * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in split(text) if t in c)
            if s > 0:
                scored.append((-s, d is not None, d or 0, d))
        out.update((item, rank, x[-1], -x[0]) for rank, x in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1))
    return out


def items_of(rows):
    texts = [t for _, t in rows if t]
    return [(i, (texts[i * 3] + " " + texts[i + 5])[: 40 + 60 * i]) for i in range(12)] + [(3, texts[0][:80]), (50, None), (51, ""), (52, "!?"), (53, "nowhere abcabcabc"), (54, texts[1] + " " + texts[1]), (None, texts[2])]


@pytest.mark.parametrize("r", [balltree.Ranking(), balltree.Ranking(tree_documents=13, leaf=2), balltree.Ranking(leaf=3, item_bytes=600, tree_terms=300), balltree.Ranking(cells=50)])
def test_against_brute_force(spark, r):
    rows = corpus(31)
    items = items_of(rows)
    got = balltree.rank(frame(spark, rows), spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id int"), r)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(x) for x in got.collect()) == brute(rows, items)


def test_ties_take_the_smallest_ids(spark):
    docs = [(i, "red green blue") for i in range(400, 0, -1)] + [(1000, "grey " * 9)]
    got = balltree.rank(frame(spark, docs), spark.createDataFrame([(1, "green")], "item_id long, text string"), balltree.Ranking(tree_documents=50, leaf=4)).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, 21))


def test_terms():
    for text in ("", "A-b_c 9é", "\x00x\x7fy", "Ünïcode–dash «q» 日本", "a" * 50, "ÀÉ Straße İ"):
        assert [t.decode() for t in balltree.terms(text.encode())] == split(text)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    topics = [np.sort(rng.choice(300, 25, replace=False)) for _ in range(12)]
    usual = rng.integers(200_000, 900_000, 25)
    ends, at, values = [], [], []
    for i in range(600):
        there = rng.random(25) < 0.97
        own = topics[i % 12][there]
        at.append(own)
        values.append((usual[there] * rng.uniform(0.95, 1.05, len(own))).astype(np.int64))
        ends.append((ends[-1] if ends else 0) + len(own))
    scale = np.sqrt(rng.integers(1, 9000, 300).astype(float))
    tree = balltree.Tree(np.array(ends), np.concatenate(at), np.concatenate(values), scale, 8, 10**6)
    assert sorted(np.concatenate([d for d, *_ in tree.leaves.values()]).tolist()) == list(range(600))
    seen = 0
    for k in range(12):
        q = np.sort(topics[k][:10])
        w = rng.integers(1, 9000, 10)
        scores = np.array([sum(int(v) * int(w[q == t][0]) for t, v in zip(a, x) if t in q) for a, x in zip(at, values)])
        bounds = tree.bounds(np.searchsorted(tree.active, q), w.astype(float))
        for node, (docs, *_) in tree.leaves.items():
            assert bounds[node] >= scores[docs].max()
        best = balltree.Best(5)
        seen += tree.search(q, w, best.least, lambda d, s: best.take(s, d, np.zeros(len(d), bool)))
        assert best.scores.tolist() == sorted(scores.tolist(), reverse=True)[:5]
    assert seen < 12 * len(tree.leaves) * 0.6


def test_nothing(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert balltree.rank(empty(spark), items).count() == 0
    assert balltree.rank(frame(spark, [(1, None), (2, "")]), items).count() == 0
    assert balltree.rank(frame(spark, corpus(1)), items.limit(0)).count() == 0
