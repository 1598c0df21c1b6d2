import random

import pytest
from helpers import corpus, empty, frame
from corrspark.llm.neardup import NearRules, keep_one, near_groups


def shingles(text, k):
    words = ("".join(c.lower() if c < "\x80" else c for c in text or "")).encode().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) or frozenset([tuple(words)])


def brute(rows, k, percent):
    """component_id of each row by comparing all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                up[root(i)] = root(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(doc)
    return [(doc, len(sets[i]), min((x for x in ids[root(i)] if x is not None), default=None)) for i, (doc, _) in enumerate(rows)]


def near_copies(seed, n, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = [(1000, " ".join(base))]
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(1, edits)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(100000)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("rules,rows", [(NearRules(shingle=3, percent=85), corpus(2)), (NearRules(), corpus(3) + near_copies(5, 30, 6)), (NearRules(shingle=3, percent=85, block=16), near_copies(7, 60, 9))])
def test_matches_brute_force(spark, rules, rows):
    got = near_groups(frame(spark, rows), rules).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(brute(rows, rules.shingle, rules.percent), key=key)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def chains_and_stars(seed, originals, steps, rays):
    """Around several originals of one group, chains and stars whose members have one link each to what is before them."""
    rng = random.Random(seed)
    fresh = iter(range(10**6))
    base = [f"w{i}" for i in range(150)]
    rows, ids = [], iter(rng.sample(range(10**6), 10**4))

    def changed(words, at):
        """8 neighbouring words are others: 87 % are left of 148 shingles of 3, and after another such step 76 %."""
        return words[:at] + [f"x{next(fresh)}" for _ in range(8)] + words[at + 8 :]

    for k in range(originals):
        base = changed(base, 12 * (k % 12))
        rows.append((next(ids), " ".join(base)))
        for _ in range(rays):
            rows.append((next(ids), " ".join(changed(base, 12 * rng.randrange(12)))))
        now = base
        for at in rng.sample(range(12), steps):
            now = changed(now, 12 * at)
            rows.append((next(ids), " ".join(now)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [4, 16, 40])
def test_no_link_is_lost_among_blocks(spark, block):
    rules, rows = NearRules(shingle=3, percent=85, block=block), chains_and_stars(3, 6, 8, 4)
    want = brute(rows, 3, 85)
    assert len({c for _, _, c in want}) == 1
    got = near_groups(frame(spark, rows), rules).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(want)


def test_one_of_each_group_stays(spark):
    rows = corpus(4)
    docs = frame(spark, rows)
    out = keep_one(docs)
    assert out.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    groups = brute(rows, 5, 80)
    worded = {c for _, n, c in groups if n}
    assert sorted(i for i, t in kept if shingles(t, 5)) == sorted(worded)
    assert sum(not shingles(t, 5) for _, t in kept) == sum(n == 0 for _, n, _ in groups)


def test_ids_do_not_make_duplicates(spark):
    """Rows that share an id but no text both stay, and extra columns may have any name."""
    line = lambda k: " ".join(f"w{k}_{i}" for i in range(40))
    rows = [(None, line(1)), (None, line(2)), (2, line(3)), (2, line(4)), (2, line(4)), (3, line(4)), (4, ""), (4, ""), (5, None)]
    docs = frame(spark, rows).selectExpr("*", "'a' as _id", "'b' as _hash", "'c' as root", "'d' as row")
    out = keep_one(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == sorted((i or 0, t or "") for i, t in [*rows[:4], (4, ""), (4, ""), (5, None)])


def test_links_of_documents(spark):
    """All pairs of whole documents by brute force."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = near_groups(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), NearRules(shingle=3, percent=85)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute(rows, 3, 85))


def test_empty_table(spark):
    assert near_groups(empty(spark)).count() == 0
    assert keep_one(empty(spark)).count() == 0
