import hashlib
import random

import numpy as np
import pytest
from helpers import SF, corpus, empty, frame
from corrspark.llm.suffixdedup import RepeatRules, digest, match_starts, strip_repeats


def brute(rows, length=200):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) by counting all strings."""
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            x = hashlib.md5(t[i : i + length]).digest()
            seen[x] = seen.get(x, 0) + 1
    out = []
    for (doc, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[hashlib.md5(t[i : i + length]).digest()] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(t)))
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def planted(seed):
    """Shared passages of lengths about the limit, periodic texts, a passage with many different neighbours."""
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passages = [noise(n) for n in (150, 198, 199, 200, 201, 260, 900)]
    rows = [(i, noise(rng.randint(0, 400)) + rng.choice(passages) + noise(rng.randint(0, 400))) for i in range(60)]
    rows += [(100, "ab" * 400), (101, "x" * 199), (102, "x" * 200), (103, "x" * 201), (104, noise(50) * 20), (105, noise(700) + passages[-1][100:400])]
    return rows


@pytest.mark.parametrize("rows,rules", [(planted(1), RepeatRules()), (planted(2), RepeatRules(split=5)), (corpus(6), RepeatRules(index_contexts=10))])
def test_matches_brute_force(spark, rows, rules):
    got = [tuple(r) for r in digest(strip_repeats(frame(spark, rows), rules)).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_smallest_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(tuple(r) for r in digest(strip_repeats(docs)).collect()) == sorted(brute(rows))


def test_match_starts_of_aligned_contexts():
    rules = RepeatRules(length=16, anchor=8)
    rng = random.Random(4)
    for _ in range(30):
        middle = b"anchor!!"
        rows = []
        for _ in range(rng.randint(2, 25)):
            left = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 8)))
            right = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 8)))
            if len(left + middle + right) >= 16 and (len(left), left + middle + right) not in rows:
                rows.append((len(left), left + middle + right))
        if len(rows) < 2:
            continue
        want = np.zeros((len(rows), 9), bool)
        for i, (a, c) in enumerate(rows):
            for t in range(9):
                x = c[a - t : a - t + 16] if a >= t else b""
                want[i, t] = len(x) == 16 and any(j != i and b >= t and d[b - t : b - t + 16] == x for j, (b, d) in enumerate(rows))
        assert (match_starts(rows, rules) == want).all()


def test_empty_table(spark):
    assert strip_repeats(empty(spark)).count() == 0
