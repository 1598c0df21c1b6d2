"""Operators that judge each row by itself: quality rules, secrets, personal data."""

import hashlib
import re
import time
from collections import Counter

import numpy as np
from helpers import SF, corpus, empty, frame
from corrspark.llm import pii, quality, secrets


def test_quality_base(spark):
    rows = corpus(11)
    got = Counter(tuple(r)[:7] for r in quality.measure(frame(spark, rows)).collect())
    want = Counter()
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        marked = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)} if len(words) < 500 else {i + k for i, g in enumerate(grams) if Counter(grams)[g] > 1 for k in range(5)} if len(set(grams)) < len(grams) else set()
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        want[(doc, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(marked), len(words) < 10 or 100 * len(marked) > 20 * len(words))] += 1
    assert got == want


def test_compression_bands(spark):
    rng = np.random.default_rng(1)
    noise = "".join(chr(x) for x in rng.integers(33, 0x2000, 4000))
    prose = next(r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars between 1500 and 2500 and text like '%.%'").orderBy("doc_id").collect())
    half = prose + "\n" + "z1 y2 x3 w4 v5 u6 t7 s8 r9 q0 p1 " * 700
    docs = frame(spark, [(1, noise + " " + " ".join(noise[i : i + 9] for i in range(0, 900, 9))), (2, prose), (3, "abc def " * 500), (4, half), (5, None)])
    got = {r["doc_id"]: (r["kept"], r["reason"]) for r in quality.measure(docs).collect()}
    assert got[1] == (False, "incompressible") and got[2] == (True, None)
    assert not got[3][0] and not got[4][0] and got[5] == (False, "base")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [2]


def test_quality_of_nothing(spark):
    assert quality.measure(empty(spark)).count() == 0 and quality.keep_good(empty(spark)).count() == 0


def test_secrets(spark):
    key = "AKIA" + "Q7" * 8
    text = f'é Password: "hunter2hunter2" {key} api_key=short deadbeef{"0f" * 16} x{"Zq3Rt8Yp1Lm6Wn4Kc9Vb2"} 123e4567-e89b-12d3-a456-426614174000 thisisanordinarylongword token=abc'
    prose = [(100 + i, r["text"]) for i, r in enumerate(spark.read.parquet(f"{SF}/documents.parquet").collect())] + [(99, "this is an ordinary long word and no ordinary or long word is in this " * 40)]
    got = {r["doc_id"]: r for r in secrets.find_secrets(frame(spark, [(1, text), (2, None), (3, ""), *prose])).collect()}
    spans = [s.split(":") for s in got[1]["spans"].split(",")]
    found = {(k, text[int(a) : int(b)]) for k, a, b in spans}
    assert ("access", key) in found and ("hex", "deadbeef" + "0f" * 16) in found
    assert ("assign", 'Password: "hunter2hunter2') in found
    assert any(k == "entropy" and "Zq3Rt8" in x for k, x in found) and not any("ordinary" in x or "426614" in x for _, x in found)
    assert (got[1]["n_assign"], got[1]["n_access"], got[1]["n_hex"]) == (1, 1, 1)
    assert got[2]["spans"] == got[3]["spans"] == "" and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert secrets.find_secrets(empty(spark)).count() == 0


def plain_secrets(text):
    """The patterns as they are stated."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32])


def test_secret_patterns_by_brute_force(spark):
    rng = np.random.default_rng(8)
    pieces = ["password", "Token", "api_key", "apikey=", " = ", ": ", '"', "AKIA", "Q7Q7Q7Q7", "deadbeef", "0123456789abcdef", "x", " ", "\n", "é", "secret", "AKIAAKIA"]
    rows = [(i, "".join(rng.choice(pieces, 25))) for i in range(400)]
    rows += [(None, "token=abcdefgh1"), (1, rows[1][1]), (1, rows[1][1]), (900, "token=" + "a1" * 200_000), (901, "f" * 200_000 + " AKIA" + "Z" * 100_000)]
    rows += [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in secrets.find_secrets(frame(spark, rows)).collect())
    want = Counter()
    for i, t in rows:
        spans = plain_secrets(t or "")
        kinds = [k for _, k, _ in spans]
        want[i, kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()] += 1
    assert got == want


def test_entropy_by_class(spark):
    """Of random strings of each class at least 95 in 100 are found at 20 characters; names and placeholders are not."""
    rules = secrets.EntropyRules()
    pairs = secrets.letter_pairs(spark.read.parquet(f"{SF}/documents.parquet"))
    allowed = secrets.allow_list(rules, pairs)
    found = lambda t: bool(secrets._entropy_spans(t, rules, allowed))
    rng = np.random.default_rng(9)
    every = lambda chars, n=40: "".join(rng.choice(list(chars), n))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    for chars in (letters, letters[:26], letters[26:], letters[:26] + "0123456789", letters + "0123456789", letters + "0123456789+/", "0123456789abcdef"):
        for n in (20, 24, 40):
            assert sum(found(every(chars, n)) for _ in range(400)) >= 370, (chars, n)
    assert sum(found(every(letters, 22) + "42") for _ in range(200)) > 190 and found("x9Kq2LmZ7Rt5Vb8Nw3Yc/example")
    assert found("qWeRtYuIoPaSdFgHjKlZxCvBnMpLkJhG")
    for clean in ("getHttpResponseCodeFromServer", "a-rather-long-file_name/with/parts", "internationalisationandmore", "2024-01-02/2024-01-03", "aaaaaaaaaaaaaaaaaaaaaaaa", "your-example-key-1234567890", "abcdefghijklmnopqrstuvwxyz", "handle_request_2024_v2", "THISISALLINCAPITALLETTERS", "123e4567-e89b-12d3-a456-426614174000"):
        assert not found(clean), clean


def test_entropy_by_increments_is_that_of_each_window():
    rng = np.random.default_rng(2)
    for _ in range(20):
        text = "".join(rng.choice(list("aabcdef0123456789"), 60))
        hit = np.zeros(60, bool)
        for i in range(60 - 19):
            n = np.array(list(Counter(text[i : i + 20]).values())) / 20
            if -(n * np.log2(n)).sum() >= 3.2 - 1e-9:
                hit[i : i + 20] = True
        got = np.zeros(60, bool)
        for a, b in secrets.entropy_runs(text, 3.2, 20):
            got[a:b] = True
        assert (got == hit).all()


def plain_base(text):
    """The patterns as they are stated, over the whole text."""
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append((2, m.start(), m.end()))
    return out + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_base_spans():
    texts = ["a@b.c @x a@@b.co é+1 (555) 010-9999 1.2.3.4 1.2.3.400.5 4111 1111 1111 1111 x@y", "a.b%@c-d.e.f@g.h", "+12 3", ""]
    texts += [f"u{i}@mail.example.com, 10.0.{i}.7 4111-1111-1111-111{i} +49 30 1234{i}67" for i in range(10)]
    for t in texts:
        assert pii.base_spans(t) == plain_base(t)


def test_gradients():
    rules = pii.TaggerRules(window=12, hidden=4, embed=3)
    tagger, rng = pii.Tagger(rules), np.random.default_rng(0)
    classes, tags = rng.integers(0, 60, (3, 12)), rng.integers(0, 9, (3, 12))
    for k in tagger.w:
        tagger.w[k] = tagger.w[k].astype(np.float64)
    _, g = tagger.gradients(classes, tags)
    for k, w in tagger.w.items():
        at = tuple(int(x) for x in np.unravel_index(np.abs(g[k]).argmax(), w.shape))
        old, sides = w[at], []
        for step in (1e-5, -1e-5):
            w[at] = old + step
            sides.append(tagger.gradients(classes, tags)[0])
        w[at] = old
        assert abs((sides[0] - sides[1]) / 2e-5 - g[k][at]) < 1e-3 * max(1, abs(g[k][at])), k


def test_tagger_finds_held_out_spans():
    rng = np.random.default_rng(3)
    words = ["red", "blue", "the", "house", "of", "was", "green"]

    def text():
        parts = list(rng.choice(words, 60))
        for make in (lambda: f"{rng.choice(words)}.{rng.integers(99)}@mail{rng.integers(9)}.example.com", lambda: ".".join(str(rng.integers(1, 255)) for _ in range(4)), lambda: f"+{rng.integers(10, 99)} {rng.integers(100, 999)} {rng.integers(1000, 9999)}"):
            parts[rng.integers(60)] = make()
        return " ".join(parts)

    rules = pii.TaggerRules(steps=250)
    tagger = pii.Tagger(rules)
    windows = list(pii.training_windows([text() for _ in range(200)], rules))
    losses = tagger.fit(*(np.stack([np.frombuffer(w[k], np.uint8) for w in windows]).astype(np.int64) for k in (1, 2)))
    assert losses[-1] < losses[0] / 20
    test = [text() for _ in range(60)]
    found = pii.model_spans(test, tagger)
    want, got = [set(pii.base_spans(t)) for t in test], [set(x) for x in found]
    hits = sum(len(a & b) for a, b in zip(want, got))
    assert hits > 0.85 * sum(map(len, want)) and hits > 0.85 * sum(map(len, got))
    # forms that the patterns do not know
    planted = []
    for t in test:
        for kind, x, y in pii.base_spans(t)[:1]:
            other = pii.written_otherwise(kind, t[x:y], rng)
            planted.append((t[:x] + other + t[y:], kind, x, x + len(other)))
    found = pii.model_spans([t for t, *_ in planted], tagger)
    caught = sum(any(k == kind and a < y and x < b for k, a, b in own) for (_, kind, x, y), own in zip(planted, found))
    known = sum((kind, x, y) in pii.base_spans(t) for t, kind, x, y in planted)
    assert len(planted) > 30 and known == 0 and caught > 0.8 * len(planted)
    plain = [" ".join(rng.choice(words, 80)) for _ in range(20)]
    assert sum(map(len, pii.model_spans(plain, tagger))) <= 1
    # one text, decoded in one go over its blended scores, and in small batches of windows
    long = " ".join(t for t in test)
    zones = np.concatenate([z for _, _, z in pii._zones([long], tagger, 7)], axis=2)
    whole = zones.transpose(2, 0, 1).reshape(1, -1, pii.N_TAGS)
    path = tagger.decode(whole, np.array([len(long)]))[0]
    assert pii.model_spans([long], tagger)[0] == pii._spans(path, 0)


def test_base_spans_in_awkward_texts():
    assert pii.base_spans("9" * 5000 + ".1.1.1") == []
    assert pii.base_spans("0" * 5000 + "7.1.1.1") == [(1, 0, 5007)]
    began = time.time()
    for text in ("a" * 300_000 + " @", "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" * 150_000, "@" * 300_000, "a@" + "b." * 150_000):
        pii.base_spans(text)
    assert time.time() - began < 20
    rng = np.random.default_rng(6)
    for _ in range(3000):
        text = "".join(rng.choice(list("a1.@+- _%("), rng.integers(1, 60)))
        assert pii.base_spans(text) == plain_base(text), text


def test_personal_data_rows(spark):
    rows = corpus(12) + [(950, "mail me@example.com now"), (951, "x" * 5000 + " 10.1.2.3")]
    got = pii.find_personal_data(frame(spark, rows), pii.TaggerRules(steps=5)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[950]["n_email"] == 1 and "email:5:19" in by[950]["spans"] and by[951]["n_ip"] == 1
    assert pii.find_personal_data(empty(spark)).count() == 0


def test_personal_data_paths_are_the_best_of_whole_texts():
    rng = np.random.default_rng(3)
    marks = list("ab 01.@+()-\n")
    for seed in range(6):
        tagger = pii.Tagger(pii.TaggerRules(seed=seed))
        tagger.w["out"] *= 3
        tagger.w["moves"] = rng.normal(0, 1, tagger.w["moves"].shape).astype(np.float32)
        tagger.w["moves"][0, 1:] -= seed / 2
        tagger.w["bias"][0] += seed
        texts = ["".join(rng.choice(marks, n)) for n in (0, 1, 79, 80, 81, 160, 700, 5000, 130_000 if seed in (0, 3, 5) else 3)] + ["", "a"]
        whole = [np.zeros((len(t), pii.N_TAGS), np.float32) for t in texts]
        for owner, place, zones in pii._zones(texts, tagger):
            for o, p, z in zip(owner, place, zones.transpose(2, 0, 1), strict=True):
                whole[o][p : p + 80] = z[: len(texts[o]) - p]
        found = pii.model_spans(texts, tagger)
        for text, scores, spans in zip(texts, whole, found, strict=True):
            best = tagger.decode(scores[None], np.array([len(text)]))[0] if text else np.zeros(0, np.int8)
            assert spans == pii._spans(best, 0)


def test_personal_data_long_runs_decode_as_short_ones():
    tagger = pii.Tagger(pii.TaggerRules())
    rng = np.random.default_rng(4)
    tagger.w["moves"] = rng.normal(0, 2, tagger.w["moves"].shape).astype(np.float32)
    for n in (8, 16, 17, 100, 1111):
        scores = rng.normal(0, 1, (n, pii.N_TAGS)).astype(np.float32)
        assert (tagger.decode_long(scores, 8) == tagger.decode(scores[None], np.array([n]))[0]).all()


def test_reach_against_comparing_all():
    import random

    from corrspark.llm.common import Reach

    rng = random.Random(4)
    for _ in range(200):
        base = [(a, a + rng.randint(1, 9)) for a in (rng.randrange(60) for _ in range(rng.randrange(9)))]
        reach = Reach(base)
        for a, b in ((a, a + rng.randint(1, 12)) for a in range(60)):
            assert (reach.to(b - 1) > a) == any(s < b and a < e for s, e in base)
            assert (reach.to(a) >= b) == any(s <= a and b <= e for s, e in base)


def test_very_many_spans(spark):
    text = " ".join(f"AKIA{i:016d} Zq{i:06d}Rt8Yp1Lm6Wn4Kc9V" for i in range(20_000))
    began = time.time()
    row = secrets.find_secrets(frame(spark, [(1, text)])).first()
    assert row["n_access"] == 20_000 and row["n_entropy"] > 15_000 and time.time() - began < 40


def test_spans_that_cannot_be_what_they_are_taken_for():
    good = [(0, "me(at)example(dot)org"), (0, "a.b at c.de"), (1, "10[.]1[.]2[.]255"), (2, "4111.1111.1111.1111"), (3, "(030) 123-4567"), (3, "0049301234567")]
    bad = [(0, "pfgetz pfgetz"), (0, "me@nowhere"), (0, "@x.y"), (1, "10.1.2"), (1, "10.1.2.256"), (2, "4111.1111.1111.1112"), (2, "411111111111"), (3, "4111111111111111"), (3, "1234567"), (3, "0000000000")]
    assert all(pii.plausible(k, s) for k, s in good) and not any(pii.plausible(k, s) for k, s in bad)
