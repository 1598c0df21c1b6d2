"""Packing, decontamination, language-model scores, URL filter and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import SF, SCHEMA, corpus, empty, frame
from corrspark.llm import decontaminate, eliasfano, lmscore, packing, urls
from tokenizers import Tokenizer


def test_packing_round_trip(spark):
    rows = corpus(21)
    rules = packing.PackingRules(window=128, bin_tokens=8)
    out = packing.pack(frame(spark, rows), rules).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        for a in range(0, len(ids), 128):
            part = ids[a : a + 128]
            want[(doc, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids))] += 1
    got = Counter((None if np.isnan(d) else int(d), s, n, c, t) for d, s, n, c, t in zip(out.doc_id.astype(float), out.start, out.length, out.ids_crc32, out.doc_tokens))
    assert got == want
    out = out.sort_values(["sequence_id", "offset"])
    ends = out.groupby("sequence_id").length.cumsum()
    assert (ends - out.length == out.offset).all() and ends.max() <= 128
    assert out.sequence_id.nunique() == out.sequence_id.max() + 1
    assert out.length.sum() / (128 * out.sequence_id.nunique()) > 0.85


def test_windows_of_production_size_are_full(spark):
    """The documents of the larger tables in their 4096-token windows."""
    out = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).selectExpr("sum(length) as used", "count(distinct sequence_id) as n").first()
    assert out["used"] > 0.97 * 4096 * out["n"]


def test_words_are_encoded_like_texts():
    encoder = packing.WordEncoder(packing.PackingRules())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["don't it's", "e\u0301 \u00e9", "ΑΣ σς", "<|endoftext|>a <|endoftext|>", "\x1ca \x85b\u00a0c", "", " \n", "日本 x1y2 ..!?"]
    for text, got in zip(texts, encoder.encode([t.encode() for t in texts])):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_words_of_mixed_marks_are_encoded_like_texts():
    encoder = packing.WordEncoder(packing.PackingRules())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["“hello”.", "he said “yes”, then", "«oui».", "wait…!", "1°.", "20 £,", "日本。.", "«да»,", "İ! x\u0302! ½. Ⅳ, ²)", "e\u0301. =\u0338.", "한\u1100\u1161. ﬁ."]
    rng = random.Random(5)
    alphabet = list("abzAZ09 \n\t") + list("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") + list("“”«»…°£€–—’。、「」¿¡·×÷éßøдяΣςאبक日本한글①²½Ⅳ") + ["\u0301", "\u0302", "\u0338", "\u200d", "\u00a0", "\u2003", "\u3000", "😀", "İ", "ſ", "<|endoftext|>"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 14))) for _ in range(20_000)]
    texts += ["".join(chr(c) for c in (rng.randrange(1, 0x3100) for _ in range(rng.randint(1, 8))) if not 0xD800 <= c < 0xE000) + rng.choice(("", ".", "),", "!?")) for _ in range(20_000)]
    different = [t for t, got in zip(texts, encoder.encode([t.encode() for t in texts])) if np.frombuffer(got, "<u4").tolist() != tokenizer.encode(t, add_special_tokens=False).ids]
    assert different == []


def test_plan_uses_up_the_histogram():
    rng = np.random.default_rng(0)
    for _ in range(20):
        h = np.append(0, rng.integers(0, 50, 32) * (rng.random(32) < 0.5))
        used = np.zeros_like(h)
        for times, ways in packing.plan(h, 32, 30):
            assert sum(b * n for b, n in ways.items()) <= 32
            for b, n in ways.items():
                used[b] += times * n
        assert (used == h).all()


def test_packing_nothing(spark):
    assert packing.pack(empty(spark)).count() == 0


ITEM = "A train leaves Boston at 40 km and drives for 3 hours before it meets another train that left the station 40 minutes later."


def test_templates(spark):
    changed = ITEM.replace("40", "75").replace("Boston", "Lisbon").replace("3", "5")
    broken = ITEM.replace("40 minutes", "55 minutes").replace("Boston", "Lisbon")
    rows = [(1, f"Some words before. {ITEM} And after."), (2, changed), (3, broken), (4, "nothing of the kind is written in this text at all, really"), (5, None), (None, ITEM), (6, ITEM[:40])]
    bench = spark.createDataFrame([(7, ITEM), (8, None), (9, "short item"), (None, ITEM)], "item_id long, text string")
    docs = frame(spark, rows)
    got = {r["doc_id"]: r for r in decontaminate.judge(docs, bench).collect()}
    assert {i for i, r in got.items() if r["contaminated"]} == {1, 2, None, 3}
    assert got[1]["item_ids"] == [7] and got[1]["longest_run"] == got[2]["longest_run"] > got[3]["longest_run"]
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {4, 5, 6}
    assert decontaminate.judge(empty(spark), bench).count() == 0 and decontaminate.judge(docs, bench.limit(0)).where("contaminated").count() == 0


def brute_leaks(docs, items, rules):
    """(doc, item) by comparing all windows of all texts."""
    templates = decontaminate.Templates(rules)

    def windows(text, short):
        _, place, value, (at, kind, words, n) = templates.windows([text.encode()], short)
        return [(p, v, templates.slots(a, kind, words, k)) for p, v, a, k in zip(place.tolist(), value.tolist(), at, n)]

    found = set()
    for j, item in items:
        size = len(templates.tokens([item.encode()])[0])
        short = (size,) if 0 < size < rules.window else ()
        for i, text in docs:
            lines = {}
            for p, v, own in windows(item, short):
                for q, w, other in windows(text or "", short):
                    if v == w:
                        lines.setdefault(q - p, []).append((p, own, other))
            runs = [r for rows in lines.values() for r in decontaminate.consistent_runs(sorted(rows), min(rules.window, size))]
            covered = {k for a, b in runs for k in range(a, b)}
            if runs and (max(b - a for a, b in runs) >= rules.min_run or 100 * len(covered) >= rules.min_percent * size):
                found.add((i, text, j))
    return found


def test_leaks_by_brute_force(spark):
    rng = np.random.default_rng(4)
    words = [*(f"word{c}" for c in "abcdefghij"), "12", "7", "km", "hours", "Boston", "Lisbon", "Rome", "five."]
    text = lambda n: " ".join(rng.choice(words, n))
    items = [(k, text(rng.integers(3, 40))) for k in range(12)] + [(20, "12 7 12 Boston 7 km 5 hours 9 Rome 3 km"), (21, "four short words here")]
    rows = []
    for i in range(60):
        own = items[rng.integers(len(items))][1].split()
        cut = own[rng.integers(0, 3) :] if i % 3 else text(10).split()
        rows.append((i, text(15) + ". " + " ".join("Oslo" if w == "Rome" and i % 2 else w for w in cut) + " " + text(10)))
    rows += [rows[1], rows[1], (rows[1][0], "some other text of the same id"), (None, rows[4][1]), (None, "clean and without an id"), (70, (rows[1][1] + " ") * 300), (71, None)]
    got = decontaminate.find_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_leaks(rows, items, decontaminate.TemplateRules())
    assert len(want) > 20 and any(j == 20 for *_, j in want) and any(j == 21 for *_, j in want)
    assert Counter((r["doc_id"], r["item_id"]) for r in got) == Counter((i, j) for i, _, j in want)
    kept = decontaminate.decontaminate(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    leaked = {(i, t) for i, t, _ in want}
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(x for x in rows if x not in leaked)


def test_slots_must_be_consistent():
    item = ["num:0:4", "num:3:4"]
    assert decontaminate.consistent_runs([(0, item, ["num:0:7", "num:3:7"])], 8) == [(0, 8)]
    assert decontaminate.consistent_runs([(0, item, ["num:0:7", "num:3:9"])], 8) == []
    rows = [(0, ["num:0:4"], ["num:0:7"]), (1, ["num:7:4"], ["num:7:7"]), (2, ["num:6:4"], ["num:6:9"])]
    assert decontaminate.consistent_runs(rows, 8) == [(0, 9), (2, 10)]


def test_base_scores(spark):
    rows = corpus(22)
    got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in lmscore.score_texts(frame(spark, rows), lmscore.ModelRules(shard_tokens=500)).collect())
    words = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w] + ["</s>"]
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not out(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, out(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t)), 6)) for i, t in rows)
    assert got == want


def exact_scores(rows, power=0.8):
    """log10 of the smoothed bigram model of each row, in the rows' order, from exact counts."""
    texts = [["<s>", *(t or "").split(), "</s>"] for _, t in rows]
    taught = [t for (i, _), t in zip(rows, texts) if zlib.crc32(str(i).encode()) % 10]
    ones, pairs, contexts = Counter(), Counter(), Counter()
    for t in taught:
        ones.update(t[1:])
        pairs.update(zip(t, t[1:]))
        contexts.update(t[:-1])
    n, v = sum(ones.values()), len(ones)

    def p(a, b):
        c, own = contexts[a], (ones[b] + 0.1) / (n + 0.1 * (v + 1))
        m = c**power
        return (pairs[a, b] + m * own) / (c + m) if c else own

    return {i: sum(math.log10(p(a, b)) for a, b in zip(t, t[1:])) for (i, _), t in zip(rows, texts)}


def zipf_rows(seed, n, vocabulary):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(f"w{x}" for x in rng.zipf(1.3, 60) if x < vocabulary)) for i in range(n)]


def test_words_have_their_own_counts(spark):
    rows = zipf_rows(11, 200, 10**6)
    want = exact_scores(rows)
    got = lmscore.score_texts(frame(spark, rows), lmscore.ModelRules(bucket_words=100)).collect()
    assert np.allclose([r["score"] for r in got], [want[r["doc_id"]] for r in got], rtol=0.01)


def test_spread_words_are_known_in_all_shards(spark):
    rows = zipf_rows(12, 60, 10**6)
    want = exact_scores(rows)
    for tokens in (20, 100):
        got = lmscore.score_texts(frame(spark, rows), lmscore.ModelRules(shard_tokens=tokens)).collect()
        assert np.allclose([r["score"] for r in got], [want[r["doc_id"]] for r in got], rtol=0.01)


def test_model_beats_the_base_where_words_follow_words(spark):
    rng = np.random.default_rng(7)
    after = {w: rng.choice(200, 3) for w in range(200)}
    rows = []
    for i in range(300):
        now, out = int(rng.integers(200)), []
        for _ in range(80):
            out.append(f"w{now}")
            now = int(rng.choice(after[now])) if rng.random() < 0.9 else int(rng.integers(200))
        rows.append((i, " ".join(out)))
    held = [r for r in lmscore.score_texts(frame(spark, rows)).collect() if r["held_out"]]
    assert held and sum(r["score"] for r in held) > 0.8 * sum(r["base_score"] for r in held)


def test_scores_do_not_depend_on_shards(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    few = {r["doc_id"]: r["score"] for r in lmscore.score_texts(docs).collect()}
    rows = lmscore.score_texts(docs, lmscore.ModelRules(shard_tokens=4000)).collect()
    # one byte for a probability: shards have books of their own
    assert np.allclose([few[r["doc_id"]] for r in rows], [r["score"] for r in rows], rtol=0.01)
    assert lmscore.score_texts(empty(spark)).count() == 0


def test_elias_fano(tmp_path):
    rng = np.random.default_rng(5)
    for n, top in ((1, 1), (5, 3), (1000, 10**6), (5000, 4000), (300, 2**60)):
        values = np.sort(rng.integers(0, top, n))
        seq = eliasfano.Monotone(str(tmp_path), f"s{n}", values)
        assert (seq.at(np.arange(n)) == values).all()
        wanted = rng.integers(0, top + 2, 200)
        zero, end = np.zeros(200, np.int64), np.full(200, n, np.int64)
        assert (seq.find(wanted, zero, end) == np.searchsorted(values, wanted)).all()
    pairs = np.unique(rng.integers(0, 400, (2000, 2)), axis=0)
    contexts = np.unique(pairs[:, 0])
    place = np.searchsorted(contexts, pairs[:, 0])
    trie = eliasfano.NgramTrie(str(tmp_path), contexts, contexts * 1.0, place, pairs[:, 1], np.arange(len(pairs)) * 1.0, 400)
    q = rng.integers(0, 400, (3000, 2))
    known, _, found, value = trie.look(q[:, 0], q[:, 1])
    there = {tuple(p): i for i, p in enumerate(pairs.tolist())}
    assert (known == np.isin(q[:, 0], contexts)).all() and (found == np.array([tuple(x) in there for x in q.tolist()])).all()
    assert all(abs(value[i] - there[tuple(x)]) <= len(pairs) / 200 for i, x in enumerate(q.tolist()) if tuple(x) in there)


def parse(url):
    """Host, path, rule and verdict by the stated rules."""
    url = url or ""
    if "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for verdict, rule in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_urls(spark):
    rows = [(r["page_id"], r["url"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    rows += [(900, None), (901, ""), (902, "no scheme"), (903, "HTTP://WWW.Example.COM/en/x?u=a://b"), (904, "http://example.com"), (905, "http://a.net?x/es/"), (906, "ftp://b.net/es/#://c.com/"), (907, "x://y\nz.com/p")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judge_urls(pages).collect()}
    assert len(got) == len(rows)
    for i, url in rows:
        host, path, rule, verdict = parse(url)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), url
        assert got[i]["verdict"] in ({verdict} if verdict else {"allow", "block"})
    assert got[900]["score"] == 0.0
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_url_model_tells_hosts_apart(spark):
    rng = np.random.default_rng(1)
    name = lambda letters: "".join(rng.choice(list(letters), 8))
    rows = [(i, f"http://{name('abcd')}.com/a") if i % 2 else (i, f"http://{name('wxyz')}.net/es/a") for i in range(400)]
    rows += [(1000 + i, f"http://{name('abcd')}.org/a") for i in range(20)] + [(2000 + i, f"http://{name('wxyz')}.org/a") for i in range(20)]
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert sum(got[1000 + i] == "allow" for i in range(20)) >= 18 and sum(got[2000 + i] == "block" for i in range(20)) >= 18


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rows += [(900, None), (901, ""), (902, "bad " * 100), (903, rows[0][1]), (None, rows[1][1])]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == SCHEMA.names
        docs = spark.createDataFrame(docs.collect(), SCHEMA)
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] == sizes[2] >= sizes[3] >= sizes[4] > 0  # a copy's lines have gone before
    last = pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert last.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    whole = pipeline.run(spark, str(tmp_path))
    assert whole.select("doc_id", "start", "length").exceptAll(last.select("doc_id", "start", "length")).count() == 0


def test_common_words_go_by_number(spark):
    """With and without a table of common words, shards see the same pairs and counts; numbers take less room than hashes."""
    common = np.sort(np.random.default_rng(1).integers(1 << 40, 1 << 63, 3000).astype(np.uint64))
    code = np.sort(np.concatenate([common[::3], np.random.default_rng(2).integers(1 << 40, 1 << 63, 500).astype(np.uint64)]))
    numbered = lmscore._numbered(code, common)
    assert (np.diff(numbered.astype(np.float64)) > 0).all() and sorted(lmscore._hashes(numbered, common)) == code.tolist()
    assert len(lmscore._pack(numbered)) < 0.7 * len(lmscore._pack(code))
    rows = zipf_rows(13, 100, 10**6)
    tables = [{r["doc_id"]: (r["n_known"], r["base_score"], r["score"]) for r in lmscore.score_texts(frame(spark, rows), lmscore.ModelRules(shard_tokens=500, bucket_words=100, common_words=k)).collect()} for k in (0, 20, 1 << 17)]
    for other in tables[1:]:
        assert all(np.allclose(tables[0][i], other[i], rtol=1e-6) for i in tables[0])
