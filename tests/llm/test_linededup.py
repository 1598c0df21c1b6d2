import os
import random
import re
import time

import pytest
from helpers import corpus, empty, frame
from pyspark.sql import functions as F
from corrspark.llm.linededup import LONG, LineRules, _classes, _fit, _line_table, _rows, dedup_lines, judge_lines, line_links, mark_lines, removed_lines
from corrspark.session import Scratch, shared_dir


def brute(rows):
    """The same by comparing all pairs of lines."""
    lines = []
    for i, text in dict.fromkeys(rows):
        for no, line in enumerate((text or "").lower().split("\n") if text is not None else []):
            words = frozenset(w for w in re.split("[ \t\x0b\f\r]+", line) if w)
            if words:
                lines.append(((i is None, i or 0), no, words, (i, text)))
    return lines


def similar(a, b):
    common = len(a & b)
    return 100 * common >= 80 * (len(a) + len(b) - common)


def variants(seed):
    """Lines that differ from one another by a few words, so that first pairs both match and fail."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(60):
        own = list(words[: rng.choice((12, 20, 40))])
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(len(own))] = f"v{rng.randrange(30)}"
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize("rows", [corpus(), variants(1), variants(2)])
def test_matches_brute_force(spark, rows):
    docs = frame(spark, rows)
    got = {}
    for r in judge_lines(docs).collect():
        got.setdefault(r["doc_id"], []).append(sorted(r["removed_lines"]))
    lines = brute(rows)
    by_id = {}
    for key, no, words, doc in lines:
        # texts of one id are ordered by hash; the corpus has one text for each id with lines
        gone = any((k, m) < (key, no) and similar(w, words) for k, m, w, _ in lines)
        by_id.setdefault(doc[0], [])
        if gone:
            by_id[doc[0]].append(no)
    for i, _ in rows:
        assert sorted(by_id.get(i, [])) in got[i], i


def test_all_links_are_counted(spark):
    rows = variants(1) + [(100, "a b\nb a\n\nw0 w1"), (101, None)]
    docs = frame(spark, rows)
    sets = {w for _, _, w, _ in brute(rows)}
    links = {w: sum(similar(w, v) for v in sets if v != w) for w in sets}
    assert max(links.values()) > 5
    got, found = {}, {r["doc_id"]: r for r in judge_lines(docs).collect()}
    for key, no, words, (i, _) in brute(rows):
        line = next(c for c in found[i]["line_classes"] if c["line_no"] == no)
        assert line["n_links"] == links[words] <= found[i]["most_links"]
        got.setdefault(words, set()).add((line["class_a"], line["class_b"]))
    assert all(len(c) == 1 for c in got.values()) and len(set.union(*got.values())) == len(sets)
    assert found[101]["line_classes"] == [] and found[101]["most_links"] == 0
    name = {next(iter(c)): w for w, c in got.items()}
    pairs = [frozenset((name[r["x_a"], r["x_b"]], name[r["y_a"], r["y_b"]])) for r in line_links(docs).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {frozenset((v, w)) for v in sets for w in sets if v != w and similar(v, w)}


def test_removed_lines_leave_the_text(spark):
    rows = corpus()
    docs = frame(spark, rows)
    out = dedup_lines(docs)
    assert out.columns == docs.columns
    assert out.count() == len(rows)
    text = {r["doc_id"]: r["text"] for r in out.where("doc_id is not null").collect()}
    assert text[900] is None and text[901] == "" and text[902] == "\n\n \t\n"
    assert text[906].count("same line here") == 1
    assert text[904] in ("Word word", "")  # "word" of 903 came first


def test_empty_table(spark):
    assert judge_lines(empty(spark)).count() == 0
    assert dedup_lines(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_removal_agrees_with_all_links(spark, seed):
    """Comparing the nearest candidate first, and all where it fails, removes what all links remove."""
    docs = frame(spark, variants(seed) + variants(seed + 10)[:20] + [(200, "w0 w1\nw1 w0"), (None, "w0 w1 w2")])
    full = {(r["doc_id"], r["line_no"]) for r in mark_lines(docs).where("removed").collect()}
    assert {(r["doc_id"], n) for r in removed_lines(docs).collect() for n in r["removed_lines"]} == full and len(full) > 5


def test_very_many_lines(spark):
    """Time in proportion: 60,000 repeated lines, and as many of which each is new."""
    again, fresh = "\n".join(f"line {i % 3} says so" for i in range(60_000)), "\n".join(f"w{i} x{i} y{i}" for i in range(60_000))
    began = time.time()
    text = {r["doc_id"]: r["text"] for r in dedup_lines(frame(spark, [(1, again), (2, fresh + "\n" + "line 1 says so\n" * 2)])).collect()}
    assert text[1].split("\n") == [f"line {i} says so" for i in range(3)]
    assert text[2] == fresh + "\n" and time.time() - began < 60


def long_lines(seed):
    """Lines of about LONG words, shorter and longer ones, that differ by up to a quarter."""
    rng = random.Random(seed)
    rows = []
    for i in range(50):
        own = [f"w{j}" for j in range(LONG + rng.choice((-9, -2, 0, 1, 8, 60)))]
        for j in rng.sample(range(len(own)), rng.randint(0, len(own) // 4)):
            own[j] = f"v{rng.randrange(400)}"
        rows.append((i, " ".join(own)))
    return rows


def test_long_lines_lose_no_link(spark):
    rows = long_lines(1)
    sets = {w for _, _, w, _ in brute(rows)}
    expected = sum(similar(v, w) for v in sets for w in sets if v != w) // 2
    assert line_links(frame(spark, rows)).count() == expected > 50


def test_long_lines_of_different_words_hardly_meet(spark):
    """They share one word only; 64 parity bits for all of the words let many such pairs through."""
    rng = random.Random(5)
    docs = frame(spark, [(i, " ".join(["common", *(f"x{rng.randrange(10**6)}" for _ in range(139))])) for i in range(60)])
    rules = LineRules()
    rows = _rows(_classes(_line_table(docs, [0] * (1 << rules.rarity_bits), rules), lambda df, _: df), "number").withColumns({"key": F.lit(1), "place": F.lit(0)}).dropDuplicates(["number"])
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    assert rows.alias("x").join(rows.alias("y"), _fit(x, y, rules) & (x("number") < y("number"))).count() <= 5


def test_tables_on_the_way_go(spark):
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    mark_lines(frame(spark, variants(1))).count()
    assert [x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before] == ["line-marks"]


def test_a_table_goes_before_the_block_ends(spark):
    folder = shared_dir(spark).removeprefix("file://")
    with Scratch(spark) as tmp:
        first, second = tmp.cut(spark.range(3), "first-table"), tmp.cut(spark.range(4), "second-table")
        tmp.drop(first)
        there = [x for x in os.listdir(folder) if x.startswith(("first-table", "second-table"))]
        assert len(there) == 1 and there[0].startswith("second-table") and second.count() == 4
    assert not [x for x in os.listdir(folder) if x.startswith(("first-table", "second-table"))]
