"""Line dedup as an exact set-similarity join, in DataFrame operations only.

A line is the set of its lower-cased words, as 64-bit keys that sort by rarity. Equal sets become one class. Classes
that share one of their rarest words (prefix filter) meet on that word; length, positional and parity bounds drop pairs
that cannot reach the threshold, and the Jaccard similarity of the rest is verified on the whole sets. Of two lines
that match, the later one goes; lines are ordered by (doc_id, line number, text hash).

All matching pairs of classes are found, so every line comes with its class and the number of other sets that match.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corrspark.llm.common import bitmap, documents, in_bitmap
from corrspark.session import Scratch, cut


@dataclass(frozen=True)
class LineRules:
    """``percent``: least Jaccard similarity. ``rarity_bits``: the corpus's word counts are kept in 2**rarity_bits
    buckets; words of a bucket count as equally rare, which changes the order of words but no result.
    ``most_filter_bits``: largest size of the bitmap that finds the lines to verify again; also without influence on results.
    """

    percent: int = 80
    rarity_bits: int = 17
    most_filter_bits: int = 26


_BREAKS = "[\\t\\x0b\\f\\r]"


def _words(line: Column, odd: Column) -> Column:
    """Words of a line, with empty ones between them. Regular expressions only where the text has ``odd`` breaks."""
    return F.when(odd, F.split(line, "[ \\t\\x0b\\f\\r]+", -1)).otherwise(F.split(line, " ", -1))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, odd (the text has tabs or other rare breaks), line_no, line (lower-cased) of the lines with a word; a null text has none."""
    whole = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.lower("text").alias("low")).where("low is not null")
    whole = whole.withColumn("odd", F.col("low").rlike(_BREAKS))
    lines = whole.select("doc_id", "text_hash", "odd", F.posexplode(F.split("low", "\n", -1)).alias("line_no", "line"))
    return lines.where(F.ltrim("line", F.lit(" \t\x0b\f\r")) != "")


def _rarity(docs: DataFrame, bits: int) -> list[int]:
    """A level for each bucket of words, larger for more frequent ones: a fixed-size summary of all words' counts."""
    words = docs.select(F.explode(F.split(F.lower("text"), "[ \\t\\n\\x0b\\f\\r]+", -1)).alias("word"))
    bucket = F.xxhash64("word").bitwiseAND((1 << bits) - 1)
    levels = [0] * (1 << bits)
    for row in words.groupBy(bucket.cast("int").alias("bucket")).count().toLocalIterator():  # a row for each bucket at most
        levels[row["bucket"]] = min(126, 1 + int(2.5 * math.log2(row["count"])))
    return levels


def _keys(words: Column, levels: list[int]) -> Column:
    """The distinct words as longs: rarity in the high byte, 56 bits of hash below; rarest first."""
    table = F.split(F.lit(",".join(map(str, levels))), ",").cast("array<long>")  # a constant after planning

    def key(h: Column) -> Column:
        level = F.coalesce(F.get(table, h.bitwiseAND(len(levels) - 1).cast("int")), F.lit(0).cast("long"))
        return F.shiftleft(level, 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    keys = F.sort_array(F.array_distinct(F.transform(F.transform(words, lambda w: F.xxhash64(w)), key)))
    return F.array_remove(keys, key(F.xxhash64(F.lit(""))))


def _parity(keys: Column) -> Column:
    """64 parity bits of a set: sets that differ in d elements differ in at most d bits."""
    one = F.lit(1).cast("long")
    return F.aggregate(keys, F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(F.call_function("shiftleft", one, k.bitwiseAND(63).cast("int"))))


#: Sets of more words have parity bits of their own for one half of the words: 64 bits for all tell such sets apart too rarely.
LONG = 72


def _line_table(docs: DataFrame, levels: list[int], rules: LineRules) -> DataFrame:
    """One row for each line with a word: where it is, its class (two hashes of its set), size, prefix and parity (bits: of all, half: of one half, 0 unless LONG)."""
    keys = _keys(_words(F.col("line"), F.col("odd")), levels).alias("keys")
    keyed = _lines(docs).select("doc_id", "text_hash", "line_no", F.xxhash64("line").alias("line_hash"), keys)
    size = F.size("keys")
    # a set of n shares at least ceil(percent * n) words with a match, so one of its n - that + 1 rarest is shared
    prefix = (size - F.ceil(size * rules.percent / 100 - 1e-9) + 1).cast("int")
    return keyed.select(
        "doc_id",
        "text_hash",
        "line_no",
        "line_hash",
        F.xxhash64("keys").alias("class_a"),
        F.xxhash64(F.lit(7), "keys").alias("class_b"),
        size.alias("n"),
        F.slice("keys", F.lit(1), prefix).alias("prefix"),
        _parity(F.col("keys")).alias("bits"),
        F.when(size > LONG, _parity(F.filter("keys", lambda k: F.shiftright(k, 6).bitwiseAND(1) == 1))).otherwise(F.lit(0).cast("long")).alias("half"),
    )


def _place() -> Column:
    """The place of a line in the order of all lines. Null ids come last."""
    return F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"), F.col("line_no").alias("line"), "text_hash")


def _differ(x, y) -> Column:
    """Words that rows (functions from a name to a column) differ in at least, by their parity bits."""
    all_, half = x("bits").bitwiseXOR(y("bits")), x("half").bitwiseXOR(y("half"))
    long = (x("n") > LONG) & (y("n") > LONG)
    return F.when(long, F.bit_count(half) + F.bit_count(all_.bitwiseXOR(half))).otherwise(F.bit_count(all_))


def _may_match(x, y, rules: LineRules) -> Column:
    """Whether rows (functions from a name to a column) can reach the threshold by their sizes and parity bits."""
    low, high = F.least(x("n"), y("n")), F.greatest(x("n"), y("n"))
    # |x & y| >= percent / (100 + percent) * (|x| + |y|)
    least = F.ceil((x("n") + y("n")) * rules.percent / (100 + rules.percent) - 1e-9)
    return (low * 100 >= high * rules.percent) & (x("n") + y("n") - _differ(x, y) >= 2 * least)


def _places_fit(x, y, rules: LineRules) -> Column:
    """The positional bound; it holds at the first word in common, where any true pair meets."""
    least = F.ceil((x("n") + y("n")) * rules.percent / (100 + rules.percent) - 1e-9)
    return F.least(x("n") - x("place"), y("n") - y("place")) >= least


def _classes(lines: DataFrame, keep) -> DataFrame:
    """class_a, class_b, first (place of its first line), n, prefix, bits, half, line_hash, number of each class, numbered by their first lines.

    ``keep``: a function that writes a table and reads it again.
    """
    values = [F.first(c).alias(c) for c in ("n", "prefix", "bits", "half", "line_hash")]
    classes = lines.groupBy("class_a", "class_b").agg(F.min(_place()).alias("first"), *values)
    return keep(classes.orderBy("first").withColumn("number", F.monotonically_increasing_id()), "line-classes")


def _lines_and_classes(docs: DataFrame, levels: list[int], rules: LineRules, tmp: Scratch) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_hash, line_no, class_a, class_b of each line, and the classes, which alone keep their sets' prefixes."""
    whole = tmp.cut(_line_table(docs, levels, rules), "whole-lines")
    classes = _classes(whole, tmp.cut)
    lines = tmp.cut(whole.select("doc_id", "text_hash", "line_no", "class_a", "class_b"), "lines")
    tmp.drop(whole)
    return lines, classes


def _rows(classes: DataFrame, *columns: str) -> DataFrame:
    """A row for each word of a class's prefix."""
    return classes.select(*columns, "bits", "half", "n", F.posexplode("prefix").alias("place", "key"))


def _fit(x, y, rules: LineRules) -> Column:
    return (x("key") == y("key")) & _places_fit(x, y, rules) & _may_match(x, y, rules)


def _sets(docs: DataFrame, wanted: DataFrame, levels: list[int], rules: LineRules, keep) -> DataFrame:
    """``wanted`` (class_a, class_b, line_hash of one of its lines, more) with keys, its set of words, from the lines themselves.

    Written, as are links, so that each step's shuffle files go before the next has its own.
    """
    there, bits = bitmap(wanted, "line_hash", rules.most_filter_bits)
    maybe = _lines(docs).where(in_bitmap(F.xxhash64("line"), there, bits))
    keyed = maybe.select("line", "odd").distinct().select(_keys(_words(F.col("line"), F.col("odd")), levels).alias("keys"))
    keyed = keyed.select(F.xxhash64("keys").alias("class_a"), F.xxhash64(F.lit(7), "keys").alias("class_b"), "keys")
    return keep(keyed.join(wanted.drop("line_hash"), ["class_a", "class_b"]).dropDuplicates(["class_a", "class_b"]), "line-sets")


def _similar(x: str, y: str, rules: LineRules) -> Column:
    common = F.size(F.array_intersect(x, y))
    return common * 100 >= (F.size(x) + F.size(y) - common) * rules.percent


def _wide_parity(keys: Column) -> Column:
    """512 parity bits of a set, as eight longs."""
    return F.array(*[_parity(F.filter(keys, _in_eighth(w))) for w in range(8)])


def _in_eighth(w: int):
    return lambda k: F.shiftright(k, 6).bitwiseAND(7) == w


def _later_classes(docs: DataFrame, classes: DataFrame, levels: list[int], rules: LineRules, keep) -> DataFrame:
    """class_a, class_b, first, later for each class: its first line's place, and whether a class whose first line is earlier matches it.

    A class is compared with the first one of like size that has one of its rare words; most
    variants of a line end there. Only what is left meets all earlier classes on its words, and only pairs that 512 parity bits of both
    sets do not tell apart are verified. So a large group of variants costs its members, not its pairs.
    ``keep``: a function that writes a table and reads it again.
    """
    rows = _rows(classes, "number")
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    l = lambda c: F.col(f"l.{c}")  # noqa: E731, E741
    group = Window.partitionBy("key", F.floor(F.col("n") / 4))
    near = rows.withColumn("l", F.min(F.struct("number", "n", "place", "bits", "half")).over(group))
    near = near.where((l("number") < F.col("number")) & _places_fit(l, F.col, rules) & _may_match(l, F.col, rules))
    near = keep(near.groupBy(F.col("number").alias("later")).agg(F.min(F.struct(_differ(l, F.col).alias("differ"), l("number").alias("earlier"))).alias("b")).select("later", "b.earlier"), "line-leaders")

    def sets_of(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("earlier", "later")).alias("number")).distinct()
        return _sets(docs, classes.join(wanted, "number", "left_semi").select("class_a", "class_b", "line_hash", "number"), levels, rules, keep)

    def both(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
        own = pairs.join(sets.select(F.col("number").alias("earlier"), F.col(column).alias("_x")), "earlier")
        return own.join(sets.select(F.col("number").alias("later"), F.col(column).alias("_y")), "later")

    def matched(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        return both(pairs, sets, "keys").where(_similar("_x", "_y", rules)).select("later").distinct()

    sure = keep(matched(near, sets_of(near)), "line-matches")
    # what is settled has its number n as -1 - n: both sides of the join are one and the same table, so its rows are shuffled once
    # (no condition is on one side alone, not even that y's number is not null, which greatest() hides)
    settled = classes.join(sure.select(F.col("later").alias("number"), F.lit(True).alias("sure")), "number", "left")
    signed = _rows(settled.withColumn("signed", F.when(F.col("sure"), -1 - F.col("number")).otherwise(F.col("number"))), "signed")
    earlier = F.when(x("signed") < 0, -1 - x("signed")).otherwise(x("signed"))
    rest = signed.alias("x").join(signed.alias("y"), _fit(x, y, rules) & (earlier < F.greatest(y("signed"), F.lit(-1)))).select(earlier.alias("earlier"), y("signed").alias("later")).distinct()
    rest = keep(rest.join(near, ["later", "earlier"], "left_anti"), "line-pairs")
    sets = sets_of(rest)
    sketches = keep(sets.select("number", F.struct(F.size("keys").alias("n"), _wide_parity(F.col("keys")).alias("bits")).alias("sketch")), "line-sketches")
    a, b = F.col("_x"), F.col("_y")
    least = F.ceil((a["n"] + b["n"]) * rules.percent / (100 + rules.percent) - 1e-9)
    apart = F.aggregate(F.zip_with(a["bits"], b["bits"], lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, d: total + d)
    close = keep(both(rest, sketches, "sketch").where(a["n"] + b["n"] - apart >= 2 * least).select("later", "earlier"), "line-close")
    found = sure.unionByName(keep(matched(close, sets), "line-matches")).select(F.col("later").alias("number"), F.lit(True).alias("later"))
    return classes.select("class_a", "class_b", "first", "number").join(found, "number", "left").select("class_a", "class_b", "first", F.coalesce("later", F.lit(False)).alias("later"))


def removed_lines(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """doc_id, text_hash, removed_lines (from 0, in order) of the documents with lines that an earlier one matches or has the same set of words as.

    Of all that is written on the way only this table is left.
    """
    with Scratch(docs.sparkSession) as tmp:
        levels = _rarity(docs, rules.rarity_bits)
        lines, classes = _lines_and_classes(docs, levels, rules, tmp)
        known = _later_classes(docs, classes, levels, rules, tmp.cut)
        joined = lines.join(known, ["class_a", "class_b"])
        gone = joined.where(F.col("later") | (F.col("first") < _place()))
        return cut(gone.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line_no")).alias("removed_lines")), "removed-lines")


#: Parts in which matching pairs are verified, one after the other: a pair carries a set of words on its way, and so only some do at a time.
VERIFY_PARTS = 3


def _links(docs: DataFrame, classes: DataFrame, levels: list[int], rules: LineRules, keep) -> DataFrame:
    """earlier, later: the numbers of all pairs of classes that match."""
    rows, x, y = _rows(classes, "number"), (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    pairs = rows.alias("x").join(rows.alias("y"), _fit(x, y, rules) & (x("number") < y("number"))).select(x("number").alias("earlier"), y("number").alias("later"))
    pairs = keep(pairs.distinct(), "line-pairs")
    wanted = pairs.select(F.explode(F.array("earlier", "later")).alias("number")).distinct()
    sets = _sets(docs, classes.join(wanted, "number", "left_semi").select("class_a", "class_b", "line_hash", "number"), levels, rules, keep)
    links = None
    for part in range(VERIFY_PARTS):
        own = pairs.where(F.pmod(F.xxhash64("earlier"), F.lit(VERIFY_PARTS)) == part)
        own = own.join(sets.select(F.col("number").alias("earlier"), F.col("keys").alias("_x")), "earlier").join(sets.select(F.col("number").alias("later"), F.col("keys").alias("_y")), "later")
        own = keep(own.where(_similar("_x", "_y", rules)).select("earlier", "later"), "line-links")
        links = own if links is None else links.unionByName(own)
    return links


def line_links(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """x_a, x_b, y_a, y_b: each pair of different classes of lines whose sets match, once."""
    with Scratch(docs.sparkSession) as tmp:
        levels = _rarity(docs, rules.rarity_bits)
        classes = _classes(_line_table(docs, levels, rules), tmp.cut)
        links = _links(docs, classes, levels, rules, tmp.cut)
        names = lambda number, x: classes.select(F.col("number").alias(number), F.col("class_a").alias(f"{x}_a"), F.col("class_b").alias(f"{x}_b"))
        return cut(links.join(names("earlier", "x"), "earlier").join(names("later", "y"), "later").drop("earlier", "later"), "line-links")


def mark_lines(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """doc_id, text_hash, line_no, class_a, class_b, removed, similar, n_links for each line with a word.

    class_a, class_b: the line's class, the same for equal sets of words. removed: an earlier line has the same set of
    words or one that matches; similar: none has the same. n_links: other sets that match the line's set.
    Of all that is written on the way only this table is left.
    """
    with Scratch(docs.sparkSession) as tmp:
        levels = _rarity(docs, rules.rarity_bits)
        lines, classes = _lines_and_classes(docs, levels, rules, tmp)
        links = _links(docs, classes, levels, rules, tmp.cut)
        ends = F.array(F.struct(F.col("earlier").alias("number"), F.lit(False).alias("later")), F.struct(F.col("later").alias("number"), F.lit(True).alias("later")))
        linked = links.select(F.explode(ends).alias("e")).groupBy("e.number").agg(F.max("e.later").alias("later"), F.count(F.lit(1)).alias("n_links"))
        known = classes.select("class_a", "class_b", "first", "number").join(linked, "number", "left").drop("number")
        joined = lines.join(known, ["class_a", "class_b"])
        later = F.coalesce("later", F.lit(False))
        marks = joined.select("doc_id", "text_hash", "line_no", "class_a", "class_b", (later | (F.col("first") < _place())).alias("removed"), (later & (F.col("first") >= _place())).alias("similar"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
        return cut(marks, "line-marks")


def _by_document(marks: DataFrame, *more: Column) -> DataFrame:
    return marks.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_set(F.when(F.col("removed"), F.col("line_no")))).alias("removed_lines"),
        F.countDistinct(F.when(F.col("similar"), F.col("line_no"))).alias("n_similar"),
        *more,
    )


def _on(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_hash"] == right["text_hash"])


def judge_lines(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_lines, n_removed, removed_lines (from 0), n_similar (removed for a line
    whose words differ), most_links (of one line to other sets of words), line_classes (line_no, class_a, class_b and
    n_links of each line with a word; lines of one class have the same set of words).

    A null text has no lines; an empty one has one, without words. Lines without words stay and match nothing.
    Rows with equal doc_id and text are one document and get the same result; null ids come last in the order.
    An empty table gives an empty table. Other columns are not read.
    """
    classes = F.sort_array(F.collect_set(F.struct("line_no", "class_a", "class_b", "n_links"))).alias("line_classes")
    found = _by_document(mark_lines(docs, rules), F.max("n_links").alias("most_links"), classes)
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"))
    lines = F.coalesce(found["removed_lines"], F.array().cast("array<int>"))
    return own.join(found, _on(own, found), "left").select(own["doc_id"], "n_lines", F.size(lines).cast("long").alias("n_removed"), lines.alias("removed_lines"), F.coalesce("n_similar", F.lit(0)).alias("n_similar"), F.coalesce("most_links", F.lit(0)).alias("most_links"), F.coalesce("line_classes", F.array().cast(found.schema["line_classes"].dataType)).alias("line_classes"))


def dedup_lines(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """``docs`` without the removed lines, with all columns and nothing else; a text may end up empty, no row goes.

    Each line looks up its own byte in a mask of its document's lines, so a text of very many lines takes time in proportion.
    """
    found = removed_lines(docs, rules)
    gone = F.col("removed_lines")
    before = F.concat(F.array(F.lit(-1)), F.slice(gone, F.lit(1), F.size(gone) - 1))
    mask = F.array_join(F.zip_with(before, gone, lambda a, b: F.concat(F.repeat(F.lit("0"), b - a - 1), F.lit("1"))), "").cast("binary")
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), mask.alias("_mask"))
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]) & (F.xxhash64(docs["text"]) == found["_hash"]), "left")
    kept = F.array_join(F.filter(F.split(docs["text"], "\n", -1), lambda x, i: F.substring(found["_mask"], i + 1, F.lit(1)) != F.lit(b"1")), "\n")
    text = F.when(found["_mask"].isNull(), docs["text"]).otherwise(kept).alias("text")
    return joined.select(*(text if c == "text" else docs[c] for c in docs.columns))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_lines(documents(spark, sf_dir))
