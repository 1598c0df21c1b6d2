import pytest
from pyspark.sql import functions as F

from corrspark.functions.labels import matches_label
from corrspark.operators import intervals


def iv(spark, rows):
    return spark.createDataFrame([("c", a, b) for a, b in rows], "chrom string, start long, end long")


def pairs(df):
    return sorted((r["start"], r["end"]) for r in df.collect())


@pytest.mark.parametrize("gap,want", [(0, [(0, 8), (10, 12)]), (2, [(0, 12)])])
def test_merge(spark, gap, want):
    for width in (4, 1 << 20):
        assert pairs(intervals.merge(iv(spark, [(0, 5), (5, 8), (10, 12), (7, 7)]), ["chrom"], gap, width)) == want


def test_complement(spark):
    lengths = spark.createDataFrame([("c", 10), ("d", 5), ("e", 0)], "chrom string, length long")
    got = sorted(tuple(r) for r in intervals.complement(iv(spark, [(2, 4), (6, 8)]), lengths, ["chrom"]).collect())
    assert got == [("c", 0, 2), ("c", 4, 6), ("c", 8, 10), ("d", 0, 5)]


def test_pad_and_expand(spark):
    lengths = spark.createDataFrame([("c", 10)], "chrom string, length long")
    assert pairs(intervals.pad(iv(spark, [(1, 3), (9, 10)]), lengths, ["chrom"], 2)) == [(0, 5), (7, 10)]
    assert pairs(intervals.expand(iv(spark, [(1, 3)]), [2, 5])) == [(0, 5), (0, 8)]


def test_overlap_across_bins(spark):
    left, right = iv(spark, [(0, 3), (3, 30), (3, 30), (40, 41)]), iv(spark, [(25, 27)])
    assert pairs(intervals.overlapping(left, right, ["chrom"], True, 8)) == [(3, 30), (3, 30)]
    assert pairs(intervals.overlapping(left, right, ["chrom"], False, 8)) == [(0, 3), (40, 41)]


def test_labels(spark):
    df = spark.createDataFrame([("HSat2",), (None,), ("x",)], "name string")
    hits = lambda *a, **k: [r["name"] for r in df.where(matches_label(F.col("name"), *a, **k)).collect()]
    assert hits(["sat"]) == ["HSat2"]
    assert hits([]) == ["HSat2", None, "x"]
    assert hits(["sat"], invert=True) == [None, "x"]
