import pytest
from pyspark.sql import functions as F

from corrspark.operators import signal


def dense(spark, values, masked=()):
    return spark.createDataFrame([("c", i, float(v), i in masked) for i, v in enumerate(values)], "chrom string, pos long, value double, masked boolean")


@pytest.mark.parametrize("chunk", [2, 3, 1000])
def test_moving_average(spark, chunk):
    got = signal.moving_average(dense(spark, [1, 2, 3, 4, 5]), ["chrom"], 2, chunk=chunk).orderBy("pos").collect()
    assert [r["sm"] for r in got] == [1.5, 2, 3, 4, 4.5]


def test_percentile_place(spark):
    df = dense(spark, range(10)).withColumn("sm", F.col("value"))
    assert signal.percentile_threshold(df, ["chrom"], 30).first()["thr"] == 3
    assert signal.percentile_threshold(df, ["chrom"], 100).first()["thr"] == 9


def test_minima_and_suppression(spark):
    df = dense(spark, [5, 1, 1, 5]).withColumn("sm", F.col("value"))
    thr = spark.createDataFrame([("c", 1.0)], "chrom string, thr double")
    found = signal.local_minima(df, thr, ["chrom"], 1)
    assert sorted(r["pos"] for r in found.collect()) == [1, 2]
    assert [r["pos"] for r in signal.suppress(found, ["chrom"], 1).collect()] == [1]


def test_masked_positions_do_not_count(spark):
    df = signal.mask_override(dense(spark, [0, 3, 2, 3], masked={0}).withColumn("sm", F.col("value")), ["chrom"])
    thr = spark.createDataFrame([("c", 9.0)], "chrom string, thr double")
    assert [r["pos"] for r in signal.local_minima(df, thr, ["chrom"], 2).collect()] == [2]


def test_anchor_ids_and_scores(spark):
    spans = spark.createDataFrame([("c", 40, 45, 41, 2.345), ("c", 50, 51, 50, 0.125)], "chrom string, start long, end long, pos long, sm double")
    got = signal.anchors(spans, ["chrom"], 100, 2).collect()
    assert [(r["anchor_id"], r["strand"]) for r in got] == [("anchor_42", "+")]


def test_densify_and_runs(spark):
    runs = spark.createDataFrame([("c", -2, 2, 1.0, 0), ("c", 1, 3, 2.0, 1)], "chrom string, start long, end long, value double, row int")
    lengths = spark.createDataFrame([("c", 5)], "chrom string, length long")
    points = signal.densify(runs, lengths, ["chrom"])
    assert [r["value"] for r in points.orderBy("pos").collect()] == [1, 2, 2, 0, 0]
    assert sorted((r["start"], r["end"], r["value"]) for r in signal.encode_runs(points, ["chrom"]).collect()) == [(0, 1, 1), (1, 3, 2), (3, 5, 0)]
