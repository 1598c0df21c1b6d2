import random

from corrspark.__main__ import main
from corrspark.plans.pipeline import Settings, correspond, find_anchors, mask, masked_intervals
from corrspark.streaming import ingest


def test_masking(spark):
    seqs = spark.createDataFrame([("a", "c1", "ACGTACGT"), ("a", "c2", "AC")], "sample string, chrom string, seq string")
    iv = spark.createDataFrame([("a", "c1", 2, 5, "HSat2")], "sample string, chrom string, start long, end long, name string")
    hidden = masked_intervals(seqs, iv, Settings())
    assert {r["chrom"]: r["seq"] for r in mask(seqs, hidden).collect()} == {"c1": "nnGTAnnn", "c2": "nn"}


def test_anchors_of_a_repeat(spark):
    rng = random.Random(1)
    seq = "ACGTTGCA" * 40 + "".join(rng.choice("ACGT") for _ in range(200)) + "ACGTTGCA" * 40
    seqs = spark.createDataFrame([("a", "c1", seq)], "sample string, chrom string, seq string")
    none = spark.createDataFrame([], "sample string, chrom string, start long, end long")
    anchors, high = find_anchors(seqs, none, Settings(window=11, radius=20, min_anchor=5))
    rows = anchors.collect()
    assert rows and all(r["start"] < 540 and r["end"] > 300 for r in rows) and high.count() >= 1


def test_correspondence_of_a_copy(spark):
    rng = random.Random(2)
    rows, at = [], 0.0
    for i in range(60):
        at += rng.randrange(20, 200)
        g = rng.choice("abcdefghij")
        rows += [("r", "c", f"a{i}", at, g), ("q", "c", f"b{i}", at + 7, g)]
    anchors = spark.createDataFrame(rows, "sample string, chrom string, anchor_id string, center double, gid string")
    found = correspond(anchors, "r", Settings(contexts=(1, 2, 3), min_span=0.0, gap_bin=10.0, longest_unique=9))
    known, assigned, bundles = found.dictionary, found.assigned, found.bundles
    good = assigned.where("status = 'assign'").collect()
    assert len(good) > 30 and sum(x["qid"].split("b")[-1] == x["rid"].split("a")[-1] for x in good) == len(good)
    assert bundles.first()["n_links"] > 30 and known.where("not ambiguous").count() > 30


def test_files_to_files(spark, tmp_path):
    rng = random.Random(3)
    seq = "".join(rng.choice("ACGT") for _ in range(3000))
    for n in "rq":
        (tmp_path / f"{n}.fa").write_text(f">c1\n{seq}\n")
        (tmp_path / f"{n}.bed").write_text("c1\t0\t3000\tHSat2\n")
    args = [x for n in "rq" for x in ("--fasta", str(tmp_path / f"{n}.fa"), "--bed", str(tmp_path / f"{n}.bed"))]
    main(["run", *args, "--names", "r,q", "--outdir", str(tmp_path / "out")])
    assert all((tmp_path / "out" / x).exists() for x in ("assignments", "masked", "pairs", "bundles", "records"))


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.bed").write_text("c1\t0\t5\tx\n#\nc1\tz\t5\tx\nc2\t5\t9\ty\n")
    ingest.append_to(ingest.interval_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(tuple(r) for r in ingest.label_totals(spark.read.parquet(str(tmp_path / "out"))).collect()) == [("c1", "x", 1, 5), ("c2", "y", 1, 4)]
