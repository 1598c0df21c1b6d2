"""Files: block-gzip in several tasks, order of records, settings, ids that do not match."""

import gzip
import random
import struct
import zlib

import pytest
from corrspark.operators import families, kmers
from corrspark.sources import blockgzip, readers
from pyspark.sql import Observation


def block_gzip(data: bytes, size: int) -> bytes:
    out = b""
    for part in [data[i : i + size] for i in range(0, len(data), size)] + [b""]:
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = deflate.compress(part) + deflate.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


@pytest.mark.parametrize("share", [200, 1500, 1 << 20])
def test_block_gzip_in_several_tasks(spark, tmp_path, share):
    rng = random.Random(share)
    records = [(f"c{i} more", "".join(rng.choice("ACGTn") for _ in range(rng.randrange(0, 900)))) for i in range(40)] + [("c3 again", "ACGT")]
    text = "".join(f">{n}\n" + "".join(f"{s[i:i + 60]}\n" for i in range(0, len(s), 60)) for n, s in records).rstrip("\n")
    path = tmp_path / "x.fa.bgz"
    path.write_bytes(block_gzip(text.encode(), 700))
    assert gzip.decompress(path.read_bytes()).decode() == text
    rows = blockgzip.lines(spark, [str(path)], share)
    assert [r["value"] for r in sorted(rows.collect(), key=lambda r: (r["share"], r["line"]))] == text.split("\n")
    assert share > 1500 or rows.rdd.getNumPartitions() > 3
    got = blockgzip.fasta_records(spark, [str(path)], share).orderBy("place").collect()
    assert [(r["header"], r["body"]) for r in got] == records
    last = {r["name"]: r["seq"] for r in readers.fasta_dictionary(spark, str(path)).collect()}
    assert last["c3"] == "ACGT" and len(last) == 40


def test_first_record_and_last_name(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">b x\nACG\nT\n>a\nAC\n>b\nGG\n")
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">z\nacgta\n>b\nTTT\n")
    paths = [str(tmp_path / "a.fa"), str(tmp_path / "b.fa.gz")]
    assert sorted((r["name"], r["length"]) for r in readers.fasta_lengths(spark, paths, first_only=True).collect()) == [("b", 4), ("z", 5)]
    assert {r["name"]: r["seq"] for r in readers.fasta_dictionary(spark, paths).collect()} == {"a": "AC", "b": "TTT", "z": "acgta"}


def test_settings_and_centers(spark, tmp_path):
    (tmp_path / "config.yaml").write_text("# first\nthreads: 8\nname: 'x y'  # note\n\nthreads: 4\n  k : 31\n")
    assert readers.settings(spark, str(tmp_path / "config.yaml")) == {"threads": "4", "name": "x y", "k": "31"}
    for lane, rows in (("s1", "c\t0\t10\ta\nc\t5\t6\tb\nbad\n"), ("s2", "c\t2\t4\ta\n")):
        (tmp_path / "work" / lane).mkdir(parents=True)
        (tmp_path / "work" / lane / "x.bed").write_text(rows)
    got = sorted(tuple(r) for r in readers.placed_centers(spark, str(tmp_path / "work")).collect())
    assert got == [("s1", "a", 5.0), ("s1", "b", 5.5), ("s2", "a", 3.0)]


def test_ids_that_do_not_match(spark):
    left, right = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "id string, x int"), spark.createDataFrame([("a",), ("c",), ("c",), ("d",)], "id string")
    seen = Observation()
    assert kmers.check_ids(left, right, "id", "warn", seen).count() == 3
    assert seen.get == {"n_rows": 3, "missing": 2, "extra": 2}
    assert kmers.check_ids(left, right, "id", "off").count() == 3
    with pytest.raises(Exception, match="an id is missing: b"):
        kmers.check_ids(left, right, "id").count()
    assert kmers.check_ids(left.where("id = 'a'"), right, "id").count() == 1
    with pytest.raises(ValueError, match="none of"):
        kmers.check_ids(left, right, "id", "maybe")


def test_family_pairs():
    assert families.sample_pairs(["a", "b", "c"]) == [("a", "b"), ("a", "c")] and families.sample_pairs(["a", "b", "c"], "c:a, x,b:c") == [("c", "a"), ("b", "c")]
    with pytest.raises(ValueError, match="no pair|not a pair"):
        families.sample_pairs(["a"], "a:b")


def test_family_file_to_records(spark, tmp_path):
    (tmp_path / "f.tsv").write_text("ref_anchor_id\tchrom_r1\tcenter_r1\tchrom_t\tcenter_t\tchrom_only\nx\tc1\t100.9\td1\t50\tz\ny\tc1\t300\t\t20\tz\n\tc1\t5\td1\tnan\tz\nw\tc2\t1\td1\t400\tz\n")
    wide = readers.families(spark, str(tmp_path / "f.tsv"))
    assert families.samples(wide) == ["r1", "t"]
    got = sorted((r["qname"], r["qlen"], r["qstart"], r["qend"], r["tname"], r["tlen"], r["tstart"], r["tend"], r["tags"], r["path_name"]) for r in families.family_records(wide, 60, [("r1", "t")]).collect())
    assert got == [("c1", 360, 40, 160, "d1", 460, 0, 110, ["id:Z:x"], "r1_vs_t"), ("c2", 61, 0, 61, "d1", 460, 340, 460, ["id:Z:w"], "r1_vs_t")]
