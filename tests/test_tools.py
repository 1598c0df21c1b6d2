"""The tools over small files."""

import gzip
import random

import pytest
from corrspark.__main__ import main


def lines(folder):
    out = []
    for p in sorted(folder.rglob("part-*")):
        out += (gzip.open(p, "rt") if p.suffix == ".gz" else open(p)).read().splitlines()
    return out


def test_mask(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">c1\nACGTACGT\n")
    (tmp_path / "a.bed").write_text("c1\t2\t5\tHSat2\n")
    for flags, want in (([], "nnGTAnnn"), (["--soft"], "acGTAcgt"), (["--invert", "--char", "N"], "ACNNNCGT")):
        main(["mask", "--fasta", str(tmp_path / "a.fa"), "--bed", str(tmp_path / "a.bed"), "--names", "a", "--outdir", str(tmp_path / "m"), *flags])
        assert lines(tmp_path / "m") == [">a|c1", want]


def test_anchors_from_a_track(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">c1\n" + "A" * 400 + "\n>c2\n" + "A" * 50 + "\n")
    (tmp_path / "t.bg").write_text("".join(f"c1 {i} {i + 1} {0.1 if 190 <= i < 215 else 2.0 + i % 3}\n" for i in range(400)))
    main(["anchors", "--fasta", str(tmp_path / "a.fa"), "--bedgraph", str(tmp_path / "t.bg"), "--first-only", "--window", "5", "--percent", "4", "--min-anchor", "5", "--outdir", str(tmp_path / "o")])
    (row,) = lines(tmp_path / "o/anchors")
    chrom, start, end = row.split("\t")[:3]
    assert chrom == "c1" and 180 <= int(start) <= 195 and 210 <= int(end) <= 225
    table = lines(tmp_path / "o/coverage")
    assert table[0] == "pos1\tcoverage_raw\tcoverage_smooth" and table[1].startswith("1\t2.000000\t") and sum(x[0].isdigit() for x in table) == 400


def test_unique_then_filter(spark, tmp_path):
    rng = random.Random(1)
    own = "".join(rng.choice("ACGT") for _ in range(60))
    (tmp_path / "whole.fa").write_text(f">c1\n{own}{'ACGTTGCA' * 30}\n")
    (tmp_path / "anchors.fa").write_text(f">a1\n{own}\n>a2\nACG\n")
    (tmp_path / "anchors.bed").write_text("c1\t0\t60\ta1\nc1\t60\t63\ta2\n")
    main(["unique", "--anchors", str(tmp_path / "anchors.fa"), "--fasta", str(tmp_path / "whole.fa"), "-k", "9", "--max-count", "2", "--outdir", str(tmp_path / "u")])
    rows = {x.split("\t")[0]: x.split("\t")[1] for x in lines(tmp_path / "u") if x.startswith("a")}
    assert float(rows["a1"]) > 0.9 and rows["a2"] == "NaN"
    args = ["filter", "--bed", str(tmp_path / "anchors.bed"), "--fasta", str(tmp_path / "anchors.fa"), "--metrics", str(tmp_path / "u"), "--outdir", str(tmp_path / "f")]
    main([*args, "--least", "0.5"])
    assert lines(tmp_path / "f/ids") == ["a1"] and lines(tmp_path / "f/bed") == ["c1\t0\t60\ta1\t0\t+"] and lines(tmp_path / "f/fasta")[0] == ">a1"
    (tmp_path / "anchors.fa").write_text(">other\nACG\n")
    with pytest.raises(Exception, match="an id is missing: a1"):
        main(args)


def test_bundles_patches_and_families(spark, tmp_path):
    rng = random.Random(2)
    seq = "".join(rng.choice("ACGT") for _ in range(2000))
    (tmp_path / "r.fa").write_text(f">c1\n{seq}\n")
    (tmp_path / "q.fa").write_text(f">c1:1-9\n{seq[100:]}\n")
    (tmp_path / "b.tsv").write_text("chrom\tref_start\tref_end\tqry_start\tqry_end\tstrand\nc1\t300.0\t500\t200\t400\t+\nc1\t900\t1000\t800\t900\t+\n")
    main(["bundles-to-paf", "--bundles", str(tmp_path / "b.tsv"), "--ref", str(tmp_path / "r.fa"), "--qry", str(tmp_path / "q.fa"), "--flank", "10", "--outdir", str(tmp_path / "p")])
    rows = sorted(x.split("\t") for x in lines(tmp_path / "p"))
    assert [r[:10] for r in rows] == [["c1:1-9", "1900", "190", "410", "+", "c1", "2000", "290", "510", "220"], ["c1:1-9", "1900", "790", "910", "+", "c1", "2000", "890", "1010", "120"]]
    main(["patch-gaps", "--paf", str(tmp_path / "p"), "--ref", str(tmp_path / "r.fa"), "--qry", str(tmp_path / "q.fa"), "--flank", "50", "--keep-overlap", "20", "--outdir", str(tmp_path / "g")])
    out = lines(tmp_path / "g")
    assert [x.split("\t")[7:9] for x in out[:2]] in ([["290", "510"], ["890", "1010"]], [["890", "1010"], ["290", "510"]])
    assert out[2].split("\t")[7:9] == ["490", "910"] and "cg:Z:420=" in out[2] and len(out) == 3
    (tmp_path / "f.tsv").write_text("ref_anchor_id\tchrom_a\tcenter_a\tchrom_b\tcenter_b\nx\tc1\t100\td1\t50\n")
    main(["families-to-paf", "--families", str(tmp_path / "f.tsv"), "--outdir", str(tmp_path / "fam")])
    assert (tmp_path / "fam/path_name=a_vs_b").exists() and lines(tmp_path / "fam")[0].endswith("id:Z:x")
    main(["split", "--fasta", str(tmp_path / "r.fa"), "--least", "1000", "--outdir", str(tmp_path / "s")])
    assert lines(tmp_path / "s/long")[0] == ">c1" and lines(tmp_path / "s/short") == []


def test_correspond_tool(spark, tmp_path):
    rng = random.Random(5)
    kinds = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(8)]
    at, bed, fa = 0, [], []
    for i in range(60):
        at += rng.randrange(80, 400)
        bed.append((at, at + 60, f"a{i}"))
        fa.append(f">a{i}\n{rng.choice(kinds)}\n")
    for n, shift in (("r", 0), ("q", 30)):
        (tmp_path / f"{n}.bed").write_text("".join(f"c1\t{s + shift}\t{e + shift}\t{x}\n" for s, e, x in bed))
        (tmp_path / f"{n}.fa").write_text("".join(fa))
    args = [x for n in "rq" for x in ("--fasta", str(tmp_path / f"{n}.fa"), "--bed", str(tmp_path / f"{n}.bed"))]
    (tmp_path / "c.yaml").write_text("min_links: 3\ngap_bin: 20\n")
    main(["correspond", *args, "--names", "r,q", "--contexts", "3", "--longest-unique", "7", "--config", str(tmp_path / "c.yaml"), "--min-span", "0", "--outdir", str(tmp_path / "o")])
    pairs = [x.split("\t") for x in lines(tmp_path / "o/pairs") if not x.startswith("qid")]
    assert len(pairs) > 40 and all(q.split("|")[-1] == r.split("|")[-1] for q, r, *_ in pairs)
    assert any("B000001" in x for x in lines(tmp_path / "o/bundles"))
