import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corrspark.functions import cigar, sequence, text
from corrspark.operators import kmers, records, sketch
from corrspark.sources import readers, writers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_sequence_functions(spark):
    assert one(spark, sequence.reverse_complement(F.lit("AACn"))) == "nGTT"
    assert one(spark, sequence.reverse_complement(F.lit("aNn"), "swap_n")) == "Nnt"
    assert one(spark, sequence.reverse_complement(F.lit("aN"), "upper")) == "NT"
    iv = F.array(F.struct(F.lit(1).alias("start"), F.lit(3).alias("end")), F.struct(F.lit(5).alias("start"), F.lit(9).alias("end")))
    assert one(spark, sequence.mask(F.lit("ACGTAC"), iv)) == "AnnTAn"
    assert one(spark, sequence.mask(F.lit("ACGTAC"), iv, soft=True)) == "AcgTAc"
    assert one(spark, sequence.wrap(F.lit("ACGTA"), 2)) == "AC\nGT\nA"
    assert one(spark, sequence.fetch(F.lit("ACGT"), F.lit(1), F.lit(3))) == "CG"
    assert one(spark, sequence.fetch(F.lit("ACGT"), F.lit(3), F.lit(3))) == ""


def test_kmers(spark):
    seqs = spark.createDataFrame([("a", "ACGNAC"), ("b", "GT"), ("c", None)], "name string, seq string")
    assert {r["kmer"]: r["n"] for r in kmers.count(seqs, 2).collect()} == {"AC": 3, "CG": 1}
    rare = kmers.limited(kmers.count(seqs, 2), 1)
    got = {r["name"]: (r["n_kmers"], r["n_unique"], r["fraction"]) for r in kmers.unique_fraction(seqs, rare, ["name"], 2).collect()}
    assert got == {"a": (3, 1, 1 / 3), "b": (1, 0, 0.0), "c": (0, 0, None)}


def test_groups_of_strands(spark):
    seqs = spark.createDataFrame([("a", "ACGTTGCAAC"), ("b", "GTTGCAACGT"), ("c", ""), ("d", "NNNN"), ("e", "TTTTTTTTGG")], "name string, seq string")
    for groups in (sketch.minhash_groups(seqs, ["name"], 4), sketch.md5_groups(seqs, ["name"], 4)):
        g = {r["name"]: r["group_id"] for r in groups.collect()}
        assert g["a"] == g["b"] and g["c"] == g["d"] and len(set(g.values())) == 3


def test_cigars(spark):
    ops = cigar.parse(F.lit("10=3I5X2D"))
    assert [one(spark, f(ops)) for f in (cigar.reference_bases, cigar.query_bases, cigar.matches, cigar.alignment_length)] == [17, 18, 10, 20]
    assert one(spark, cigar.parse(F.lit("10=Z"))) is None and one(spark, cigar.parse(F.lit("0="))) is None and one(spark, cigar.parse(F.lit(""))) is None
    assert one(spark, cigar.render(cigar.normalize(cigar.parse(F.lit("5M5=2I3I1X"))))) == "10=5I1X"
    df = spark.createDataFrame([("600=150I10X600=",), ("5=",), ("10D600=150I10X600=",), ("5=120D5=3X",), ("300X150I5=",)], "c string")
    got = df.withColumn("o", cigar.normalize(cigar.parse(F.col("c")))).select(cigar.simplify(F.col("o")).alias("s")).select(cigar.render(F.col("s.ops")).alias("c"), "s.mode").collect()
    assert [tuple(r) for r in got] == [("600=150I610=", "1I"), ("5=", "raw"), ("600=140I620=", "1I"), ("5=120D8=", "1D"), ("300X150I5=", "raw")]


def plain_trim(ops, t, q, window):
    """Takes one base after the other from the ends, by the stated rule."""
    (ts, te), (qs, qe) = t, q
    t_low, t_high, q_low, q_high = window
    gone = []
    for side, (need_t, need_q) in enumerate(((max(0, t_low - ts), max(0, q_low - qs)), (max(0, te - t_high), max(0, qe - q_high)))):
        held, gt, gq = (ops if side == 0 else ops[::-1]), 0, 0
        held = list(held)
        while held and (need_t > 0 or need_q > 0):
            n, op = held[0]
            if op in "=MX":
                k = min(n, max(need_t, need_q))
            else:
                own = need_t if op == "D" else need_q
                k = min(n, max(own, 0))
                if k == 0:
                    if side:
                        return None
                    k = n
            gt, gq = gt + k * (op != "I"), gq + k * (op != "D")
            need_t, need_q = need_t - k * (op != "I"), need_q - k * (op != "D")
            held[:1] = [(n - k, op)] if k < n else []
        ops = held if side == 0 else held[::-1]
        gone.append((gt, gq))
    ends = ts + gone[0][0], te - gone[1][0], qs + gone[0][1], qe - gone[1][1]
    good = ops and ends[0] < ends[1] and ends[2] < ends[3] and t_low <= ends[0] and ends[1] <= t_high and q_low <= ends[2] and ends[3] <= q_high
    return ("".join(f"{n}{op}" for n, op in ops), *ends) if good else None


def test_trim_to_window(spark):
    rng = random.Random(3)
    rows, want = [], []
    for i in range(150):
        ops = [(rng.randint(1, 9), rng.choice("==XID")) for _ in range(rng.randint(1, 9))]
        ref, qry = sum(n for n, op in ops if op != "I"), sum(n for n, op in ops if op != "D")
        window = (100 + rng.randint(-1, 6), 100 + ref - rng.randint(-1, 6), 200 + rng.randint(-1, 6), 200 + qry - rng.randint(-1, 6))
        rows.append((i, "".join(f"{n}{op}" for n, op in ops), 100, 100 + ref, 200, 200 + qry, *window))
        want.append(plain_trim(ops, (100, 100 + ref), (200, 200 + qry), window))
    df = spark.createDataFrame(rows, "i int, c string, tstart long, tend long, qstart long, qend long, a long, b long, d long, e long").withColumn("ops", cigar.parse(F.col("c")))
    out = cigar.trim_to_window(df, tuple(F.col(x) for x in "abde")).orderBy("i").select(cigar.render(F.col("ops")).alias("c"), "tstart", "tend", "qstart", "qend").collect()
    got = [tuple(r) if r["c"] is not None else None for r in out]
    assert got == want and sum(x is not None for x in want) > 30


def test_masks_of_many_intervals(spark):
    seq = "ACGTN" * 40
    ivs = [(a, a + 2) for a in range(0, 200, 7)] + [(-5, 0), (199, 300)]
    plain = "".join("n" if any(a <= i < b for a, b in ivs) else c for i, c in enumerate(seq))
    df = spark.createDataFrame([(seq, ivs[::-1])], "s string, iv array<struct<start:int,end:int>>")
    assert df.select(sequence.mask(F.col("s"), F.col("iv"))).first()[0] == plain
    assert df.select(sequence.mask(F.col("s"), F.col("iv"), soft=True)).first()[0] == "".join(c.lower() if p == "n" else c for c, p in zip(seq, plain))


def test_kmers_across_pieces(spark):
    rng = random.Random(5)
    seq = "".join(rng.choice("ACGTACGTACGTN") for _ in range(9000))
    turn = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
    want = {(p, min(seq[p : p + 11], turn(seq[p : p + 11]))) for p in range(len(seq) - 10) if "N" not in seq[p : p + 11]}
    df = spark.createDataFrame([("a", seq), ("b", "ACG"), ("c", None)], "name string, seq string")
    assert {(r["pos"], r["kmer"]) for r in kmers.positions(df, ["name"], 11).collect()} == want
    got = {r["name"]: tuple(r)[1:] for r in kmers.single_fraction(df, ["name"], 11).collect()}
    once = sum(n == 1 for n in Counter(k for _, k in want).values())
    assert got == {"a": (len(want), once, once / len(want)), "b": (0, 0, None), "c": (0, 0, None)}


def test_split_insertion(spark):
    row = spark.createDataFrame([("t", "q", "+", 0, 1210, 0, 1360, 1210, 1360, "600=150I610=")], "tname string, qname string, strand string, tstart long, tend long, qstart long, qend long, nmatch long, alen long, cigar string")
    got = sorted((r["half"], r["cigar"], r["tstart"], r["tend"], r["qstart"], r["qend"], r["hidden"]) for r in records.split_insertions(row, 500).collect())
    assert got == [(0, "600=", 0, 600, 0, 600, 150), (1, "610=", 600, 1210, 750, 1360, 150)]


def test_contigs(spark):
    contigs = spark.createDataFrame([("chr1:0-5", 5), ("chr1__x", 9), ("chr2", 3)], "contig string, length long")
    wanted = spark.createDataFrame([("chr2",), ("chr1",), ("chr9",)], "name string")
    got = {r["name"]: r["contig"] for r in records.resolve_contigs(wanted, contigs, "name").collect()}
    assert got == {"chr2": "chr2", "chr1": "chr1__x", "chr9": None}


def test_text_formats(spark, tmp_path):
    fa = tmp_path / "a.fa"
    fa.write_text(">c1 first\nACgt\nNN\n>c2\nAC\n")
    assert sorted((r["name"], r["seq"]) for r in readers.fasta(spark, str(fa)).collect()) == [("c1", "ACGTNN"), ("c2", "AC")]
    writers.fasta(readers.fasta(spark, str(fa), upper=False), str(tmp_path / "out"), 3)
    assert sorted((r["name"], r["seq"]) for r in readers.fasta(spark, str(tmp_path / "out"), upper=False).collect()) == [("c1", "ACgtNN"), ("c2", "AC")]
    bed = tmp_path / "a.bed"
    bed.write_text("track x\n#c\nc1\t1\t5\tHSat2\nc1\tx\t5\nc1\t7\t7\nc1\t0\t9\tn\t3\t-\ta\tb\n")
    assert sorted(tuple(r) for r in readers.bed(spark, str(bed)).collect()) == [("c1", 0, 9, "n", "3", "-", ["a", "b"]), ("c1", 1, 5, "HSat2", "0", "+", [])]
    paf = tmp_path / "a.paf"
    paf.write_text("q\t9\t0\t5\t+\tt\t9\t1\t6\t5\t5\t60\tcg:Z:5=\nshort\n")
    rows = readers.paf(spark, str(paf))
    writers.paf(rows, str(tmp_path / "paf"))
    assert readers.paf(spark, str(tmp_path / "paf")).collect() == rows.collect()
    tsv = tmp_path / "m.tsv"
    tsv.write_text("anchor_id\tUniqueKmerFrac\tNumUnique\tNumKmers\na\t0.5\t1\t2\nb\tNaN\t0\t0\nc\tnone\t0\t0\n")
    m = readers.metrics(spark, str(tsv))
    assert {r["anchor_id"]: r["fraction"] for r in m.collect()} == {"a": 0.5, "b": None, "c": None}
    bits = tmp_path / "bits"
    bits.write_text(">a\n0110\n1\n>b\n\n")
    assert {r["anchor_id"]: (r["n_unique"], r["n_kmers"]) for r in readers.kmer_existence(spark, str(bits)).collect()} == {"a": (3, 5), "b": (0, 0)}


def test_names(tmp_path):
    assert text.distinct_names(["a", "b", "a", "a"]) == ["a", "b", "a_2", "a_3"]
    assert text.sample_and_base("x/s1/b.bed", ".bed") == ("s1", "b")
    (tmp_path / "l").write_text("p # c\n\nq\n")
    assert text.expand_inputs(["'a',b", f"@{tmp_path}/l"]) == ["a", "b", "p", "q"]


def test_inputs_and_short_hit_tables(spark, tmp_path):
    from corrspark.functions.text import expand_inputs
    from corrspark.sources import readers

    for name in ("b.fa", "a.fa"):
        (tmp_path / name).write_text(">x\nA\n")
    (tmp_path / "list").write_text("one.fa # first\n\n two.fa\n")
    given = [f"{tmp_path}/*.fa,c.fa", "'d.fa' e.fa", "none*.fa", f"@{tmp_path}/list", "c.fa"]
    assert expand_inputs(given) == [f"{tmp_path}/a.fa", f"{tmp_path}/b.fa", "c.fa", "d.fa", "e.fa", "none*.fa", "one.fa", "two.fa"]
    (tmp_path / "hits").write_text("q1\ts1\t99.5\t120\nq2\ts2\t90\n# note\nq3\ts3\t80.0\t7\t0\t0\t1\t7\t2\t8\t1e-5\t40\n")
    rows = readers.blast6(spark, str(tmp_path / "hits")).orderBy("qseqid").collect()
    assert [(r["qseqid"], r["pident"], r["length"], r["send"]) for r in rows] == [("q1", 99.5, 120, None), ("q3", 80.0, 7, 8)]


def _windows(rows, k):
    flip = str.maketrans("ACGT", "TGCA")
    return [(n, p, min(s[p : p + k], s[p : p + k].translate(flip)[::-1])) for n, s in rows for p in range(len(s) - k + 1) if "N" not in s[p : p + k]]


@pytest.mark.parametrize("k", [5, 13, 33])
def test_kmers_by_code_agree_with_windows_as_text(spark, monkeypatch, k):
    # pieces, tables, bitmaps and runs against plain windows, with N, letters besides the bases, and sequences of several pieces
    monkeypatch.setattr(kmers, "PIECE", 40)
    rng = random.Random(k)
    rows = [(i, "".join(rng.choice("ACGT" * 8 + "AAAAN" + "R" * (i % 3 == 0)) for _ in range(rng.choice((0, k - 1, k, 90, 200))))) for i in range(20)] + [(20, "A" * 150), (21, "ACGTTGCA" * 20)]
    seqs = spark.createDataFrame(rows, "name int, seq string").repartition(3)
    all_windows = _windows(rows, k)
    n = Counter(w for *_, w in all_windows)
    assert {r["kmer"]: r["n"] for r in kmers.count(seqs, k).collect()} == n
    rare = kmers.limited(kmers.count(seqs, k), 2)
    got = {r["name"]: (r["n_kmers"], r["n_unique"]) for r in kmers.unique_fraction(seqs, rare, ["name"], k).collect()}
    assert got == {i: (sum(x == i for x, *_ in all_windows), sum(x == i and n[w] <= 2 for x, _, w in all_windows)) for i, _ in rows}
    single = {r["name"]: r["n_unique"] for r in kmers.single_fraction(seqs, ["name"], k).collect()}
    assert single == {i: sum(x == i and n[w] == 1 for x, _, w in all_windows) for i, _ in rows}
    covered = {(i, p + d) for i, p, w in all_windows if n[w] <= 2 for d in range(k)}
    runs = kmers.unique_runs(seqs, rare, ["name"], k).collect()
    assert sorted((r["name"], p) for r in runs for p in range(r["start"], r["end"])) == sorted(covered)
    assert all((r["name"], r["end"]) not in covered and (r["name"], r["start"] - 1) not in covered for r in runs)
    value = {(i, p): n[w] for i, p, w in all_windows}
    track = kmers.frequency_runs(seqs, ["name"], k).collect()
    assert sorted((r["name"], p, r["value"]) for r in track for p in range(r["start"], r["end"])) == sorted((*at, v) for at, v in value.items())
    assert all(value.get((r["name"], r["end"])) != r["value"] for r in track)


def test_kmers_are_not_rows_up_to_a_tables_length(spark, monkeypatch):
    # each position was a row of text, shuffled by k-mer and back
    def no(*_):
        raise AssertionError("a row for each position")

    monkeypatch.setattr(kmers, "positions", no)
    monkeypatch.setattr(sketch, "positions", no)
    seqs = spark.createDataFrame([(0, "ACGTTACGGRAC"), (1, "CCCCNA")], "name int, seq string")
    rare = kmers.limited(kmers.count(seqs, 4), 1)
    for df in (rare, kmers.unique_fraction(seqs, rare, ["name"], 4), kmers.unique_runs(seqs, rare, ["name"], 4), kmers.frequency_runs(seqs, ["name"], 4), sketch.md5_groups(seqs, ["name"], 4)):
        assert df.count() > 0


def test_sketches_by_code_agree_with_windows_as_text(spark, monkeypatch):
    monkeypatch.setattr(kmers, "BLOCK", 64)
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("ACGTACGTN" + "R" * (i % 2)) for _ in range(rng.choice((0, 30, 150))))) for i in range(20)]
    seqs = spark.createDataFrame(rows, "name int, seq string")
    own = {i: {w for x, _, w in _windows(rows, 6) if x == i} for i, _ in rows}
    least = lambda i: [min(hashlib.md5(f"{j}:{w}".encode()).hexdigest() for w in own[i]) for j in range(2)] if own[i] else []
    assert {r["name"]: r["group_id"] for r in sketch.md5_groups(seqs, ["name"], 6).collect()} == {i: "LSH:" + hashlib.md5("-".join(least(i)).encode()).hexdigest() for i, _ in rows}
    factors, offsets = sketch.permutations(80, 42)

    def group(kmers_of):
        mins = [min(int((np.uint64(int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")) * factors[j] + offsets[j]) % sketch.PRIME) for w in kmers_of) if kmers_of else 2**64 - 1 for j in range(2)]
        return "LSH:" + hashlib.blake2b(np.array(mins, np.uint64).tobytes(), digest_size=8).hexdigest()

    with np.errstate(over="ignore"):
        assert {r["name"]: r["group_id"] for r in sketch.minhash_groups(seqs, ["name"], 6).collect()} == {i: group(own[i]) for i, _ in rows}
