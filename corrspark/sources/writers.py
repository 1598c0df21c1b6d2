"""Writers of the text formats. Each writes a folder of part files from all tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrspark.functions.sequence import wrap
from corrspark.operators import signal


def _text(lines: DataFrame, path: str, compress: bool) -> None:
    lines.write.mode("overwrite").option("compression", "gzip" if compress else "none").text(path)


def fasta(seqs: DataFrame, path: str, width: int = 60, compress: bool = False) -> None:
    _text(seqs.select(F.concat(F.lit(">"), F.col("name"), F.lit("\n"), wrap(F.col("seq"), width)).alias("value")), path, compress)


def delimited(df: DataFrame, path: str, header: bool = False, compress: bool = False, by: list[str] = ()) -> None:
    """BED, bedGraph, FAI and TSV: tab-separated columns as they are; arrays are joined by commas."""
    joined = df.select(*[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) if k.startswith("array") else F.col(c) for c, k in df.dtypes])
    writer = joined.write.mode("overwrite").options(sep="\t", header=header, emptyValue="", nullValue="", quote="\u0000", compression="gzip" if compress else "none")
    (writer.partitionBy(*by) if by else writer).csv(path)


def metrics(df: DataFrame, path: str) -> None:
    """anchor_id, fraction with six digits or NaN, n_unique, n_kmers."""
    delimited(df.select("anchor_id", F.when(F.col("fraction").isNull(), "NaN").otherwise(F.format_string("%.6f", "fraction")).alias("UniqueKmerFrac"), F.col("n_unique").alias("NumUnique"), F.col("n_kmers").alias("NumKmers")), path, header=True)


def coverage(smooth: DataFrame, path: str, by: list[str]) -> None:
    """pos1, coverage_raw, coverage_smooth of all positions, gzipped, in a folder for each key, in order within it."""
    rows = signal.coverage(smooth, by)
    delimited(rows.repartitionByRange(*by, "pos1").sortWithinPartitions(*by, "pos1"), path, header=True, compress=True, by=by)


def paf(records: DataFrame, path: str, by: list[str] = ()) -> None:
    """``by``: columns that make folders."""
    fixed = [F.col(c).cast("string") for c in ("qname", "qlen", "qstart", "qend", "strand", "tname", "tlen", "tstart", "tend", "nmatch", "alen", "mapq")]
    lines = records.select(F.concat_ws("\t", *fixed, "tags").alias("value"), *by)
    writer = lines.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).text(path)


def ids(df: DataFrame, path: str, column: str) -> None:
    _text(df.select(F.col(column).cast("string").alias("value")).distinct().orderBy("value"), path, False)


def whole_contigs(lengths: DataFrame, label: str) -> DataFrame:
    """A BED row over each contig, so that masking by the label leaves all of it."""
    return lengths.select(F.col("name").alias("chrom"), F.lit(0).cast("long").alias("start"), F.col("length").alias("end"), F.lit(label).alias("name"))
