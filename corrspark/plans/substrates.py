"""Inputs of the operators, derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LENGTH = 4000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled intervals: order lines as [ship day, + quantity) on 20 contigs, with the part's type as label."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("name"))
    lines = table(spark, sf_dir, "lineitem")
    start = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    return lines.join(parts, "l_partkey").select(F.concat(F.lit("c"), (F.col("l_suppkey") % 20).cast("string")).alias("chrom"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"), "name", "l_orderkey", "l_linestatus", "l_discount", "l_quantity")


def lengths(iv: DataFrame) -> DataFrame:
    return iv.select("chrom").distinct().withColumn("length", F.lit(LENGTH).cast("long"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom (return flag), pos (ship day), value (lines that day)."""
    pos = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("chrom"), pos.alias("pos")).agg(F.count(F.lit(1)).alias("value"))


def masked_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smoothed signal; days of a low order count of the week's first day are masked."""
    from corrspark.operators.signal import mask_override, moving_average

    smooth = moving_average(signal(spark, sf_dir), ["chrom"], 50)
    return mask_override(smooth.withColumn("masked", F.col("pos") % 97 < 5), ["chrom"])


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, seq: the letters a to z of all documents as bases."""
    letters = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]", "")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC").alias("seq"))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, chrom, anchor_id, center, gid: events of a user, by minute; even users are the reference."""
    minutes = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 60_000_000)
    return table(spark, sf_dir, "events").select((F.col("user_id") % 2).cast("int").alias("sample"), F.floor(F.col("user_id") / 2).alias("chrom"), F.col("event_id").alias("anchor_id"), minutes.cast("double").alias("center"), F.col("event_type").alias("gid"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 60_000_000).cast("double")
    return table(spark, sf_dir, "events").select(F.floor(F.col("user_id") / 20).alias("chrom"), minutes.alias("ref_center"), (minutes + F.col("value") / 10).alias("qry_center"), F.col("event_id").alias("rid"), F.col("event_id").alias("qid"))


def cigars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, cigar: an operation for each line, in order."""
    op = F.when(F.col("l_returnflag") == "A", "=").when(F.col("l_returnflag") == "N", "I").otherwise("X")
    step = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("n"), op.alias("op"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(step)).alias("s")).select("l_orderkey", F.array_join(F.transform("s", lambda x: F.concat(x["n"].cast("string"), x["op"])), "").alias("cigar"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment records: intervals against five query contigs."""
    iv = intervals(spark, sf_dir)
    return iv.select(
        F.concat(F.lit("q"), (F.col("l_orderkey") % 5).cast("string")).alias("qname"),
        F.lit(LENGTH).cast("long").alias("qlen"),
        F.col("start").alias("qstart"),
        F.col("end").alias("qend"),
        F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"),
        F.col("chrom").alias("tname"),
        F.lit(LENGTH).cast("long").alias("tlen"),
        F.col("start").alias("tstart"),
        F.col("end").alias("tend"),
        (F.col("l_quantity") - F.floor(F.col("l_discount") * 100) % 3).cast("long").alias("nmatch"),
        F.col("l_quantity").cast("long").alias("alen"),
        F.round(F.col("l_discount") * 600).cast("int").alias("mapq"),
        "l_orderkey",
    )
