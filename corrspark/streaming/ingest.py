"""Label intervals that arrive as files: bases by contig and label, brought up to date with each file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def interval_stream(spark: SparkSession, folder: str, most_files: int = 100) -> DataFrame:
    """chrom, start, end, name of the BED files that arrive in a folder."""
    lines = spark.readStream.option("maxFilesPerTrigger", most_files).text(folder).where(~F.col("value").rlike(r"^\s*(#|track|browser|$)"))
    c = F.split("value", "\t", -1)
    rows = lines.select(F.get(c, F.lit(0)).alias("chrom"), F.get(c, F.lit(1)).try_cast("long").alias("start"), F.get(c, F.lit(2)).try_cast("long").alias("end"), F.coalesce(F.get(c, F.lit(3)), F.lit("")).alias("name"))
    return rows.where("end > start")


def label_totals(stream: DataFrame) -> DataFrame:
    return stream.groupBy("chrom", "name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("bases"))


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what has arrived as Parquet by contig, each file once, and stops."""
    return stream.writeStream.format("parquet").partitionBy("chrom").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
