"""Block-gzipped text (.bgz) as a Spark data source.

Such a file is a row of small gzip members, each of which says how long it is. So a file is read in several tasks: each begins at the first
member at or after its share of the bytes, and a line that runs over the end of a share belongs to the task where it begins.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed value: how a member begins (gzip with an extra field).
_MAGIC = b"\x1f\x8b\x08\x04"
_MOST = 1 << 16  # bytes of a member


def _member(head: bytes) -> int | None:
    """The whole length of the member that ``head`` begins with, if it is one."""
    if len(head) < 18 or head[:4] != _MAGIC:
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        size = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and size == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


@dataclass
class Share(InputPartition):
    path: str
    start: int
    end: int


class BlockGzipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["paths"].split("\n")
        self.share = int(options.get("share", 64 << 20))

    @staticmethod
    def _open(path: str):
        from pyarrow import fs

        system, inside = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        return system.open_input_file(inside)

    def partitions(self) -> list[Share]:
        out = []
        for path in self.paths:
            with self._open(path) as f:
                size = f.size()
            out += [Share(path, a, min(a + self.share, size)) for a in range(0, size, self.share)]
        return out

    def _members(self, f, start: int, size: int) -> Iterator[tuple[int, bytes]]:
        """(offset, text) of the members from ``start`` on; the first may begin later."""
        f.seek(start)
        window = f.read(2 * _MOST)
        at = start
        if start:  # the next place where a member begins and another follows it
            i = window.find(_MAGIC)
            while i >= 0:
                n = _member(window[i : i + 64])
                if n and (start + i + n == size or window[i + n : i + n + 4] == _MAGIC):
                    break
                i = window.find(_MAGIC, i + 1)
            if i < 0:
                return
            at = start + i
        while at < size:
            f.seek(at)
            head = f.read(_MOST)
            n = _member(head)
            if n is None:
                raise ValueError(f"no block-gzip member at byte {at}")
            yield at, zlib.decompress(head[:n], 31)
            at += n

    def read(self, partition: Share) -> Iterator[tuple]:
        with self._open(partition.path) as f:
            held, skipping, began, number, done = b"", partition.start > 0, None, 0, False
            for at, text in self._members(f, partition.start, f.size()):
                if at >= partition.end and (began is None or done):
                    break
                past = at >= partition.end
                held += text
                lines = held.split(b"\n")
                held = lines.pop()
                for line in lines:
                    if skipping:
                        skipping = False
                    else:
                        yield partition.path, partition.start, number, line.decode()
                        number += 1
                    if past:
                        done = True
                        break
                began = at
                if done:
                    return
            if began is not None and held and not skipping and not done:
                yield partition.path, partition.start, number, held.decode()


class BlockGzip(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blockgzip"

    def schema(self) -> str:
        return "path string, share long, line long, value string"

    def reader(self, schema) -> BlockGzipReader:
        return BlockGzipReader(self.options)


def lines(spark: SparkSession, paths: list[str], share: int = 64 << 20) -> DataFrame:
    """path, share, line, value: the lines of block-gzipped files; share and line give their order in a file."""
    spark.dataSource.register(BlockGzip)
    return spark.read.format("blockgzip").option("paths", "\n".join(paths)).option("share", str(share)).load()


def fasta_records(spark: SparkSession, paths: list[str], share: int = 64 << 20) -> DataFrame:
    """path, place, header, body: the records of block-gzipped FASTA files, put together across shares.

    Headers are counted in each share, and shares before it are added up, so lines find their record without an order of all
    lines of a file.
    """
    rows = lines(spark, paths, share).where(F.length(F.trim("value")) > 0)
    inside = Window.partitionBy("path", "share").orderBy("line")
    numbered = rows.withColumn("_in", F.sum(F.when(F.col("value").startswith(">"), 1).otherwise(0)).over(inside))
    counts = numbered.groupBy("path", "share").agg(F.max("_in").alias("_heads"))
    before = F.coalesce(F.sum("_heads").over(Window.partitionBy("path").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = numbered.join(counts.select("path", "share", before.alias("_before")), ["path", "share"]).withColumn("place", F.col("_in") + F.col("_before")).where("place > 0")
    parts = whole.groupBy("path", "place", "share").agg(F.max(F.when(F.col("value").startswith(">"), F.substring("value", 2, 1 << 30))).alias("header"), F.array_sort(F.collect_list(F.when(~F.col("value").startswith(">"), F.struct("line", "value")))).alias("_l"))
    pieces = parts.select("path", "place", "header", F.struct("share", F.array_join(F.transform("_l", lambda x: x["value"]), "").alias("text")).alias("_p"))
    joined = pieces.groupBy("path", "place").agg(F.max("header").alias("header"), F.array_sort(F.collect_list("_p")).alias("_ps"))
    return joined.select("path", "place", "header", F.array_join(F.transform("_ps", lambda x: x["text"]), "").alias("body"))
