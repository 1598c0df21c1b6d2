"""Session construction and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "corrspark", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution and UTC time. On a cluster the submit command's settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves a local session; on a cluster that is an error, as executors would not see it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="corrspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Spark drops a job's shuffle files at its end instead of when the driver happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables that are written on the way to a result and deleted when the block ends: with Scratch(spark) as tmp: tmp.cut(df, label).

    What leaves the block must have been written by cut(), so that nothing reads the deleted tables afterwards.
    """

    def __init__(self, spark: SparkSession):
        self._spark, self._paths = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def cut(self, df: DataFrame, label: str) -> DataFrame:
        self._paths[path := _fresh(self._spark, label)] = None
        self._paths[path] = written = _write(df, path)
        return written

    def drop(self, table: DataFrame) -> None:
        """Delete a table that cut() gave, before the block ends; nothing may read it any more."""
        for path in [p for p, written in self._paths.items() if written is table]:
            self._delete(path)
            del self._paths[path]

    def __exit__(self, *_: object) -> None:
        for path in self._paths:
            self._delete(path)

    def _delete(self, path: str) -> None:
        place = self._spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(place, True)


def _fresh(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    It cuts the lineage, so a lost executor costs at most the stage that runs, and later readers do not
    compute ``df`` again. The files live in ``spark.checkpoint.dir`` and go when that folder is cleared.
    """
    return _write(df, _fresh(df.sparkSession, label))


def _write(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)
