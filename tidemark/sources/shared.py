"""Tables in a folder that the driver and all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group of large rows.
ROW_GROUP = 8 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession, kind: str) -> str:
    """A new folder below the cluster's ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine (tests) gets a temporary folder; on a cluster it is an error, since
    executors would each write to a disk of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside go as soon as it has ended."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


class Scratch:
    """Tables of one job in a shared folder; each can be dropped when nothing reads it any more."""

    def __init__(self, spark: SparkSession, kind: str):
        self.spark, self.root, self.paths = spark, shared_dir(spark, kind), {}

    def table(self, name: str, df: DataFrame, large_rows: bool = False) -> DataFrame:
        """``df`` as a Parquet table: cuts lineage, survives lost executors and frees the shuffles before it. A table
        of the same name written before stays until it is dropped. ``large_rows`` of megabytes lie in small row groups,
        since Spark's reader takes 4,096 rows of a group at a time."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        with shuffles_dropped(self.spark):
            df.write.options(**({"parquet.block.size": ROW_GROUP} if large_rows else {})).parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str, but_last: bool = False) -> None:
        """Removes the tables of these names, or all of each but the last written."""
        for name in names:
            paths = self.paths.get(name, [])
            gone = paths[: len(paths) - but_last]
            self.paths[name] = paths[len(gone) :]
            for path in gone:
                place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, kind: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    return Scratch(df.sparkSession, kind).table("all", df)
