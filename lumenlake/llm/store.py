"""Intermediate tables in the folder that the driver and all executors share.

Lineage is cut by writing a table and reading it back: a lost executor then costs a
re-read of shared files, never a recomputation from the source.
"""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from lumenlake.plans.ship import ship

_DEFAULT_DIR = "/tmp/checkpoints/lumenlake"
_live: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a folder of this machine if it is the only one."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (given or _DEFAULT_DIR).rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/lumenlake-{tag}-{uuid.uuid4().hex}"
    _live.append((spark, path))
    return path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete shared folders through Hadoop's file system, so any store works."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        _live[:] = [x for x in _live if x[1] != path]


class Stage:
    """A set of intermediate tables; ``close`` deletes all but those that a result still reads."""

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark, self.paths = spark, {}

    def new(self, tag: str) -> str:
        path = self.paths[tag] = new_path(self.spark, tag)
        return path

    def table(self, df: DataFrame, tag: str) -> DataFrame:
        path = self.new(tag)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self, *tags: str) -> None:
        drop(self.spark, *(self.paths.pop(t) for t in tags))

    def close(self, keep: tuple[str, ...] = ()) -> None:
        self.free(*[t for t in self.paths if t not in keep])


@atexit.register
def _sweep() -> None:
    for spark, path in list(_live):
        try:
            drop(spark, path)
        except Exception:  # the session may have ended before the interpreter
            return
