"""Files that arrive again: a stream that keeps the last snapshot of each path and tells what changed.

State is one narrow row a path (the snapshot as JSON, and its time), in RocksDB, so it spills and its size is that of the paths
that are still expected: with ``keep``, a path that has not come for so long is forgotten. A restart from the checkpoint goes on with the state.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lumenlake.operators import comparison
from lumenlake.plans.ship import ship

#: Times are microseconds; ``number`` tells rows of one time apart.
_STATE = StructType([StructField("time", LongType()), StructField("number", LongType()), StructField("snapshot", StringType())])
_PAIR = StructType([StructField("path", StringType()), StructField("time", LongType()), StructField("number", LongType()), StructField("before", StringType()), StructField("after", StringType())])


def last_snapshot(keep_ms: int | None) -> StatefulProcessor:
    """The operator. Its class is made here, as the process that starts it on the driver does not have this package."""

    class LastSnapshot(StatefulProcessor):
        """A pair (before, after) for each row after a path's first; rows of one batch in order of their time and number, a row older than the last is passed over."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.last = handle.getValueState("last", _STATE, keep_ms)

        def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
            held: tuple[int, int, str] | None = self.last.get() if self.last.exists() else None
            for row in sorted(rows, key=lambda r: (r["time"], r["number"], r["snapshot"])):
                if held is not None and (row["time"], row["number"]) < (held[0], held[1]):
                    continue
                if held is not None:
                    yield Row(path=key[0], time=row["time"], number=row["number"], before=held[2], after=row["snapshot"])
                held = (row["time"], row["number"], row["snapshot"])
            if held is not None:
                self.last.update(held)

        def close(self) -> None:
            pass

    return LastSnapshot()


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that the operator needs; queries that the session starts from now on have it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def rearrivals(snapshots: DataFrame, keep_hours: float | None = None, number: str | None = None) -> DataFrame:
    """path, modificationTime, ``number``, identical_files, changes and recompression of each file that has come before.

    The session needs ``use_rocksdb`` before the query starts. With ``keep_hours`` it must run on with time: Spark never ends an ``availableNow`` run that has timers.
    ``snapshots`` is a stream of rows as ``comparison.snapshots`` gives them with keys path and modificationTime; null times are left out.
    ``changes`` is null where either could not be read. ``number``: a column of longs that orders a path's rows of one time; it is never null.
    """
    ship(snapshots.sparkSession)
    shape = snapshots.select(F.struct(*comparison.SNAPSHOT).alias("s")).schema["s"].dataType
    narrow = snapshots.where("path is not null and modificationTime is not null").select(
        "path", F.unix_micros(F.col("modificationTime").cast("timestamp")).alias("time"), (F.col(number).cast("long") if number else F.lit(0).cast("long")).alias("number"),
        F.to_json(F.struct(*comparison.SNAPSHOT)).alias("snapshot"),
    )
    keep = None if keep_hours is None else int(keep_hours * 3_600_000)
    pairs = narrow.groupBy("path").transformWithState(last_snapshot(keep), _PAIR, "Append", "ProcessingTime" if keep else "None")
    both = pairs.select("path", F.timestamp_micros("time").alias("modificationTime"), *([F.col("number").alias(number)] if number else []), F.from_json("before", shape).alias("original"), F.from_json("after", shape).alias("copy"))
    ok = F.col("original.error").isNull() & F.col("copy.error").isNull()
    return both.select(
        "path", "modificationTime", *([number] if number else []), (F.col("original.sha256") == F.col("copy.sha256")).alias("identical_files"),
        F.when(ok, comparison.changes("original", "copy")).alias("changes"), F.when(ok, comparison.recompression("original", "copy")).alias("recompression"),
    )
