"""A stream that remembers the last snapshot of each path: over batches and over a restart."""

import datetime as dt
import time

import pytest

from lumenlake.operators import comparison
from lumenlake.streaming import changes

SHAPE = "path string, modificationTime timestamp, size_bytes long, sha256 string, width int, height int, jpeg_process string, exif string, gps string, xmp string, iptc string, icc string, camera_model string, quantization string, huffman string, scan_sha256 string, trailing_bytes long, warnings array<string>, error string"


def shot(path, minute, gps="YES", model="M", scan="s", error=None):
    at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=minute) if minute is not None else None
    return (path, at, 1, f"{path}{minute}", 8, 8, "Baseline DCT", "YES", gps, "NO", "NO", "NO", model, "q", None, scan, 0, [], error)


@pytest.fixture
def session(spark):
    own = spark.newSession()
    changes.use_rocksdb(own)
    own.conf.set("spark.sql.shuffle.partitions", "3")
    return own


def run(session, tmp_path):
    rows = session.readStream.schema(SHAPE).parquet(str(tmp_path / "in"))
    out = changes.rearrivals(rows)
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).outputMode("append")
    query.trigger(availableNow=True).start().awaitTermination()
    found = session.read.schema(out.schema).parquet(str(tmp_path / "out"))
    return sorted((r["path"], r["modificationTime"].minute, None if r["changes"] is None else [c["code"] for c in r["changes"]], r["identical_files"]) for r in found.collect())


def test_changes_over_batches_and_a_restart(session, tmp_path):
    add = lambda *rows: session.createDataFrame(rows, SHAPE).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
    add(shot("a", 1), shot("a", 3, gps="NO"), shot("a", 2), shot("b", 1), shot(None, 1), shot("c", None))
    first = [("a", 2, [], False), ("a", 3, ["gps_removed"], False)]
    assert run(session, tmp_path) == first
    assert run(session, tmp_path) == first  # nothing new
    # After a restart the state is there; what is older than the last is passed over.
    add(shot("a", 4, gps="NO", model=None), shot("a", 2, scan="late"), shot("b", 5, scan="t"), shot("d", 1))
    second = sorted([*first, ("a", 4, ["camera_model_removed"], False), ("b", 5, ["compressed_data_changed"], False)])
    assert run(session, tmp_path) == second
    add(shot("d", 2, error="broken"), shot("d", 3))
    assert run(session, tmp_path) == sorted([*second, ("d", 2, None, False), ("d", 3, None, False)])


def test_paths_that_stay_away_are_forgotten(session, tmp_path):
    session.createDataFrame([shot("a", 1)], SHAPE).write.parquet(str(tmp_path / "in"))
    rows = session.readStream.schema(SHAPE).parquet(str(tmp_path / "in"))
    out = changes.rearrivals(rows, keep_hours=1)
    query = out.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "checkpoint")).outputMode("append").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(1)
            if (done := query.lastProgress) and done["stateOperators"] and done["stateOperators"][0]["numRowsTotal"] >= 1:
                break
        else:
            pytest.fail("no state")
    finally:
        query.stop()
    assert query.exception() is None
    assert set(comparison.SNAPSHOT) == {x.split(" ")[0] for x in SHAPE.replace(", ", ",").split(",")} - {"path", "modificationTime"}


def test_keys_of_a_million_and_more(spark, sf_dir, tmp_path):
    """Orders keep their own key whatever its size, and those of one customer and day follow each other by it."""
    from compare import same
    from pyspark.sql import functions as F

    from lumenlake import table_queries

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    far = orders.withColumn("o_orderkey", F.col("o_orderkey") * 3 + 2_999_000).withColumn("o_custkey", F.col("o_custkey") % 40)
    far = far.withColumn("o_orderdate", F.date_trunc("quarter", "o_orderdate").cast("timestamp_ntz"))
    far.toPandas().astype({"o_orderdate": "datetime64[us]"}).to_parquet(str(tmp_path / "orders.parquet"))
    assert same(spark, str(tmp_path), table_queries.stream_changes, table_queries.ORACLE_SQL["stream_changes"]) == 1460
