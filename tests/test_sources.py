"""Range reads of headers, and the sink of loose files."""

import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenlake.kernels import forge
from lumenlake.kernels.jpeg import header_walk
from lumenlake.kernels.limits import Limits, ParseError
from lumenlake.plans import forged
from lumenlake.sources import files, ranges, sink

SEGMENTS = [forge.segment(0xE1, b"Exif\0\0" + bytes(3000)), forge.segment(0xFE, b"c"), forge.segment(0xE1, b"http://ns.adobe.com/xmp/extension/\0" + bytes(60_000)), forge.segment(0xE2, b"ICC_PROFILE\0\1\1" + bytes(200))]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    from datetime import datetime

    root = tmp_path_factory.mktemp("ranges")
    for o in (24, 84, 7, 63, 202):
        (root / f"{o}.jpg").write_bytes(forged.long_photo({"o": o, "c": o * 3 + 1, "d": datetime(2020, 1, 2, 3, 4, 5)}))
    (root / "many.jpg").write_bytes(forge.jpeg(SEGMENTS, 300, 200, b"\x01" * 200_000))
    (root / "bad.jpg").write_bytes(b"\xff\xd8broken")
    (root / "bomb.jpg").write_bytes(b"\xff\xd8" + b"\xff\xe1\x00\x02" * 5000)
    (root / "fill.jpg").write_bytes(b"\xff\xd8" + b"\xff" * 3000 + b"\xe1\x00\x02")
    (root / "empty.jpg").write_bytes(b"")
    (root / "cut.jpg").write_bytes(b"\xff\xd8\xff\xe1\xff\xff" + bytes(500))
    (root / "sub").mkdir()
    (root / "sub" / "7.jpg").write_bytes((root / "7.jpg").read_bytes())
    (root / "_hidden.jpg").write_bytes(b"")
    return root


def named(rows):
    return {r["path"].rsplit("/", 1)[1]: r for r in rows}


@pytest.mark.parametrize("block", [16, 512, 4096])
def test_headers_as_of_whole_files(spark, folder, block):
    want = named(files.photos(files.scan_directory(spark, str(folder), glob="*.jpg"), ["path"], columns=("segments", "width", "height", "errors")).collect())
    got = named(ranges.headers(spark, str(folder), glob="*.jpg", blockBytes=block).collect())
    assert set(got) == set(want) | {"empty.jpg"}  # an empty file is a row here, and none of the whole-file scan
    assert got.pop("empty.jpg")["error"] == "not a JPEG: SOI is missing"
    for name, r in got.items():
        said = {e["part"]: e["message"] for e in want[name]["errors"]}
        assert (r["segments"], r["width"], r["height"]) == (want[name]["segments"], want[name]["width"], want[name]["height"])
        assert r["error"] == (said.get("header") or said.get("dimensions")) and r["length"] == (folder / name).stat().st_size
    assert got["many.jpg"]["bytes_read"] <= 20 * max(block, 64) and got["84.jpg"]["bytes_read"] < 2000 + block


def test_whole_headers_feed_the_kernels(spark, folder):
    columns = ("tags", "xmp", "iptc", "icc", "location", "capture", "has", "width")
    rows = ranges.headers(spark, str(folder), glob="*.jpg", header=True)
    got = named(files.photos(rows, ["path"], content="header", columns=columns).collect())
    want = named(files.photos(files.scan_directory(spark, str(folder), glob="*.jpg"), ["path"], columns=columns).collect())
    for name in ("24.jpg", "84.jpg", "7.jpg", "63.jpg", "many.jpg"):
        assert got[name] == want[name]
    sizes = named(rows.select("path", F.length("header").alias("n"), "length").collect())
    assert sizes["many.jpg"]["n"] < 70_000 < sizes["many.jpg"]["length"] and sizes["bad.jpg"]["n"] is None


def test_filters_and_budgets(spark, folder):
    rows = ranges.headers(spark, str(folder), recursive=True)
    assert rows.count() == 12  # hidden names are no data
    assert rows.where((F.col("length") < 600) & F.col("path").endswith("cut.jpg")).count() == 1
    assert rows.count() == 12  # a filter of one query is none of the next
    assert rows.where(F.col("length").isin(0) | F.col("path").contains("bomb")).count() == 2
    some = ranges.headers(spark, str(folder), minLength=100, maxLength=600).collect()
    assert [r["path"].rsplit("/", 1)[1] for r in some] == ["cut.jpg"]
    few = named(ranges.headers(spark, str(folder), glob="many.jpg", limits={"max_jpeg_header_payload_bytes": 10_000, "max_input_file_bytes": 1 << 20}).collect())
    assert few["many.jpg"]["error"] == "JPEG header payloads exceed the limit"
    few = named(ranges.headers(spark, str(folder), glob="many.jpg", limits={"max_input_file_bytes": 1000}).collect())
    assert few["many.jpg"]["error"] == "input file exceeds the limit" and few["many.jpg"]["bytes_read"] == 0
    assert ranges.headers(spark, str(folder), glob="*.none").count() == 0 and ranges.headers(spark, str(folder / "84.jpg")).count() == 1


def test_partitions_by_size(folder):
    reader = ranges.HeaderReader(None, {"path": str(folder), "recursivefilelookup": "true", "partitionbytes": "20000", "blockbytes": "512"})
    parts = reader.partitions()
    assert len(parts) > 2 and sum(len(p.files) for p in parts) == 12
    assert all(sum(min(size, 16 * 512) for _, _, size in p.files) <= 20_000 for p in parts)


def test_walks_over_windows():
    data = forge.jpeg(SEGMENTS, 300, 200, b"\x01" * 5000)
    whole = header_walk(data)
    for block in (1, 7, 100, 100_000):
        window = ranges.Window(pa.BufferReader(data), len(data), block)
        assert [s.row() for s in header_walk(window, keep=64)] == [s.row() for s in whole]
        assert window.fetched <= len(data) + block and len(window.held) <= 2
    with pytest.raises(ParseError):
        header_walk(ranges.Window(pa.BufferReader(data[:100]), 100, 64), Limits(), 64)


def blobs(spark, rows):
    return spark.createDataFrame(rows, "name string, content binary").repartition(3)


def written(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file()}


def test_all_files_or_none(spark, tmp_path):
    rows = [(f"{'sub/' if k % 2 else ''}{k}.bin", bytes([k]) * k) for k in range(20)]
    sink.write_blobs(blobs(spark, rows), str(tmp_path / "out"))
    assert written(tmp_path / "out") == dict(rows)
    for bad in ([("x.bin", None)], [("x.bin", b"1"), ("x.bin", b"1")], [("../x", b"1")], [(None, b"1")], [("/x", b"")], [("4.bin", b"other")], [("a//b", b"")]):
        with pytest.raises(Exception):
            sink.write_blobs(blobs(spark, [(f"new{k}", b"n") for k in range(9)] + bad), str(tmp_path / "out"))
        assert written(tmp_path / "out") == dict(rows) and not list((tmp_path / "out").glob("_*"))
    with pytest.raises(Exception, match="targets exist"):
        sink.write_blobs(blobs(spark, rows[:1]), str(tmp_path / "out"))
    sink.write_blobs(blobs(spark, rows[:5] + [("more", b"m")]), str(tmp_path / "out"), existing="same")
    sink.write_blobs(blobs(spark, [("4.bin", b"new")]), str(tmp_path / "out"), existing="replace")
    assert written(tmp_path / "out") == dict(rows) | {"more": b"m", "4.bin": b"new"}
    sink.write_blobs(blobs(spark, []), str(tmp_path / "none"))


def batch(*rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["name", "content"])


def test_attempts_that_fail_leave_nothing(tmp_path):
    """A task that dies half-way, runs again and runs twice: only the attempts that Spark commits count."""
    writer = sink.FolderWriter(str(tmp_path), "refuse", True).begin()

    def broken():
        yield batch(("a", b"1"))
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(broken())
    first = writer.write(iter([batch(("a", b"1"), ("b", b"2"))]))
    twice = writer.write(iter([batch(("a", b"1"), ("b", b"2"))]))
    assert first.folder != twice.folder and written(tmp_path) and not (tmp_path / "a").exists()
    writer.commit([first, None])
    assert written(tmp_path) == {"a": b"1", "b": b"2"}
    other = sink.FolderWriter(str(tmp_path), "refuse", True).begin()
    other.abort([other.write(iter([batch(("c", b"3"))])), None])
    with pytest.raises(OSError):
        other.write(iter([batch(("c", b"3"))]))  # after the abort
    assert written(tmp_path) == {"a": b"1", "b": b"2"}
    again = sink.FolderWriter(str(tmp_path), "same", False).begin()  # after a commit that was cut off
    (tmp_path / "b").unlink()
    again.commit([again.write(iter([batch(("a", b"1"), ("b", b"2"))]))])
    assert written(tmp_path) == {"a": b"1", "b": b"2"}
    with pytest.raises(ValueError):
        sink.FolderWriter(str(tmp_path), "other", True)


def test_cleaned_folder_reads_back(spark, tmp_path, folder):
    rows = files.scan_directory(spark, str(folder), glob="*.jpg").select(F.concat_ws("/", F.lit("x"), F.regexp_extract("path", r"([^/]+)$", 1)), "content")
    sink.write_blobs(rows, str(tmp_path))
    got = spark.read.format("binaryFile").load(str(tmp_path / "x")).select("path", F.sha2("content", 256).alias("h")).collect()
    assert all(r["h"] == hashlib.sha256((folder / r["path"].rsplit("/", 1)[1]).read_bytes()).hexdigest() for r in got) and len(got) == 10  # names with an underscore are not data


def test_one_document_of_any_size(spark, tmp_path):
    """Parts in order between head and tail; the size of a part and empty parts do not show."""
    rows = [(k, None if k % 7 == 3 else f"é{k}" if k % 5 else "") for k in range(500)]
    want = ",".join(p for _, p in rows if p is not None)
    df = spark.createDataFrame(rows, "k int, piece string").repartition(7)
    path = tmp_path / "new" / "all.txt"
    n = sink.write_document(df, [F.col("k")], str(path), head="<", lead="(", separator=",", tail=">")
    assert path.read_text() == f"<({want}>" and n == sum(p is not None for _, p in rows)
    assert [p.name for p in path.parent.iterdir()] == ["all.txt"]
    with pytest.raises(Exception, match="exists"):
        sink.write_document(df, [F.col("k")], str(path))
    assert path.read_text() == f"<({want}>" and [p.name for p in path.parent.iterdir()] == ["all.txt"]
    assert sink.write_document(df.where("false"), [F.col("k")], str(path), head="<", lead="(", tail=">", replace=True) == 0
    assert path.read_text() == "<>"
    plan = df.orderBy("k")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "SinglePartition" not in plan
    bad = df.select("k", F.when(F.col("k") == 300, F.raise_error(F.lit("lost"))).otherwise(F.col("piece")).alias("piece"))
    with pytest.raises(Exception):
        sink.write_document(bad, [F.col("k")], str(tmp_path / "new" / "other.txt"))
    assert [p.name for p in path.parent.iterdir()] == ["all.txt"]


def test_csv_lines_as_python_writes_them(spark, tmp_path):
    import csv
    import io

    from lumenlake.plans import reports

    rows = [("b", "x,y", ""), ("a", 'say "q"', "é"), ("c", "two\nlines", " s "), ("B", "\r", "1")]
    df = spark.createDataFrame(rows, "path string, one string, two string").repartition(3)
    assert reports.write_csv_file(df, str(tmp_path / "o.csv")) == 4
    out = io.StringIO()
    csv.writer(out).writerows([df.columns, *sorted(rows, key=lambda r: (r[0].lower(), r[0]))])
    assert (tmp_path / "o.csv").read_bytes() == ("\ufeff" + out.getvalue()).encode()


def test_header_folders_are_bounded(spark, sf_dir, monkeypatch):
    """All photos are read, a folder at a time, and none stays on disk."""
    from compare import same

    from lumenlake import table_queries
    from lumenlake.plans import shared

    written, write = [], sink.write_blobs
    monkeypatch.setattr(table_queries, "FOLDER_PHOTOS", 400)
    monkeypatch.setattr(sink, "write_blobs", lambda rows, *a, **b: (written.append(rows.count()), write(rows, *a, **b)))
    before = len(shared._live)
    n = same(spark, sf_dir, table_queries.header_ranges, table_queries.ORACLE_SQL["header_ranges"])
    assert sum(written) == n and len(written) > 1 and max(written) < 800
    assert not [p for _, p in shared._live[before:] if "-photos-" in p or "-dealt-" in p]


def test_a_stream_of_one_file_is_dealt(spark, sf_dir, tmp_path):
    """A batch that is one file runs on all cores, in the order of streams too."""
    from lumenlake.plans import forged

    seen = []
    schema = spark.read.parquet(f"{sf_dir}/orders.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    run = forged.spread(rows).writeStream.foreachBatch(lambda df, _: seen.append((df.rdd.getNumPartitions(), df.count()))).option("checkpointLocation", str(tmp_path / "c"))
    run.trigger(availableNow=True).start().awaitTermination()
    assert seen == [(2 * spark.sparkContext.defaultParallelism, spark.read.parquet(f"{sf_dir}/orders.parquet").count())]
