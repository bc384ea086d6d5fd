"""Registered queries against their SQL twins, and rules on small files."""

import pytest
from compare import same
from pyspark.sql import functions as F

from lumenlake import queries
from lumenlake.functions.text import bar, file_size, general, html
from lumenlake.operators import anomalies, batch, comparison, hashing, privacy, sanitize
from lumenlake.plans import forged, reports
from lumenlake.sources import files


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, name):
    assert same(spark, sf_dir, queries.QUERIES[name], queries.ORACLE_SQL[name]) > 0


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    from datetime import datetime

    root = tmp_path_factory.mktemp("photos")
    for o in (24, 84, 7):
        (root / f"{o}.jpg").write_bytes(forged._order_photo({"o": o, "c": o * 3 + 1, "d": datetime(2020, 1, 2, 3, 4, 5)}))
    (root / "bad.jpg").write_bytes(b"\xff\xd8broken")
    (root / "bomb.jpg").write_bytes(b"\xff\xd8" + b"\xff\xe1\x00\x02" * 5000)
    (root / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    (root / "x.nef").write_bytes(b"II*\0\x08\0\0\0")
    (root / "sub").mkdir()
    (root / "sub" / "s.txt").write_text("text")
    return root


def test_one_bad_file_does_not_stop_a_folder(spark, folder):
    rows = batch.items(files.scan_directory(spark, str(folder)))
    got = {r["path"].rsplit("/", 1)[1]: r for r in rows.collect()}
    assert len(got) == 7 and got["x.nef"]["format"] == "UNSUPPORTED" and got["a.png"]["format"] == "PNG"
    assert got["bad.jpg"]["privacy_level"] is None and got["bomb.jpg"]["error"] == "too many JPEG segments"
    assert got["24.jpg"]["privacy_level"] == "HIGH" and got["24.jpg"]["gps_detected"] is True
    counts = batch.summary(rows).first()
    assert (counts["total_files"], counts["analyzed_jpeg_count"], counts["failed_jpeg_count"]) == (7, 3, 2)
    assert files.scan_directory(spark, str(folder), True, [str(folder / "a.png")]).count() == 7
    import json

    out = folder.parent / "batch.json"
    assert reports.write_json(rows, f"file:{folder}", False, str(out)) == 7
    document = out.read_text()
    assert "".join(reports.json_parts(rows, f"file:{folder}", False)) == document
    assert json.loads(document)["summary"]["total_files"] == 7 and len(json.loads(document)["files"]) == 7


def test_csv_file(spark, folder, tmp_path):
    rows = reports.csv_rows(batch.items(files.scan_directory(spark, str(folder))), f"file:{folder}")
    assert reports.write_csv_file(rows, str(tmp_path / "o.csv")) == 7
    reports.write_csv(rows, str(tmp_path / "parts"))
    assert spark.read.option("header", True).csv(str(tmp_path / "parts")).count() == 7
    reports.json_lines(batch.items(files.scan_directory(spark, str(folder))), f"file:{folder}", str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).where("analyzed").count() == 3
    raw = (tmp_path / "o.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfschema_version,path") and b"1.0,24.jpg,JPEG,YES" in raw


def test_html_hides_places_and_escapes(spark, folder):
    blobs = files.scan_directory(spark, str(folder / "84.jpg")).select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "content")
    judged = anomalies.detect(privacy.assess(files.photos(blobs, ["path", "size_bytes", "sha256"])))
    page, open_page = (reports.html_report(judged, ["path"], s).first()["document"] for s in (False, True))
    assert "-73.4036" not in page and "-73.4036" in open_page and "Creator &amp; 253" in page
    assert page.count("<section>") == 12


def test_scrub_report_and_files(spark, folder):
    blobs = files.scan_directory(spark, str(folder)).where("path like '%84.jpg' or path like '%bad.jpg'")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in sanitize.report(blobs, "privacy", ["path"]).collect()}
    assert rows["84.jpg"]["verified"] and rows["84.jpg"]["after_findings"] == 0 and rows["84.jpg"]["after_gps"] == "NO"
    assert not rows["bad.jpg"]["verified"] and rows["bad.jpg"]["error"]
    done = sanitize.scrub(blobs, "all", ["path"])
    for _ in range(2):  # a repeated write finds its own file
        assert [r["target"].rsplit("/", 1)[1] for r in sanitize.write_files(done).collect()] == ["84_clean.jpg"]
    (folder / "84_clean.jpg").write_bytes(b"another")
    with pytest.raises(Exception, match="targets exist"):
        sanitize.write_files(done)
    assert (folder / "84_clean.jpg").read_bytes() == b"another" and not list(folder.glob("_staging*"))
    (folder / "84_clean.jpg").unlink()


def test_one_hostile_file_does_not_stop_a_job(spark, folder, monkeypatch):
    from test_kernels import deep_packet

    from lumenlake.kernels import forge

    hostile = forge.jpeg([forge.segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + deep_packet(3000))], 8, 8)
    blobs = spark.createDataFrame([("deep", hostile), ("sound", (folder / "84.jpg").read_bytes()), ("none", None)], "path string, content binary")
    rows = {r["path"]: r for r in sanitize.scrub(blobs, "privacy", ["path"]).collect()}
    assert rows["deep"]["verified"] and rows["sound"]["verified"] and rows["none"]["error"] and not rows["none"]["verified"]
    # Whatever a kernel raises is the row's error.
    broken = files.over_blobs(blobs, ["path"], "content", "n int, error string", lambda data: {"n": 1 // (len(data) - len(hostile))})
    got = {r["path"]: r for r in broken.collect()}
    assert got["deep"]["error"].startswith("ZeroDivisionError") and got["sound"]["error"] is None


def test_one_read_of_each_file(spark, folder):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    scan = files.scan_directory(spark, str(folder))
    for rows in (sanitize.report(scan, "privacy", ["path"]), batch.items(scan)):
        content = [x for x in plan(rows).splitlines() if "Scan binaryFile" in x and "content" in x.split("Batched")[0]]
        assert len(content) == 1


def test_score_levels_and_matrix(spark):
    assert sum(p for p, _ in privacy.POINTS.values()) == 100
    rows = spark.createDataFrame([(0,), (24,), (25,), (49,), (50,), (None,)], "p int").select(privacy.level(F.col("p")).alias("l"))
    assert [r["l"] for r in rows.collect()] == ["LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", None]


def test_sizes_are_rounded_once(spark):
    """A quotient just beyond a half, in digits that a decimal quotient does not keep."""
    given = {12_345_000_400: "12.35 GB", 12_345_000_000: "12.34 GB", 12_355_000_000: "12.36 GB", 12_355_000_001: "12.36 GB", 1_234_999_999_999: "1.23 TB", 1_235_000_000_001: "1.24 TB", 2**63 - 1: "9223372.04 TB"}
    rows = spark.createDataFrame([(n,) for n in given], "n long").select("n", file_size(F.col("n")).alias("s")).collect()
    assert {r["n"]: r["s"] for r in rows} == given


def test_text_functions(spark):
    values = [2.8, 0.00001234, 123456789.0, 0.0, 100.0, 1 / 3, 17 / 10, 1e5, 999999.5]
    got = [r["g"] for r in spark.createDataFrame([(v,) for v in values], "v double").select(general(F.col("v")).alias("g")).collect()]
    assert got == [f"{v:g}" for v in values]
    sizes = [r["s"] for r in spark.createDataFrame([(0,), (999,), (1000,), (1_500_000,), (-1,), (5 * 10**12,)], "n long").select(file_size(F.col("n")).alias("s")).collect()]
    assert sizes == ["0 B", "999 B", "1.00 KB", "1.50 MB", None, "5.00 TB"]
    row = spark.range(1).select(bar(F.lit(50)).alias("b"), html(F.lit("<a&'\">")).alias("h")).first()
    assert row["b"] == "█" * 10 + "░" * 10 and row["h"] == "&lt;a&amp;&#x27;&quot;&gt;"


def test_hash_names():
    assert hashing.algorithm(" SHA-256 ") == "sha256"
    with pytest.raises(ValueError):
        hashing.algorithm("crc")


def test_empty_tables(spark):
    none = spark.createDataFrame([], "path string, length long, content binary")
    rows = batch.items(none)
    assert rows.count() == 0 and batch.summary(rows).first()["total_files"] == 0
    empty = files.photos(none.select("path", F.lit(1).alias("size_bytes"), F.lit("").alias("sha256"), "content"), ["path", "size_bytes", "sha256"])
    assert comparison.snapshots(anomalies.detect(privacy.assess(empty)), ["path"]).count() == 0


def test_stream_of_files(spark, folder):
    from lumenlake.streaming import ingest

    rows = ingest.first_of_content(ingest.assessed(ingest.arriving(spark, str(folder), "*.jpg", recursive=False)))
    q = rows.writeStream.format("memory").queryName("arrived").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r["path"].rsplit("/", 1)[1]: r["level"] for r in spark.table("arrived").collect()}
    assert got == {"24.jpg": "HIGH", "84.jpg": "HIGH", "7.jpg": "LOW", "bad.jpg": None, "bomb.jpg": None}


def test_sql_functions(spark, folder):
    from lumenlake.functions.register import register

    register(spark)
    spark.read.format("binaryFile").load(str(folder / "84.jpg")).createOrReplaceTempView("blobs")
    assert spark.sql("SELECT parse_jpeg(content).width AS w FROM blobs").first()["w"] == 269
    assert spark.sql("SELECT count(*) AS n FROM blobs, LATERAL jpeg_tags(content) t WHERE t.ifd = 'GPS'").first()["n"] > 0


def test_command_line(spark, folder, capsys, tmp_path):
    from lumenlake.cli import main

    assert main([]) == 0 and main(["scan", str(folder / "none")]) == 1
    assert main(["privacy", str(folder / "84.jpg"), "--detailed"]) == 0
    assert "[HIGH] GPS coordinates present (GPSLatitude, GPSLongitude)" in capsys.readouterr().out
    assert main(["report", str(folder / "84.jpg"), "--output", str(tmp_path / "r.html")]) == 0
    assert main(["report", str(folder / "84.jpg"), "--output", str(tmp_path / "r.html")]) == 1


def test_optional_backends_are_rows(spark, folder):
    from lumenlake.sources import optional

    assert optional.backends(spark).count() == 3
    blobs = files.scan_directory(spark, str(folder / "x.nef"))
    for rows in (optional.raw_images(blobs), optional.heif_images(blobs), optional.exiftool_json(blobs)):
        assert rows.first()["error"]


def test_all_text_reports(spark, folder):
    from lumenlake.functions.values import iptc_summary, xmp_summary
    from lumenlake.kernels import forge
    from lumenlake.operators import exiftool
    from lumenlake.sources import optional

    blobs = files.scan_directory(spark, str(folder / "84.jpg")).select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "content")
    facts = files.photos(blobs, ["path", "size_bytes", "sha256"])
    full = reports.text_full(anomalies.detect(privacy.assess(facts)), ["path"]).first()["document"]
    assert "== Anomalies ==" in full and "+40 GPS coordinates" in full and "not scored: gps_altitude" in full and "Orientation: Rotate 90" not in full
    info = reports.text_file_info(files.file_info(files.scan_directory(spark, str(folder / "84.jpg"))), ["path"]).first()["document"]
    assert "84.jpg" in info and "1.13 KB" in info
    row = facts.select(xmp_summary().alias("x"), iptc_summary().alias("i")).first()
    assert row["x"]["creator"] == ["Creator & 253", "Second"] and row["x"]["rating"] == 1 and row["i"]["keywords"] == ["Öl", "key"] and row["i"]["creator"] == "By253"
    other = files.scan_directory(spark, str(folder)).where("path like '%.png' or path like '%.nef'")
    assert all("error" in r["document"] for r in reports.text_container(files.containers(other, ["path"]), ["path"]).collect())
    assert "unavailable" in reports.text_raw(optional.raw_images(other), ["path"]).first()["document"]
    heif = spark.createDataFrame([("a.heic", forge.ftyp(b"heic", [b"mif1"]))], "path string, content binary")
    said = reports.text_heif(optional.heif_images(heif), ["path"]).first()["document"]
    assert "pillow_heif is unavailable" in said and "heic" in said and "mif1" in said
    tool = spark.createDataFrame([("a", '{"SubIFD:ImageWidth":3040,"SubIFD:ImageHeight":2014,"IFD0:ImageWidth":256,"IFD0:ImageHeight":170,"GPS:GPSLatitude":19.4}')], "path string, payload string")
    said = reports.text_exiftool(exiftool.normalise(tool, ["path"]), ["path"]).first()["document"]
    assert "3040 x 2014" in said and "19.4" not in said


class Stub:
    """A library's object: attributes by name."""

    def __init__(self, **values):
        self.__dict__.update(values)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return None


def raw_stub(**changed):
    from datetime import datetime

    sizes = Stub(raw_width=3100, raw_height=2050, width=3040, height=2014, top_margin=4, left_margin=6, crop_width=3000, crop_height=2000, pixel_aspect=1.0, flip=5)
    other = Stub(timestamp=datetime(2020, 5, 6, 7, 8, 9), iso_speed=200.0, shutter_speed=0.004, aperture=2.8, focal_length=35, shot_order=7, artist=" Ann ")
    raw = Stub(
        sizes=sizes, other=other, lens=Stub(make="", model="L 35", min_focal=0, max_focal=70.5), raw_type=Stub(name="Flat"), num_colors=3, color_desc=b"RGBG\0", white_level=16383,
        black_level_per_channel=[0, 0, 0, 0], camera_white_level_per_channel=None, camera_whitebalance=[2.0, 1.0, 1.5, 0.0], daylight_whitebalance=[0.0, 0.0], unpack=lambda: None,
    )
    raw.__dict__.update(changed)
    return Stub(imread=lambda f: raw, LibRawError=KeyError)


def test_raw_facts_and_guards(spark):
    from lumenlake.kernels import external
    from lumenlake.sources.schema import RAW

    facts = external.raw_facts(raw_stub(), b"")
    assert facts["color_description"] == "RGBG" and facts["black_level"] == [0, 0, 0, 0] and facts["camera_white_level"] is None and facts["daylight_white_balance"] is None
    assert (facts["lens_make"], facts["lens_min_focal"], facts["artist"], facts["timestamp"], facts["shot_order"]) == (None, None, "Ann", "2020-05-06T07:08:09", 7)
    guard = [external.positive(x) for x in (1, 0, -1, "1", None, 2.5)] + [external.positive(x, int) for x in (0.5, 3.9)]
    assert guard == [1.0, None, None, None, None, 2.5, None, 3] and [external.counted(x) for x in (0, -0.5, -1, "0")] == [0, 0, None, None]
    assert external.several([1, "x"], int, False) is None and external.several([], int, False) is None and external.colours(5) is None and external.colours(" G\0 ") == "G"
    assert external.raw_readable(raw_stub(), b"") and not external.raw_readable(Stub(imread=lambda f: {}["x"], LibRawError=KeyError), b"")
    row = spark.createDataFrame([("p", "NEF", 1500, "ab", *[facts.get(c.split()[0]) for c in RAW.split(", ")])], f"path string, variant string, size_bytes long, sha256 string, {RAW}")
    said = reports.text_raw(row, ["path"]).first()["document"]
    for part in ("Raw size", "3100 x 2050", "0.00400000 s (~1/250 s)", "f/2.80", "35.00 mm", "[0, 0, 0, 0]", "ISO", ": 200\n", "70.50 mm", "1.50 KB"):
        assert part in said


def test_heif_facts():
    from lumenlake.kernels import external, forge

    block = b"Exif\0\0" + forge.tiff([(0x010F, 2, " Maker "), (0x0112, 3, 6)], [(0x9003, 2, "2020:01:02 03:04:05")], [(1, 2, "N")])
    info = {"exif": block, "xmp": b"<x/>", "nclx_profile": {}, "metadata": [1, 2], "bit_depth": 10, "chroma": "420"}
    image = type("I", (), {"info": info, "size": (40, 30), "mode": "RGB", "has_alpha": False, "__len__": lambda self: 3})()
    library = Stub(open_heif=lambda f, convert_hdr_to_8bit: image, get_file_mimetype=lambda f: "")
    facts = external.heif_facts(library, forge.ftyp(b"heic", [b"mif1"]))
    assert (facts["make"], facts["orientation"], facts["datetime_original"], facts["gps"], facts["images"]) == ("Maker", 6, "2020:01:02 03:04:05", "YES", 3)
    assert (facts["mime"], facts["bit_depth"], facts["chroma"], facts["nclx"], facts["xmp"], facts["icc"], facts["other_blocks"]) == ("image/heic", 10, None, "NO", "YES", "NO", 2)
    info["exif"] = b"broken"
    facts = external.heif_facts(library, forge.ftyp(b"mif1", [b"heic"]))
    assert (facts["exif"], facts["gps"], facts["make"]) == ("YES", "UNKNOWN", None) and facts["warnings"]


def test_container_summaries():
    from lumenlake.kernels import containers, forge

    sub, gps = [(0x9003, 2, "2020:01:02 03:04:05")], [(1, 2, "N")]
    base = [(0x0100, 4, 5), (0x0101, 4, 6), (0x010F, 2, "Mk"), (0x0110, 2, " "), (0x0131, 2, "Sw"), (0x013B, 2, "Ann"), (0x0112, 3, 3)]
    whole = containers.inspect(forge.tiff(sorted(base), sub, gps))
    assert (whole["exif"], whole["gps"], whole["make"], whole["model"], whole["software"], whole["artist"], whole["orientation"]) == ("YES", "YES", "Mk", None, "Sw", "Ann", 3)
    assert (whole["mime"], whole["animated"], whole["datetime_original"]) == ("image/tiff", False, None)
    plain = containers.inspect(forge.tiff(sorted(base)))
    assert (plain["exif"], plain["gps"]) == ("NO", "NO")
    broken = containers.exif_summary(b"II*\0\xff\xff\xff\xff")
    assert (broken["exif"], broken["gps"]) == ("UNKNOWN", "UNKNOWN") and broken["warnings"]


def test_raw_candidates_are_opened(spark, folder, monkeypatch):
    rows = batch.items(files.scan_directory(spark, str(folder)).where("path like '%.nef'"), raw_backend=True)
    assert [r["format"] for r in rows.collect()] == ["UNSUPPORTED"]  # the reader is not there


def test_meanings_of_odd_values(spark):
    from lumenlake.functions.meanings import interpret_value
    from lumenlake.kernels.tiff import tagged
    from fractions import Fraction

    values = [3, 99, "a'b", 'it"s', "x\ny", (1, 2), (1,), Fraction(1, 2), (Fraction(1, 2), Fraction(3)), 0.5, b"a\x00\xff'\\", b"", None]
    schema = "v struct<kind:string,is_scalar:boolean,ints:array<bigint>,rationals:array<struct<num:bigint,den:bigint>>,floats:array<double>,text:string,bytes:binary>"
    got = [r["m"] for r in spark.createDataFrame([(tagged(v),) for v in values], schema).select(interpret_value("Orientation", F.col("v")).alias("m")).collect()]
    plain = [f"Invalid Orientation value: {v!r}" for v in values[2:]]
    plain[-3] = "Invalid Orientation value: b'a\\x00\\xff\\'\\\\'"
    assert got == ["Rotate 180°", "Unknown (99)", *plain]


def test_batch_texts(spark, folder):
    rows = batch.items(files.scan_directory(spark, str(folder)))
    read = lambda lines: "\n".join(r["piece"] for r in lines.orderBy("section", *reports.by_path()).collect())
    said = read(reports.text_batch(rows, f"file:{folder}"))
    assert reports.write_text(reports.text_batch(rows, f"file:{folder}"), str(folder.parent / "batch.txt")) == len(said.split("\n"))
    assert (folder.parent / "batch.txt").read_text() == said
    assert "Files: 7 files" in said and "Failed JPEG:\n- bad.jpg: " in said and "- bomb.jpg: too many JPEG segments" in said
    said = read(reports.text_batch_privacy(rows, f"file:{folder}", True))
    assert "/100 GPS=YES 24.jpg" in said and "/100 GPS=NO 7.jpg" in said and "[ERROR] bad.jpg - " in said
    assert "JPEG results" not in read(reports.text_batch_privacy(rows))


def test_raw_places_and_formats(spark, folder):
    blobs = files.scan_directory(spark, str(folder / "84.jpg")).select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "content")
    said = reports.text_gps_raw(files.photos(blobs, ["path", "size_bytes", "sha256"]), ["path"]).first()["document"]
    assert "GPSLatitudeRef" in said and "(73/1, 24/1, 13/1)" in said
    kinds = files.scan_directory(spark, str(folder)).select(files.strict_format(F.col("content")).alias("f"), "path").collect()
    assert {r["path"].rsplit(".", 1)[1]: r["f"] and tuple(r["f"]) for r in kinds} == {"jpg": ("Image", "JPEG", "image/jpeg"), "png": None, "nef": None}


def test_a_rule_of_the_callers(spark, folder):
    blobs = files.scan_directory(spark, str(folder / "84.jpg"))
    row = sanitize.rewrite(blobs, lambda marker, payload: (None, "gone") if marker == 0xE1 else (payload, None), ["path"]).first()
    assert row["verified"] and row["removed_segments"] == 2 and {c["reason"] for c in row["changes"]} == {"gone"}


def test_scrub_text(spark, folder):
    blobs = files.scan_directory(spark, str(folder / "84.jpg"))
    said = reports.text_scrub(sanitize.report(blobs, "privacy", ["path"]), ["path"]).first()["document"]
    assert "GPS                    : YES -> NO" in said and "Image data preserved   : YES" in said and "Mode                   : PRIVACY" in said


def test_stat_times_and_duplicate_tags(spark, folder):
    rows = {r["path"].rsplit("/", 1)[1]: r for r in files.stat_times(files.scan_directory(spark, str(folder))).collect()}
    assert rows["84.jpg"]["changed"] > 1e9 and rows["84.jpg"]["accessed"] > 1e9
    from lumenlake.plans import cases

    blobs = spark.createDataFrame([(k, cases.anomaly_photo({"k": k})) for k in (0, 17)], "k long, content binary")
    assert [tuple(r) for r in anomalies.duplicate_tags(files.photos(blobs, ["k"]), ["k"]).collect()] == [(17, "IFD0", "Model", 2)]


def test_many_excluded_paths(spark, folder, monkeypatch):
    monkeypatch.setattr(files, "MOST_BROADCAST", 1)
    left = files.scan_directory(spark, str(folder), exclude=[str(folder / "a.png"), f"file:{folder}/7.jpg"])
    assert {r["path"].rsplit("/", 1)[1] for r in left.select("path").collect()} == {"24.jpg", "84.jpg", "bad.jpg", "bomb.jpg", "x.nef"}


def test_folder_scan_of_tables_in_several_files(spark, tmp_path):
    """Tables that are folders of parts are listed once each by their own name, and one left out is left out with all its parts."""
    from lumenlake.case_queries import ORACLE_SQL, TABLES_LISTED, folder_scan

    for k, t in enumerate((*TABLES_LISTED, "nation")):
        rows = spark.range(4).repartition(1 + k % 3)
        if k % 3:
            rows.write.parquet(f"{tmp_path}/{t}.parquet")
        else:
            rows.toPandas().to_parquet(f"{tmp_path}/{t}.parquet")
    import duckdb

    want = sorted(duckdb.sql(ORACLE_SQL["folder_scan"]).fetchall())
    for base in (str(tmp_path), f"file://{tmp_path}/"):
        assert sorted(tuple(r) for r in folder_scan(spark, base).select("name", "format", "suffix", "sized").collect()) == want


def test_backends_tell_versions(spark):
    from lumenlake.sources import optional

    assert {r["name"]: r["available"] for r in optional.backends(spark).collect()} == {"exiftool": False, "rawpy": False, "pillow_heif": False}
    version, features = optional.library_info("pyarrow", Stub(libraw_version=(0, 21, 2), flags={"B": True, "A": True, "C": False}))
    assert version.endswith("(0.21.2)") and features == ["A", "B"] and optional.library_info("no such module", Stub()) == ("unknown", [])


def test_tables_by_name(spark, folder):
    from lumenlake.functions.register import TABLES, register
    from lumenlake.sources.files import photos

    register(spark)
    blobs = spark.read.format("binaryFile").load(str(folder)).select("path", "content").union(spark.createDataFrame([("none", None)], "path string, content binary"))
    blobs.createOrReplaceTempView("blobs_by_name")
    whole = {r["path"]: r for r in photos(blobs, ["path"]).collect()}
    for name, (column, _) in TABLES.items():
        got = {}
        for r in spark.sql(f"SELECT path, t.* FROM blobs_by_name, LATERAL jpeg_table(content, '{name}') AS t").collect():
            got.setdefault(r["path"], []).append(r.asDict(True))
        for path, r in whole.items():
            if column and path != "none":
                rows = r[column] if isinstance(r[column], list) else [r[column]] if r[column] else []
                assert [x for x in got.get(path, [])] == [{"path": path} | x.asDict(True) for x in rows], (name, path)
    assert len([c for c in spark.sql("SELECT t.* FROM blobs_by_name, LATERAL jpeg_table(content, 'segments') AS t").columns]) == 11
    for bad in ("jpeg_table(content, 'nothing')", "jpeg_table(content, path)", "jpeg_table(path, 'tags')"):
        with pytest.raises(Exception, match="jpeg_table"):
            spark.sql(f"SELECT * FROM blobs_by_name, LATERAL {bad}").collect()


def test_hostile_blobs_in_sql(spark):
    """What breaks a kernel is told in the row, in SQL too."""
    from test_kernels import deep_packet

    from lumenlake.functions.register import register
    from lumenlake.kernels import forge

    register(spark)
    hostile = forge.jpeg([forge.segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + deep_packet(3000))], 8, 8)
    spark.createDataFrame([("a", hostile), ("b", b"\xff\xd8"), ("c", None)], "k string, content binary").createOrReplaceTempView("hostile")
    rows = {r["k"]: r for r in spark.sql("SELECT k, parse_jpeg(content) AS p, scrub_jpeg(content, 'privacy') AS s, scrub_jpeg(content, 'nonsense') AS n FROM hostile").collect()}
    assert rows["b"]["p"]["errors"] and rows["c"]["p"] is None and rows["c"]["s"] is None and rows["a"]["s"]
    assert spark.sql("SELECT count(*) AS n FROM hostile, LATERAL jpeg_tags(content)").first()["n"] == 0
