"""Windows, groups and aggregates over segment rows against walks over whole files."""

import random

import pytest
from pyspark.sql import functions as F

from lumenlake.kernels import forge, icc, photo
from lumenlake.kernels.jpeg import ICC_ID, SCAN, full_walk
from lumenlake.kernels.limits import Limits, ParseError
from lumenlake.operators import segments
from lumenlake.plans import forged
from lumenlake.sources import files

RNG = random.Random(3)
ALL = (segments.APP2, segments.DQT, segments.DHT, SCAN)


def scans(*parts):
    """A file of several scans with tables between them, stuffed bytes, restart markers and a late EXIF block."""
    head = forge.jpeg([], 40, 30)[:-5]  # without its scan and end
    body = b"".join(forge.segment(0xC4, bytes([k])) + forge.segment(0xDA, b"\x01\x01\x00\x00\x3f\x00") + p for k, p in enumerate(parts))
    return head + b"\x01\x02" + body + forge.segment(0xE1, b"Exif\0\0late") + b"\xff\xd9tail"


SAMPLES = {
    "scans": scans(b"\xff\x00a\xff\xd0b", b"c\xff\x01d", b""), "plain": forge.jpeg([], 8, 9), "bad": b"\xff\xd8broken", "none": b"", "null": None, "cut": forge.jpeg([forge.segment(0xFE, b"c")], 8, 9)[:-3],
    "blocks": forge.jpeg([forge.exif([(0x0110, 2, "A")], None, [(1, 2, "N")]), forge.segment(0xE1, b"Exif\0\0broken"), forge.exif([(0x0110, 2, " ")])], 8, 9),
    "broken": forge.jpeg([forge.exif([(0x0110, 2, "A")]), forge.segment(0xE1, b"Exif\0\0broken")], 8, 9),
} | {f"o{o}": forged.blocks_photo({"o": o, "c": 3 * o + 1}) for o in range(1, 40)}


@pytest.fixture(scope="module")
def blobs(spark):
    return spark.createDataFrame(list(SAMPLES.items()), "path string, content binary").repartition(3)


@pytest.fixture(scope="module")
def rows(blobs):
    return files.segment_rows(blobs, ["path"], payload_of=ALL)


def test_rows_are_those_of_the_walk(rows):
    got = {}
    for r in rows.collect():
        got.setdefault(r["path"], []).append(r)
    assert set(got) == set(SAMPLES)
    for name, data in SAMPLES.items():
        try:
            walk = full_walk(data or b"", keep_scans=True)
        except ParseError as e:
            assert {r["error"] for r in got[name]} == {str(e)}
            continue
        mine = sorted((r["seq"], r["offset"], r["marker"], r["payload_length"], r["late"]) for r in got[name])
        assert mine == sorted((s.seq, s.offset, s.marker, len(s.payload), s.late) for s in [*walk.segments, *walk.scans])
        assert all((r["payload"] is None) == (r["marker"] not in ALL) for r in got[name])
    assert {r["seq"] for r in got["bad"]} == {None} and {r["seq"] for r in got["cut"]} == {0, 1, 2, 3, 4}  # up to the scan that has no end


def test_facts_by_windows(rows):
    got = {r["path"]: r for r in segments.file_facts(rows.where(F.coalesce(F.col("marker"), F.lit(0)) != SCAN), ["path"]).collect()}
    assert set(got) == set(SAMPLES)
    for name, data in SAMPLES.items():
        whole, r = photo.parse(data or b""), got[name]
        if whole["presence"] is None:
            assert r["error"]
            continue
        walk = full_walk(data)
        assert (r["gps"], r["camera_model"], r["exif_segments"], r["jpeg_process"]) == (whole["presence"]["gps"], whole["presence"]["camera_model"], whole["exif_segments"], whole["jpeg_process"]), name
        assert [f"EXIF: {p}" for p in r["problems"]] == whole["presence"]["warnings"] and r["error"] is None
        assert (r["width"], r["height"]) == (whole["width"], whole["height"])
        assert r["segment_count"] == len(walk.segments) and r["payload_bytes"] == sum(len(s.payload) for s in walk.segments)


def test_running_sums_and_budget(rows):
    small = Limits(max_jpeg_header_payload_bytes=150)
    got = {r["path"]: r["over_budget"] for r in segments.file_facts(rows.where(F.coalesce(F.col("marker"), F.lit(0)) != SCAN), ["path"], small).collect()}
    for name, data in SAMPLES.items():
        header = photo.parse(data or b"", small)["errors"]
        refused = any(e["message"] == "JPEG header payloads exceed the limit" for e in header)
        assert (got[name] is not None) == refused, name
    sums = [(r["seq"], r["payload_sum"], r["exif_before"], r["model_now"]) for r in segments.in_order(rows.where("path = 'blocks'"), ["path"]).orderBy("seq").collect()]
    assert [s[2] for s in sums][:5] == [0, 1, 2, 3, 3] and sums[3][3] == "A" and all(a[1] <= b[1] for a, b in zip(sums, sums[1:]))


def chunked():
    """Random chunks of a profile, most of them sound."""
    profile = forge.icc_profile("Name " + "x" * RNG.randrange(40), RNG.choice([b"RGB ", b"GRAY", b"abcd"]), RNG.choice([b"mntr", b"????"]), RNG.random() < 0.3)
    profile = RNG.choice([profile, profile, profile, profile[:100], profile[:-1], profile[:36] + b"none" + profile[40:], profile[:128] + b"\0\0\xff\xff" + profile[132:], profile[:140] + b"\xff\xff\xff\xff" + profile[144:]])
    n = RNG.choice([1, 1, 2, 3, 11])
    step = -(-len(profile) // n)
    made = [(k + 1, n, profile[k * step : (k + 1) * step]) for k in range(n)]
    for _ in range(RNG.choice([0, 0, 0, 1])):
        k = RNG.randrange(len(made))
        made[k : k + 1] = RNG.choice([[], [made[k]] * 2, [(0, n, b"x")], [(made[k][0], n + 1, made[k][2])], [(n + 2, n, b"")], [(1, 1, made[k][2])]])
    RNG.shuffle(made)
    parts = [ICC_ID + bytes(x[:2]) + x[2] for x in made] + ([ICC_ID + b"\1"] if RNG.random() < 0.1 else [])
    return parts, forge.jpeg([forge.segment(0xE2, p) for p in parts] + [forge.segment(0xE2, b"other")], 8, 8)


def test_profiles_of_chunks(spark):
    made = [chunked() for _ in range(300)]
    blobs = spark.createDataFrame([(k, x[1]) for k, x in enumerate(made)], "k int, content binary").repartition(4)
    found = segments.profiles(files.segment_rows(blobs, ["k"], payload_of=(segments.APP2,)), ["k"])
    got = {r["k"]: r for r in found.collect()}
    heads = {r["k"]: r for r in segments.profile_header(found, ["k"]).collect()}
    for k, (parts, _) in enumerate(made):
        if not parts:
            assert k not in got
            continue
        try:
            want, problem = icc.reassemble(parts), None
        except ParseError as e:
            want, problem = None, str(e)
        assert (got[k]["profile"], got[k]["problem"] is None) == (want, problem is None), (got[k], problem)
        # Where a file has several faults, which one is told first may differ.
        assert problem is None or got[k]["problem"].startswith(("ICC", "duplicate"))
        if want is None:
            continue
        try:
            facts, problem = icc.parse(want), None
        except ParseError as e:
            facts, problem = None, str(e)
        if facts is None and "ICC name" not in problem and "description" not in problem:
            assert heads[k]["problem"] == problem
        elif facts is not None:
            same = ("size", "cmm", "version", "profile_class", "color_space", "pcs", "platform")
            assert [heads[k][c] for c in same] == [facts[c] for c in same] and [t.asDict() for t in heads[k]["tags"]] == facts["tags"]
    few = segments.profiles(files.segment_rows(blobs, ["k"], payload_of=(segments.APP2,)), ["k"], Limits(max_icc_chunks=2, max_icc_profile_bytes=200))
    said = {r["problem"] for r in few.collect()}
    assert {"too many ICC chunks", None} < said


def test_fingerprints_in_sql(spark, blobs, rows):
    segments.register(spark)
    rows.createOrReplaceTempView("segment_rows_of_test")
    got = {r["path"]: r for r in spark.sql(
        f"""SELECT path, jpeg_fingerprint(seq, CASE WHEN marker = {segments.DQT} THEN payload END) AS q, jpeg_fingerprint(seq, CASE WHEN marker = {segments.DHT} THEN payload END) AS h,
 ordered_sha256(offset, CASE WHEN marker = {SCAN} THEN payload END) AS s FROM segment_rows_of_test GROUP BY path""").collect()}  # fmt: skip
    want = {r["path"]: r for r in files.photos(blobs, ["path"], columns=("quantization", "huffman", "scan_sha256")).collect()}
    for name, data in SAMPLES.items():
        if want[name]["scan_sha256"] is not None:
            assert (got[name]["q"], got[name]["h"], got[name]["s"]) == (want[name]["quantization"], want[name]["huffman"], want[name]["scan_sha256"]), name


def test_empty_table(spark):
    rows = files.segment_rows(spark.createDataFrame([], "path string, content binary"), ["path"], payload_of=ALL)
    assert segments.file_facts(rows, ["path"]).count() == segments.profiles(rows, ["path"]).count() == 0


def test_fingerprints_by_own_aggregates(spark):
    """SQL's own aggregates give what the functions give, also of none, of several and of empty payloads in any order."""
    rows = spark.createDataFrame([(1, 2, b"bb"), (1, 1, b"a"), (2, 1, None), (3, 1, b""), (3, 2, b"\xff" * 300)], "o int, seq int, payload binary")
    segments.register(spark)
    ours = f"{segments.fingerprint_of('payload')} AS a, {segments.sha256_of('payload', 'seq')} AS b"
    theirs = "jpeg_fingerprint(seq, payload) AS a, ordered_sha256(seq, payload) AS b"
    found = [spark.sql(f"SELECT o, {x} FROM {{rows}} GROUP BY o ORDER BY o", rows=rows).collect() for x in (ours, theirs)]
    assert found[0] == found[1]
