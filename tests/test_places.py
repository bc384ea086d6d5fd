"""Places and captures as expressions, against fractions in Python."""

import random
from fractions import Fraction

import plain_capture
import plain_gps
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenlake.functions import places, rationals
from lumenlake.kernels.tiff import tagged
from lumenlake.sources.schema import TAG

RNG = random.Random(20)
BIG = 2**32 - 1


def photo(spark, rows):
    """A table with ``tags`` of each row: lists of (ifd, name, value)."""
    kind = StructType.fromDDL(f"k int, tags array<{TAG}>")
    made = []
    for k, tags in enumerate(rows):
        full = tags and [{"ifd": i, "pos": p, "tag": 0, "tag_name": n, "field_type": 0, "field_type_name": "", "count": 1, "value": tagged(v)} for p, (i, n, v) in enumerate(tags)]
        made.append((k, full))
    return spark.createDataFrame(made, kind).repartition(4)


def odd_number():
    return RNG.choice([0, 1, RNG.randrange(60), RNG.randrange(100), RNG.randrange(BIG), BIG, Fraction(RNG.randrange(1, 6000), RNG.randrange(1, 100)), Fraction(RNG.randrange(60), 1 + RNG.randrange(BIG)), Fraction(RNG.randrange(1, BIG), RNG.randrange(1, BIG))])


def odd_value():
    return RNG.choice([odd_number(), odd_number(), tuple(odd_number() for _ in range(RNG.choice([0, 1, 2, 3, 3, 3, 4]))), "N", "text", b"\x01", b"ab", b"", 0.5, (1.0, 2.5, 3.0), None, Fraction(-1, 3), -5])


def fix(row):
    """-0.0 as 0.0, and the text of a reference that is neither number nor text left out."""
    out = {k: (v + 0.0 if isinstance(v, float) else v) for k, v in row.items()}
    if (out["altitude_reference"] or "").startswith("unknown"):
        out["altitude_reference"] = out["altitude_reference"][:23]
    return out


def test_places_as_fractions_give_them(spark):
    rows = [None, [], [("ExifIFD", "GPSLatitude", 1)]]
    for _ in range(1500):
        mixed = lambda: tuple(Fraction(RNG.randrange(60 * d), d) for d in (RNG.choice([1, 7, 100, 9999, 10**6, BIG]) for _ in range(3)))
        tags = {"GPSLatitude": RNG.choice([mixed(), mixed(), tuple(RNG.randrange(61) for _ in range(3)), odd_value()]), "GPSLatitudeRef": RNG.choice(["N", " s ", "E", "x", "", odd_value()])}
        tags |= {"GPSLongitude": RNG.choice([mixed(), odd_value()]), "GPSLongitudeRef": RNG.choice(["w", "E", "S\t", odd_value()])}
        tags |= {"GPSAltitude": odd_value(), "GPSAltitudeRef": RNG.choice([b"\x00", b"\x01", 2, 3, 9, BIG, odd_value()])}
        tags |= {"GPSDateStamp": RNG.choice(["2026:08:11", "2026:8:1", "a:b", "abcd:ef:gh", "2026:08:11\n", odd_value()])}
        tags |= {"GPSTimeStamp": RNG.choice([mixed(), mixed(), (RNG.randrange(25), RNG.randrange(61), Fraction(RNG.randrange(120_000), 2000)), (1.0, 2.0, 59.9996), odd_value()]), "GPSImgDirection": odd_value()}
        rows.append([("GPS", n, v) for n, v in tags.items() if v is not None and RNG.random() < 0.9])
    rows.append([("GPS", "GPSAltitude", 1), ("GPS", "GPSAltitude", 2)])  # the last counts
    got = {r["k"]: r["location"] for r in places.with_places(photo(spark, rows)).collect()}
    assert got[0] is None and not got[1]["gps_detected"] and not got[2]["gps_detected"]
    for k, tags in enumerate(rows[1:], 1):
        named = {n: v for i, n, v in tags if i == "GPS"}
        want = plain_gps.location(named)
        if want["altitude_ref"] is not None and want["altitude_ref"] >= 2**31:
            want["altitude_ref"] = None
        assert fix(got[k].asDict()) == fix(want), (named, got[k], want)


def test_captures_as_fractions_give_them(spark):
    rows, dates = [None, []], ["2020:01:02 03:04:05", "2020:1:2 3:4:5", "2020:02:30 00:00:00", "2020:01:02  03:04:05", "2020:01:02\t03:04:05", "0000:01:01 00:00:00", "2020:01:02 24:00:00", "x", "", " 2020:01:02 03:04:05", "2020:01:02 03:04:60"]
    for _ in range(1500):
        tags = {"DateTimeOriginal": RNG.choice([*dates, odd_value()]), "ExposureTime": RNG.choice([Fraction(1, RNG.randrange(1, 5000)), Fraction(2, RNG.randrange(1, 50)), odd_value()])}
        tags |= {"FNumber": RNG.choice([Fraction(RNG.randrange(10, 320), 10), odd_value(), odd_number()]), "FocalLength": RNG.choice([odd_number(), odd_number(), Fraction(1234565, 10**RNG.randrange(10)), odd_value()])}
        tags |= {"LensMake": RNG.choice(["Canon", " nubia ", "", odd_value()]), "LensModel": RNG.choice(["canon EF", "Nubia Wide", "Wide", " ", odd_value()])}
        tags |= {n: odd_value() for n in places.ISO_TAGS}
        rows.append([("ExifIFD", n, v) for n, v in tags.items() if v is not None and RNG.random() < 0.8])
    got = {r["k"]: r["capture"] for r in places.with_captures(photo(spark, rows)).collect()}
    assert got[0] is None
    for k, tags in enumerate(rows[1:], 1):
        assert got[k].asDict() == plain_capture.summary({n: v for _, n, v in tags}), (tags, got[k])


def test_doubles_are_rounded_once(spark):
    pairs = [(0, 1), (1, 3), (2**53 + 1, 1), (2**54 + 2, 2), (1, 2**31), (1, 3600 * 2**96), (2**109 - 1, 3600 * 2**96), (RNG.getrandbits(100), RNG.getrandbits(60) + 2**60)]
    pairs += [(RNG.getrandbits(RNG.randrange(1, 100)), 1 + RNG.getrandbits(RNG.randrange(50, 107))) for _ in range(2000)]
    pairs = [(n, d) for n, d in pairs if n // d < 2**62]
    df = spark.createDataFrame([(str(n), str(d)) for n, d in pairs], "n string, d string").select(F.col("n").cast("decimal(38,0)").alias("n"), F.col("d").cast("decimal(38,0)").alias("d"))
    got = df.select("n", "d", rationals.nearest_double(F.col("n"), F.col("d")).alias("x")).collect()
    assert len(got) == len(pairs)
    for r in got:
        assert r["x"] == float(Fraction(int(r["n"]), int(r["d"]))), r


def test_printed_doubles(spark):
    values = [0.0, 1.0, 2.8, 1e5, 999999.5, 999999.4999999, 1e6, 123456.5, 123455.5, 0.0001, 0.00009999995, 1e-9, 2.0**-32, 2.0**32, -2.5, 1.000005, 0.5, 1e-7, 72.0, 1 / 3, 9.999995, 99.99995]
    values += [RNG.choice([1, -1]) * RNG.randrange(1, BIG) / RNG.randrange(1, BIG) for _ in range(2000)] + [RNG.randrange(1, 10**7) / 10**6 for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", rationals.shown(F.col("v")).alias("s")).collect():
        assert r["s"] == f"{r['v']:g}", r
    small = [v for v in map(abs, values) if v < 60]
    for r in spark.createDataFrame([(v,) for v in [*small, 0.0005, 0.0015, 0.0625, 1.0005, 59.9995, 1e-12]], "v double").select("v", rationals.fixed(F.col("v"), 3).alias("n")).collect():
        assert r["n"] == int(f"{r['v']:.3f}".replace(".", "")), r


def test_summaries_of_a_photo(spark):
    from test_kernels import sample

    from lumenlake.sources import files

    blobs = spark.createDataFrame([(big, bytes(sample(big))) for big in (False, True)] + [(None, None), (None, b"x")], "big boolean, content binary")
    for r in files.photos(blobs, ["big"], columns=("location", "capture", "width")).where("big is not null").collect():
        assert r.asDict().keys() == {"big", "location", "capture", "width"}
        where = r["location"]
        assert (where["latitude"], where["longitude"], where["altitude"], where["altitude_ref"]) == (19.432608, -99.133209, 2240.0, 0)
        assert (where["gps_date"], where["gps_time"], where["image_direction"], where["error"]) == ("2026-08-11", "16:32:51 UTC", 123.45, None)
        assert r["capture"].asDict() == {"date": "2026-08-11", "time": "14:32:51", "exposure": "1/120 s", "iso": 100, "aperture": "f/1.7", "focal_length": "24 mm", "lens": "nubia REDMAGIC Camera"}
    assert files.photos(blobs, ["big"], columns=("location",)).where("not coalesce(location.gps_detected, false)").count() == 2


@pytest.mark.parametrize(("n", "d"), [(5, 2), (7, 2), (1, 3), (2, 3), (0, 5), (2**70 + 2**63, 2**64)])
def test_half_even(spark, n, d):
    w = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    assert spark.range(1).select(rationals.half_even(w(n), w(d)).alias("x")).first()["x"] == round(Fraction(n, d))
