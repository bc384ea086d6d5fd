"""Place and capture summaries of a photo, as Column expressions over its tag values.

``with_places`` and ``with_captures`` add what the GPS and Exif directories say, the last entry of a tag counting. Coordinates are
sums of fractions, rounded once; a coordinate that is there but wrong is the row's error, one that is missing is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.rationals import fixed, half_even, nearest_double, shown, whole
from lumenlake.functions.values import exif_timestamp, integer, let, tag, text

#: Sign and text of an altitude's reference.
ALTITUDE = {0: (1, "positive ellipsoidal height"), 1: (-1, "negative ellipsoidal height"), 2: (1, "positive sea-level altitude"), 3: (-1, "negative sea-level altitude")}
ISO_TAGS = ("PhotographicSensitivity", "ISOSpeed", "StandardOutputSensitivity", "RecommendedExposureIndex")
GPS_TAGS = ("GPSLatitude", "GPSLatitudeRef", "GPSLongitude", "GPSLongitudeRef", "GPSAltitude", "GPSAltitudeRef", "GPSDateStamp", "GPSTimeStamp", "GPSImgDirection")
CAPTURE_TAGS = ("DateTimeOriginal", "ExposureTime", "FNumber", "FocalLength", "LensMake", "LensModel", *ISO_TAGS)
#: White space that Python's strip takes from ASCII text.
_BLANK = r"[\s\x1c-\x1f]+"


def fractions(v: Column) -> Column:
    """array<struct<num, den>> of a value of whole numbers or fractions; null for other kinds."""
    one = F.transform(v["ints"], lambda x: F.struct(x.alias("num"), F.lit(1).cast("long").alias("den")))
    return F.when(v["kind"] == "int", one).when(v["kind"] == "rational", v["rationals"])


def fraction(v: Column) -> Column:
    """struct<num, den> of a scalar that is exact."""
    return F.when(v["is_scalar"], F.get(fractions(v), F.lit(0)))


def number(v: Column) -> Column:
    """A scalar number as the nearest double."""
    f = fraction(v)
    return F.when(v["is_scalar"] & (v["kind"] == "float"), F.get(v["floats"], F.lit(0))).otherwise(f["num"].cast("double") / f["den"].cast("double"))


def strip(s: Column) -> Column:
    return F.regexp_replace(s, f"^{_BLANK}|{_BLANK}$", "")


def coordinate(value: Column, ref: Column) -> Column:
    """struct<degrees, error>: null and null where value or reference is missing."""
    parts, sign = fractions(value), F.upper(strip(text(ref)))
    three = ~value["is_scalar"] & (F.size(parts) == 3)
    d, m, s = (F.get(parts, F.lit(k)) for k in range(3))
    inside = lambda x: (x["num"] >= 0) & (x["num"] < 60 * x["den"])
    a, b, c = (whole(x["den"]) for x in (d, m, s))
    n = whole(whole(whole(d["num"]) * 3600 * b) * c) + whole(whole(whole(m["num"]) * 60 * a) * c) + whole(whole(whole(s["num"]) * a) * b)
    error = (
        F.when(~F.coalesce(three, F.lit(False)), "coordinate needs three numbers").when(ref["kind"] != "text", "coordinate reference is not text")
        .when(~((d["num"] >= 0) & inside(m) & inside(s)), "coordinate is out of range").when(~sign.isin("N", "S", "E", "W"), "coordinate reference is invalid")
    )
    size = nearest_double(whole(n), whole(whole(a * b) * c * 3600))
    degrees = F.when(error.isNull(), F.when(sign.isin("S", "W"), -size).otherwise(size))
    return F.when(value.isNotNull() & ref.isNotNull(), F.struct(degrees.alias("degrees"), error.alias("error")))


def altitude(value: Column, ref: Column) -> Column:
    """struct<high, code, reference>: signed by the reference, which is a number or one byte."""
    byte = F.when((ref["kind"] == "bytes") & (F.length(ref["bytes"]) == 1), F.conv(F.hex(ref["bytes"]), 16, 10).cast("long"))
    code, high = F.coalesce(byte, integer(ref)), number(value)
    signs = F.when(code.isin(1, 3), -F.abs(high)).when(code.isin(0, 2), F.abs(high)).otherwise(high)
    said = F.lit(None).cast("string")
    for k, (_, words) in ALTITUDE.items():
        said = F.when(code == k, words).otherwise(said)
    other = F.coalesce(code.cast("string"), ref["text"], F.hex(ref["bytes"]), F.to_json(ref["ints"]), F.to_json(ref["rationals"]), F.to_json(ref["floats"]))
    said = F.when(high.isNull(), None).when(ref.isNull(), "reference not provided").otherwise(F.coalesce(said, F.concat(F.lit("unknown EXIF reference ("), other, F.lit(")"))))
    return F.struct(signs.alias("high"), F.when(ref.isNotNull(), code.try_cast("int")).alias("code"), said.alias("reference"))


def gps_time(v: Column) -> Column:
    """Hours, minutes and seconds as text; thousandths are those of the nearest double, half to even."""
    each = F.when(v["kind"] == "float", v["floats"]).otherwise(F.transform(fractions(v), lambda f: f["num"].cast("double") / f["den"].cast("double")))

    def said(t: Column) -> Column:
        h, m, s = (F.get(t, F.lit(k)) for k in range(3))
        good = (F.size(t) == 3) & (h >= 0) & (h < 24) & (m >= 0) & (m < 60) & (s >= 0) & (s < 60)
        two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
        thousandths = fixed(s, 3)
        part = let(thousandths, lambda k: F.concat(F.lpad(F.floor(k / 1000).cast("string"), 2, "0"), F.regexp_replace(F.concat(F.lit("."), F.lpad((k % 1000).cast("string"), 3, "0")), r"\.?0+$", "")))
        return F.when(good, F.concat(two(h), F.lit(":"), two(m), F.lit(":"), F.when(s == F.floor(s), two(s)).otherwise(part), F.lit(" UTC")))

    return F.when(~v["is_scalar"], let(each, said))


def gps_date(v: Column) -> Column:
    return F.regexp_replace(text(v), r"(?s)\A([^:]{4}):([^:]{2}):([^:]{2})\z", "$1-$2-$3")


def with_places(df: DataFrame, name: str = "location") -> DataFrame:
    """``df`` with the location struct of its ``tags``; null where ``tags`` is."""
    v = {n: f"_{n}" for n in GPS_TAGS}
    df = df.withColumns({c: tag("GPS", n) for n, c in v.items()} | {"_gps": F.exists("tags", lambda t: t["ifd"] == "GPS")})
    c = {n: F.col(x) for n, x in v.items()}
    df = df.withColumns({
        "_lat": coordinate(c["GPSLatitude"], c["GPSLatitudeRef"]), "_lon": coordinate(c["GPSLongitude"], c["GPSLongitudeRef"]),
        "_alt": altitude(c["GPSAltitude"], c["GPSAltitudeRef"]),
    })
    place = F.struct(
        F.col("_gps").alias("gps_detected"), F.col("_lat.degrees").alias("latitude"), F.when(F.col("_lat.error").isNull(), F.col("_lon.degrees")).alias("longitude"),
        F.col("_alt.high").alias("altitude"), F.col("_alt.code").alias("altitude_ref"), F.col("_alt.reference").alias("altitude_reference"),
        gps_date(c["GPSDateStamp"]).alias("gps_date"), gps_time(c["GPSTimeStamp"]).alias("gps_time"), number(c["GPSImgDirection"]).alias("image_direction"),
        F.coalesce("_lat.error", "_lon.error").alias("error"),
    )
    return df.withColumn(name, F.when(F.col("tags").isNotNull(), place)).drop(*v.values(), "_gps", "_lat", "_lon", "_alt")


def date_time(v: Column) -> tuple[Column, Column]:
    """Date and time of an EXIF time stamp; one that is none is the date as it stands."""
    raw = text(v)
    at = exif_timestamp(F.regexp_replace(raw, f"(?<=[0-9]){_BLANK}(?=[0-9])", " "))
    return F.when(raw.isNotNull(), F.coalesce(F.date_format(at, "yyyy-MM-dd"), raw)), F.date_format(at, "HH:mm:ss")


def exposure(v: Column) -> Column:
    """Seconds; below one the reciprocal, rounded half to even."""

    def said(f: Column) -> Column:
        below = F.concat(F.lit("1/"), F.when(f["num"] == 1, f["den"]).otherwise(half_even(whole(f["den"]), whole(f["num"]))).cast("string"), F.lit(" s"))
        return F.when(f["num"] > 0, F.when(f["num"] < f["den"], below).otherwise(F.concat(shown(f["num"].cast("double") / f["den"].cast("double")), F.lit(" s"))))

    return let(fraction(v), said)


def measured(v: Column, before: str = "", after: str = "") -> Column:
    """The nearest double with six digits that count; whole tenths of up to six digits are those digits."""

    def said(f: Column) -> Column:
        tenths = f["num"] * F.call_function("div", F.lit(10), f["den"])
        plain = F.concat(F.call_function("div", tenths, F.lit(10)).cast("string"), F.when(tenths % 10 > 0, F.concat(F.lit("."), (tenths % 10).cast("string"))).otherwise(""))
        return F.when(f["den"].isin(1, 2, 5, 10) & f["num"].between(1, 99999), plain).otherwise(shown(f["num"].cast("double") / f["den"].cast("double")))

    return F.concat(F.lit(before), let(fraction(v), said), F.lit(after))


def lens(make: Column, model: Column) -> Column:
    """Maker and model, the maker once."""
    a, b = F.coalesce(strip(text(make)), F.lit("")), F.coalesce(strip(text(model)), F.lit(""))
    both = (a != "") & (b != "") & ~F.startswith(F.lower(b), F.lower(a))
    return F.nullif(F.when(both, F.concat(a, F.lit(" "), b)).when(b != "", b).otherwise(a), F.lit(""))


def with_captures(df: DataFrame, name: str = "capture") -> DataFrame:
    """``df`` with the capture struct of its ``tags``; null where ``tags`` is."""
    v = {n: f"_{n}" for n in CAPTURE_TAGS}
    df = df.withColumns({c: tag("ExifIFD", n) for n, c in v.items()})
    c = {n: F.col(x) for n, x in v.items()}
    date, time = date_time(c["DateTimeOriginal"])
    said = F.struct(
        date.alias("date"), time.alias("time"), exposure(c["ExposureTime"]).alias("exposure"), F.coalesce(*[integer(c[n]) for n in ISO_TAGS]).alias("iso"),
        measured(c["FNumber"], before="f/").alias("aperture"), measured(c["FocalLength"], after=" mm").alias("focal_length"), lens(c["LensMake"], c["LensModel"]).alias("lens"),
    )
    return df.withColumn(name, F.when(F.col("tags").isNotNull(), said)).drop(*v.values())
