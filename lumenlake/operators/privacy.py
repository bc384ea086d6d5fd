"""Privacy exposure: findings over a bronze row, and their score."""

from __future__ import annotations

from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.values import compact, has, iptc_present, let, present, xmp_present

#: Points of the scored findings, in output order; together 100.
POINTS = {
    "gps_coordinates": (40, "GPS coordinates"), "serial_number": (20, "Serial number"), "original_capture_date": (10, "Original capture date"),
    "device_model": (10, "Device model"), "owner_information": (10, "Owner information"), "software": (5, "Software"), "copyright_author": (5, "Copyright / author"),
}
MAXIMUM, HIGH, MEDIUM = 100, 50, 25
#: Names that each finding looks for; the findings' messages below are fixed too.
SERIAL_XMP = ("SerialNumber", "CameraSerialNumber", "LensSerialNumber")
UNIQUE_XMP = ("DocumentID", "InstanceID", "OriginalDocumentID", "Identifier", "ImageUniqueID")
PLACE_IPTC = ("Sublocation", "City", "ProvinceState", "CountryCode", "CountryName")
PLACE_XMP = (
    "Location", "Sublocation", "City", "State", "ProvinceState", "Country", "CountryName", "CountryCode", "LocationCreated", "LocationShown", "GPSLatitude", "GPSLongitude",
)
#: Columns of the bronze table that the rules read.
NEEDS = ("has", "xmp", "errors")
#: Columns that tell which findings there are, without what they hold.
FOUND_NEEDS = ("has", "has_xmp", "errors")
FINDINGS = "array<struct<code:string,severity:string,message:string,sources:array<string>,fields:array<string>>>"


#: Fields of a group, whether there can be any: told by a look at names, so that most rules end there; and whether there are any, by ``FOUND_NEEDS``.
Group = tuple[Column, Column, Column]
#: Rank, code and finding, as an array of one or none, and whether it is there by ``FOUND_NEEDS``.
Rule = tuple[int, str, Column, Column]


def _tags(ifd: str, *names: str) -> Group:
    there = reduce(or_, [has(ifd, n) for n in names])
    return present(ifd, names), there, there


def _xmp(*names: str) -> Group:
    there = F.lower(F.array_join(F.col("xmp")["local_name"], ","))
    return xmp_present(names), reduce(or_, [F.contains(there, F.lit(n.lower())) for n in names]), reduce(or_, [F.array_contains("has_xmp", n.lower()) for n in names])


def _iptc(names: dict[str, str]) -> Group:
    there = reduce(or_, [has("IPTC", d) for d in names.values()])
    return iptc_present(names), there, there


def _finding(code: str, severity: str, message: str, sources: Column, fields: Column) -> Column:
    return F.array(F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(message).alias("message"), sources.alias("sources"), fields.alias("fields")))


def _ranked(code: str, severity: str, when: Column, finding: Column, there: Column) -> Rule:
    return ("high", "medium", "low").index(severity), code, F.when(when, finding).otherwise(F.array().cast(FINDINGS)), there


def _tag_rule(code: str, severity: str, message: str, source: str, ifd: str, *names: str) -> Rule:
    """A finding where all the tags are present."""
    there = reduce(and_, [has(ifd, n) for n in names])
    return _ranked(code, severity, there, _finding(code, severity, message, F.array(F.lit(source)), F.array(*map(F.lit, names))), there)


def _rule(code: str, severity: str, message: str, *groups: tuple[str, list[Group]]) -> Rule:
    """``_tag_rule`` where any field of ``groups``, which are (source, fields) in order, is present."""
    none = F.array().cast("array<string>")
    of = {s: F.concat(*[g for g, _, _ in parts]) for s, parts in groups}
    fields = F.concat(none, *of.values())
    sources = F.array_distinct(compact(*[F.when(F.size(g) > 0, F.lit(s)) for s, g in of.items()]))
    found = lambda x: F.when(F.size(x["fields"]) > 0, _finding(code, severity, message, x["sources"], x["fields"])).otherwise(F.array().cast(FINDINGS))
    may, there = (reduce(or_, [g[k] for _, parts in groups for g in parts]) for k in (1, 2))
    return _ranked(code, severity, may, let(F.struct(sources.alias("sources"), fields.alias("fields")), found), there)


def _rules() -> list[Rule]:
    return [
        _tag_rule("gps_coordinates", "high", "GPS coordinates present", "GPS", "GPS", "GPSLatitude", "GPSLongitude"),
        _tag_rule("gps_altitude", "medium", "GPS altitude present", "GPS", "GPS", "GPSAltitude"),
        _tag_rule("original_capture_date", "medium", "Original capture date exposed", "EXIF", "ExifIFD", "DateTimeOriginal"),
        _tag_rule("device_model", "medium", "Device model exposed", "EXIF", "IFD0", "Model"),
        _rule("serial_number", "high", "Device or lens serial number exposed", ("EXIF", [_tags("ExifIFD", "BodySerialNumber", "LensSerialNumber")]), ("XMP", [_xmp(*SERIAL_XMP)])),
        _rule(
            "owner_information", "medium", "Owner or creator information present", ("EXIF", [_tags("IFD0", "Artist"), _tags("ExifIFD", "CameraOwnerName")]),
            ("XMP", [_xmp("creator", "OwnerName")]), ("IPTC", [_iptc({"Creator": "Byline"})]),
        ),
        _rule("software", "low", "Software information exposed", ("EXIF", [_tags("IFD0", "Software")]), ("XMP", [_xmp("CreatorTool", "Software")])),
        _rule(
            "copyright_author", "medium", "Copyright or author metadata present", ("EXIF", [_tags("IFD0", "Copyright")]),
            ("XMP", [_xmp("rights", "Copyright", "CopyrightNotice")]), ("IPTC", [_iptc({"Copyright": "CopyrightNotice"})]),
        ),
        _rule("unique_identifier", "high", "Unique identifier present", ("EXIF", [_tags("ExifIFD", "ImageUniqueID")]), ("XMP", [_xmp(*UNIQUE_XMP)])),
        _rule("editorial_location", "high", "IPTC/XMP location metadata present", ("IPTC", [_iptc({n: n for n in PLACE_IPTC})]), ("XMP", [_xmp(*PLACE_XMP)])),
    ]


#: Codes of all findings.
CODES = frozenset({*POINTS, "gps_altitude", "unique_identifier", "editorial_location"})


def findings() -> Column:
    """Findings of a bronze row by severity, then code."""
    return F.concat(*[f for _, _, f, _ in sorted(_rules(), key=lambda r: r[:2])])


def found() -> Column:
    """struct of whether each finding is there, by code, of a row with ``FOUND_NEEDS``."""
    return F.struct(*[there.alias(code) for _, code, _, there in sorted(_rules(), key=lambda r: r[:2])])


def found_in(found: Column) -> Column:
    """``found`` of findings that are made already; null where these are."""
    return F.when(found.isNotNull(), F.struct(*[F.array_contains(found["code"], code).alias(code) for code in sorted(CODES)]))


def points(found: Column) -> Column:
    given = reduce(add, [F.when(F.array_contains(found["code"], c), p).otherwise(0) for c, (p, _) in POINTS.items()])
    return F.when(found.isNotNull(), F.least(F.lit(MAXIMUM), given))


def level(score: Column) -> Column:
    return F.when(score >= HIGH, "HIGH").when(score >= MEDIUM, "MEDIUM").when(score.isNotNull(), "LOW")


#: Parts of the bronze row whose failure leaves the context unknown.
CONTEXT_PARTS = ("header", "exif", "xmp", "iptc")


def context_error() -> Column:
    """First message of a part that the rules need; null where all could be read."""
    return F.when(F.size("errors") > 0, F.try_element_at(F.filter("errors", lambda e: e["part"].isin(*CONTEXT_PARTS)), F.lit(1))["message"])


def assess(photos: DataFrame) -> DataFrame:
    """``photos`` with findings, points, level; all null, and an error, where the context could not be read."""
    error = context_error()
    found = F.when(error.isNull(), findings())
    return photos.withColumn("privacy_error", error).withColumn("findings", found).withColumn("points", points(F.col("findings"))).withColumn("level", level(F.col("points")))


def judge(photos: DataFrame) -> DataFrame:
    """``photos`` with ``found``, points, level as ``assess`` gives them, without the findings: of ``FOUND_NEEDS``."""
    error = context_error()
    given = reduce(add, [F.when(F.col("found")[c], p).otherwise(0) for c, (p, _) in POINTS.items()])
    rows = photos.withColumn("privacy_error", error).withColumn("found", F.when(error.isNull(), found()))
    return rows.withColumn("points", F.when(F.col("found").isNotNull(), F.least(F.lit(MAXIMUM), given))).withColumn("level", level(F.col("points")))


def exploded(assessed: DataFrame, keys: list[str]) -> DataFrame:
    return assessed.select(*keys, F.explode("findings").alias("f")).select(*keys, "f.*")
