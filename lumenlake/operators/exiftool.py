"""The JSON of an external metadata tool, normalised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.text import strip_or_null

#: Pairs of width and height, best first; groups that hold EXIF.
RESOLUTIONS = (
    ("File:ImageWidth", "File:ImageHeight"), ("SubIFD:ImageWidth", "SubIFD:ImageHeight"), ("ExifIFD:ExifImageWidth", "ExifIFD:ExifImageHeight"),
    ("QuickTime:ImageWidth", "QuickTime:ImageHeight"), ("IFD0:ImageWidth", "IFD0:ImageHeight"), ("XMP-tiff:ImageWidth", "XMP-tiff:ImageHeight"),
    ("XMP-exif:ExifImageWidth", "XMP-exif:ExifImageHeight"),
)
#: Facts by the tags that hold them, in the order in which they are looked for.
FACTS = {
    "file_type": ("FileType",), "mime": ("MIMEType",), "make": ("Make",), "model": ("Model", "CameraModelName"), "software": ("Software",),
    "datetime_original": ("DateTimeOriginal",), "lens_make": ("LensMake",), "lens_model": ("LensModel", "LensID"), "orientation": ("Orientation",),
}
EXIF_GROUPS = ("IFD0", "ExifIFD", "InteropIFD", "GPS")


_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def kind(v: Column) -> Column:
    """BIGINT, DECIMAL, DOUBLE, STRING, BOOLEAN ... of a variant."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def whole(v: Column) -> Column:
    """An integer of a JSON value: a fraction is cut, text is read as a number first; null for anything else, truth values included."""
    said = F.trim(F.try_variant_get(v, "$", "string"))
    number = F.when(kind(v).isin("DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get(v, "$", "double")).when((kind(v) == "STRING") & said.rlike(_NUMBER), said.try_cast("double"))
    return F.when(kind(v) == "BIGINT", F.try_variant_get(v, "$", "bigint")).otherwise(F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).try_cast("bigint"))


def said(v: Column) -> Column:
    """Text of a JSON value as it is shown: numbers plainly, truth values as words; null for null, lists and objects."""
    x = F.try_variant_get(v, "$", "double")
    plain = F.regexp_replace(F.regexp_replace(x.try_cast("decimal(38,15)").cast("string"), "0+$", ""), r"\.$", ".0")
    return (
        F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string")).when(kind(v) == "BIGINT", F.try_variant_get(v, "$", "bigint").cast("string"))
        .when(kind(v).isin("DECIMAL", "DOUBLE", "FLOAT"), F.when(F.abs(x).between(1e-3, 1e7) | (x == 0), x.cast("string")).otherwise(F.coalesce(plain, x.cast("string"))))
        .when(kind(v) == "BOOLEAN", F.initcap(F.try_variant_get(v, "$", "string")))
    )


def first_tag(m: Column, *names: str) -> Column:
    """Of each name in turn the value under it as a key, else under the first key that ends with ``:name``."""
    found = [(F.try_element_at(m, F.lit(n)), F.try_element_at(F.filter(F.map_entries(m), _ends(n)), F.lit(1))["value"]) for n in names]
    return F.coalesce(*[c for pair in found for c in pair])


def _ends(name: str):
    return lambda e: F.endswith(e["key"], F.lit(f":{name}"))


def group_of(key: Column) -> Column:
    return F.when(F.contains(key, F.lit(":")), F.substring_index(key, ":", 1)).otherwise("Other")


def normalise(df: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """Facts of one JSON object of ``Group:Tag`` keys per row; values keep their JSON types."""
    m = F.map_filter(F.from_json(F.col(payload), "map<string,variant>"), lambda k, _: k != "SourceFile")
    base = df.select(*keys, m.alias("m"))
    size = lambda w, h: F.when((w > 0) & (h > 0), F.struct(w.alias("w"), h.alias("h")))
    get = lambda k: F.try_element_at(F.col("m"), F.lit(k))
    pairs = [size(whole(get(w)), whole(get(h))) for w, h in RESOLUTIONS]
    groups = F.array_distinct(F.transform(F.map_keys("m"), group_of))
    own = lambda g, tag: whole(F.try_element_at(F.col("m"), F.concat(g, F.lit(":" + tag))))
    fallback = F.try_element_at(F.filter(F.transform(groups, lambda g: size(own(g, "ImageWidth"), own(g, "ImageHeight"))), lambda s: s.isNotNull()), F.lit(1))
    best = F.coalesce(*pairs, fallback)
    has = lambda cond: F.when(F.exists(groups, cond), "YES").otherwise("NO")
    counts = F.transform(
        F.array_sort(F.transform(groups, lambda g: F.struct(F.lower(g).alias("k"), g.alias("group")))),
        lambda s: F.struct(s["group"].alias("group"), F.size(F.filter(F.map_keys("m"), lambda k: group_of(k).eqNullSafe(s["group"]))).alias("count")),
    )
    warnings = F.array_distinct(F.transform(F.filter(F.map_entries("m"), lambda e: F.substring_index(e["key"], ":", -1).isin("Warning", "Error")), lambda e: strip_or_null(said(e["value"]))))
    warnings = F.filter(warnings, lambda w: w.isNotNull())
    return base.select(
        *keys, best["w"].alias("width"), best["h"].alias("height"),
        *[strip_or_null(said(first_tag(F.col("m"), *names))).alias(c) for c, names in FACTS.items()],
        has(lambda g: g.isin(*EXIF_GROUPS) | F.startswith(g, F.lit("SubIFD"))).alias("exif"), F.when(F.exists(F.map_keys("m"), lambda k: F.startswith(F.substring_index(k, ":", -1), F.lit("GPS"))), "YES").otherwise("NO").alias("gps"),
        has(lambda g: F.startswith(g, F.lit("XMP"))).alias("xmp"), has(lambda g: F.startswith(g, F.lit("IPTC"))).alias("iptc"), has(lambda g: F.startswith(g, F.lit("ICC"))).alias("icc"),
        has(lambda g: F.startswith(g, F.lit("QuickTime"))).alias("quicktime"),
        counts.alias("group_counts"), F.size("m").alias("tag_count"), warnings.alias("warnings"),
    )
