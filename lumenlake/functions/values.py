"""Access to tags and properties in the bronze row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag(ifd: str, name: str, last: bool = True) -> Column:
    """Value struct of a tag: its last entry, or the first."""
    found = F.filter("tags", lambda t: (t["ifd"] == ifd) & (t["tag_name"] == name))
    return F.try_element_at(found, F.lit(-1 if last else 1))["value"]


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body`` any number of times."""
    return F.transform(F.array(value), body)[0]


def has_text(s: Column) -> Column:
    return F.coalesce(s.rlike(r"(?U)\S"), F.lit(False))


def has_value(v: Column) -> Column:
    """Present and not blank or empty; zero is present."""

    def test(x: Column) -> Column:
        many = x["is_scalar"] | (F.coalesce(F.size(x["ints"]), F.size(x["rationals"]), F.size(x["floats"]), F.lit(0)) > 0)
        kind = x["kind"]
        return F.coalesce(F.when(kind == "text", has_text(x["text"])).when(kind == "bytes", F.length(x["bytes"]) > 0).when(kind == "none", False).otherwise(many), F.lit(False))

    return let(v, test)


def text(v: Column) -> Column:
    return v["text"]  # null for other kinds


def has(group: str, name: str) -> Column:
    """A tag or dataset that has a value, by the kernel's list of those."""
    return F.array_contains("has", f"{group}/{name}")


def integer(v: Column) -> Column:
    """An integer scalar; null for anything else."""
    return let(v, lambda x: F.when((x["kind"] == "int") & x["is_scalar"], x["ints"][0]))


def number(v: Column) -> Column:
    one = F.coalesce(v["ints"][0].cast("double"), v["floats"][0], v["rationals"][0]["num"] / v["rationals"][0]["den"])
    return F.when(v["is_scalar"], one)


def compact(*names: Column) -> Column:
    return F.filter(F.array(*names), lambda x: x.isNotNull())


def present(ifd: str, names: Iterable[str]) -> Column:
    """Those of ``names`` that have a value, in the order given."""
    return compact(*[F.when(has(ifd, n), F.lit(n)) for n in names])


def xmp_present(names: Iterable[str]) -> Column:
    """Qualified names of the XMP properties with a value whose local name is among ``names``, case folded."""
    wanted = [n.lower() for n in names]
    full = F.filter("xmp", lambda p: F.lower(p["local_name"]).isin(*wanted) & (has_text(p["value_text"]) | (F.coalesce(F.size(p["value_list"]), F.lit(0)) > 0)))
    return F.array_distinct(F.transform(full, lambda p: p["qualified_name"]))


def iptc_values(name: str) -> Column:
    return F.transform(F.filter("iptc", lambda d: d["name"] == name), lambda d: d["text"])


def iptc_present(names: dict[str, str]) -> Column:
    """Keys of ``names`` whose dataset has a value."""
    return compact(*[F.when(has("IPTC", d), F.lit(k)) for k, d in names.items()])


def xmp_text(qualified: str) -> Column:
    return F.try_element_at(F.filter("xmp", lambda p: p["qualified_name"] == qualified), F.lit(1))["value_text"]


def xmp_list(qualified: str) -> Column:
    p = F.try_element_at(F.filter("xmp", lambda p: p["qualified_name"] == qualified), F.lit(1))
    return F.coalesce(p["value_list"], F.when(p["value_text"].isNotNull(), F.array(p["value_text"])), F.array().cast("array<string>"))


def xmp_rating() -> Column:
    return xmp_text("xmp:Rating").try_cast("int")


def exif_timestamp(s: Column) -> Column:
    """EXIF date and time, or null; single digits are accepted."""
    shape = s.rlike(r"^(?!0000)[0-9]{4}:[0-9]{1,2}:[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$")
    return F.when(shape, F.try_to_timestamp(s, F.lit("y:M:d H:m:s"))).cast("timestamp_ntz")


def by_rank(findings: Column, keys: tuple[str, ...] = ("code",)) -> Column:
    """Findings by severity, then ``keys``, then their place."""
    rank = lambda f: F.when(f["severity"] == "high", 0).when(f["severity"] == "medium", 1).otherwise(2)
    placed = F.transform(findings, lambda f, i: F.struct(rank(f).alias("r"), *[f[k].alias(f"k_{k}") for k in keys], i.alias("i"), f.alias("f")))
    return F.transform(F.array_sort(placed), lambda x: x["f"])


def xmp_summary() -> Column:
    """The usual XMP properties as one struct."""
    one = {
        "title": "dc:title", "description": "dc:description", "creator_tool": "xmp:CreatorTool", "create_date": "xmp:CreateDate", "modify_date": "xmp:ModifyDate",
        "metadata_date": "xmp:MetadataDate",
    }
    return F.struct(xmp_list("dc:creator").alias("creator"), *[xmp_text(q).alias(n) for n, q in one.items()], xmp_rating().alias("rating"))


def iptc_summary() -> Column:
    """The usual IPTC datasets as one struct: lists where they repeat, else the first."""
    first = {
        "title": "ObjectName", "headline": "Headline", "caption": "CaptionAbstract", "copyright": "CopyrightNotice", "sublocation": "Sublocation", "city": "City",
        "province": "ProvinceState", "country_code": "CountryCode", "country": "CountryName",
    }
    creators = iptc_values("Byline")
    return F.struct(
        creators.alias("creators"), F.try_element_at(creators, F.lit(1)).alias("creator"), iptc_values("Keywords").alias("keywords"),
        *[F.try_element_at(iptc_values(d), F.lit(1)).alias(n) for n, d in first.items()],
    )
