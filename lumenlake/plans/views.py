"""The bronze table's children as tables: segments, tags, properties, datasets, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _child(photos: DataFrame, keys: list[str], column: str) -> DataFrame:
    return photos.select(*keys, F.explode(column).alias("x")).select(*keys, "x.*")


def segments(photos: DataFrame, keys: list[str]) -> DataFrame:
    return _child(photos, keys, "segments")


def tags(photos: DataFrame, keys: list[str]) -> DataFrame:
    return _child(photos, keys, "tags")


def xmp_props(photos: DataFrame, keys: list[str]) -> DataFrame:
    return _child(photos, keys, "xmp")


def iptc_datasets(photos: DataFrame, keys: list[str]) -> DataFrame:
    return _child(photos, keys, "iptc")


def icc_profiles(photos: DataFrame, keys: list[str]) -> DataFrame:
    return photos.where("icc is not null").select(*keys, "icc.*")


def locations(photos: DataFrame, keys: list[str]) -> DataFrame:
    return photos.select(*keys, "location.*")


def captures(photos: DataFrame, keys: list[str]) -> DataFrame:
    return photos.select(*keys, "capture.*")


VIEWS = {"segments": segments, "tags": tags, "xmp_props": xmp_props, "iptc_datasets": iptc_datasets, "icc_profiles": icc_profiles, "locations": locations, "captures": captures}


def register(photos: DataFrame, keys: list[str], prefix: str = "photo_") -> None:
    """Temporary views of all children, for SQL. Cache or write ``photos`` first if several are read."""
    photos.createOrReplaceTempView(f"{prefix}bronze")
    for name, make in VIEWS.items():
        make(photos, keys).createOrReplaceTempView(prefix + name)
