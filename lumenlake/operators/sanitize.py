"""Sanitised copies of JPEGs, with proof that the image is untouched."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.text import clean_name
from lumenlake.kernels.jpeg import Transform
from lumenlake.kernels.limits import DEFAULT, Limits
from lumenlake.operators import privacy
from lumenlake.sources.files import scrubbed
from lumenlake.sources.sink import write_blobs

MODES = ("all", "gps", "privacy")


def scrub(files: DataFrame, mode: str, keys: list[str], content: str = "content", limits: Limits = DEFAULT) -> DataFrame:
    """``keys``, clean blob, change log, counts and verification of each JPEG.

    ``verified``: a second pass finds nothing, scan bytes are the same and no change log failed.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    return _judged(scrubbed(files, keys, mode, content, limits), keys)


def _judged(done: DataFrame, keys: list[str], *more: str) -> DataFrame:
    same = F.col("scan_before") == F.col("scan_after")
    return done.select(
        *keys, "clean", "changes", "error",
        F.size(F.filter("changes", lambda c: c["removed"])).alias("removed_segments"),
        F.size(F.filter("changes", lambda c: ~c["removed"])).alias("modified_segments"),
        F.aggregate("changes", F.lit(0).cast("bigint"), lambda a, c: a + c["old_bytes"] - c["new_bytes"]).alias("removed_bytes"),
        same.alias("same_scans"), "idempotent", (F.col("error").isNull() & F.col("idempotent") & same).alias("verified"), *more,
    )


def metrics(rows: DataFrame, side: str) -> DataFrame:
    """``rows`` with findings, GPS presence and size of the facts in struct ``side``, in its place."""
    names = [c for c in rows.columns if c != side]
    judged = privacy.assess(rows.select(*names, *[F.col(f"{side}.{c}").alias(c) for c in privacy.NEEDS], side))
    size = F.struct(F.col(f"{side}.width").alias("width"), F.col(f"{side}.height").alias("height"))
    return judged.select(
        *names, F.when(F.col(side).isNotNull(), F.size("findings")).alias(f"{side}_findings"), F.col(f"{side}.presence.gps").alias(f"{side}_gps"),
        F.when(F.col(side).isNotNull(), size).alias(f"{side}_size"),
    )


#: Facts of a blob that a report compares.
FACTS = (*privacy.NEEDS, "width", "height", "presence")


def report(files: DataFrame, mode: str, keys: list[str], limits: Limits = DEFAULT) -> DataFrame:
    """``scrub`` with findings, GPS presence and dimensions before and after, all from one read of each file."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    done = _judged(scrubbed(files, keys, mode, limits=limits, facts=FACTS), keys, "before", "after").drop("clean")
    both = metrics(metrics(done, "before"), "after")
    good = F.col("verified") & (F.col("before_size") == F.col("after_size")) & (F.coalesce("after_gps", F.lit("NO")) != "YES")
    return both.withColumn("verified", F.coalesce(good, F.lit(False))).withColumn("mode", F.lit(mode))


def rewrite(files: DataFrame, rule: Transform, keys: list[str], strip_trailing: bool = False, limits: Limits = DEFAULT) -> DataFrame:
    """``scrub`` by a rule of the caller's: of each APPn and COM segment, given marker and payload, a new payload (null: drop it) and a reason."""
    return _judged(scrubbed(files, keys, rule, limits=limits, strip_trailing=strip_trailing), keys)


def write_files(cleaned: DataFrame, path_col: str = "path", clean_col: str = "clean", existing: str = "same") -> DataFrame:
    """Write each clean blob beside its original under its default name, all or none; (source, target) of each.

    ``existing`` is the sink's: by default a target is refused unless it already holds the same bytes, so a repeated write is harmless.
    """
    some = cleaned.where(F.col(clean_col).isNotNull())
    names = some.select(F.col(path_col).alias("source"), clean_name(F.col(path_col)).alias("target"), F.col(clean_col).alias("clean"))
    ends = names.agg(F.min("target"), F.max("target")).first()  # what the first and the last have in common, all have
    if ends[0] is not None:
        root = os.path.commonprefix(list(ends)).rsplit("/", 1)[0]
        write_blobs(names.select(F.substr("target", F.lit(len(root) + 2)).alias("name"), "clean"), root, existing)
    return names.select("source", "target")
