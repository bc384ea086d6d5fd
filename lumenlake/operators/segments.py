"""Segments as rows: windows over those of a file, profiles put together of their chunks, fingerprints of tables.

``files.segment_rows`` gives the rows. Windows and groups are by file, so they shuffle narrow rows, and of payloads only those of
chunks and tables that a group needs; a file's budgets bound its group.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lumenlake.kernels.icc import CLASSES, SPACES
from lumenlake.kernels.jpeg import ICC_ID, SOF
from lumenlake.kernels.limits import DEFAULT, Limits
from lumenlake.kernels.photo import PROCESSES
from lumenlake.plans.ship import ship

#: Markers of quantisation and Huffman tables, and of segments that hold profile chunks.
DQT, DHT, APP2 = 0xDB, 0xC4, 0xE2


def _of(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("seq")


def byte(b: Column, at: int) -> Column:
    """A byte as a number, ``at`` from 1."""
    return F.conv(F.hex(F.substring(b, at, 1)), 16, 10).cast("int")


def big_endian(b: Column, at: int | Column, size: int) -> Column:
    """An unsigned number of ``size`` bytes, ``at`` from 1."""
    part = F.substring(b, at, size) if isinstance(at, int) else F.substr(b, at, F.lit(size))
    return F.conv(F.hex(part), 16, 10).cast("long")


def in_order(segments: DataFrame, keys: list[str]) -> DataFrame:
    """``segments`` with what has come before in the file: ``payload_sum``, ``exif_before`` (blocks so far), and the last block's ``gps_now`` and ``model_now``."""
    w = _of(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return segments.withColumns({
        "payload_sum": F.sum("payload_length").over(w), "exif_before": F.count_if(F.col("is_exif")).over(w),
        "gps_now": F.last("gps", ignorenulls=True).over(w), "model_now": F.last("camera_model", ignorenulls=True).over(w),
    })


def file_facts(segments: DataFrame, keys: list[str], limits: Limits = DEFAULT) -> DataFrame:
    """One row a file: counts, the first frame, the first packet, the last EXIF block's word, and the first segment beyond the payload budget.

    ``limits`` bounds the sum of payloads up to the first scan.
    """
    w = _of(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    frame = F.first(F.when(F.col("marker").isin(*sorted(SOF)), F.struct("marker", "head", "payload_length")), ignorenulls=True).over(w)
    rows = in_order(segments, keys).withColumns({
        "frame": frame, "first_xmp": F.first(F.when(F.col("is_xmp"), F.col("seq")), ignorenulls=True).over(w),
        "segment_count": F.count("seq").over(w), "exif_segments": F.count_if(F.col("is_exif")).over(w), "payload_bytes": F.sum("payload_length").over(w),
        "gps": F.last("gps", ignorenulls=True).over(w), "camera_model": F.last("camera_model", ignorenulls=True).over(w),
        "over_budget": F.min(F.when((F.col("payload_sum") > limits.max_jpeg_header_payload_bytes) & ~F.col("late"), F.col("seq"))).over(w),
        "problems": F.collect_list("problem").over(w), "nth": F.row_number().over(_of(keys)),
    })
    code = F.col("frame.marker")
    known = reduce(lambda out, kv: F.when(code == kv[0], kv[1]).otherwise(out), PROCESSES.items(), F.when(code.isNotNull(), F.concat(F.lit("SOF 0x"), F.hex(code))).otherwise("UNKNOWN"))
    whole = F.col("frame.payload_length") >= 5
    return rows.where("nth = 1").select(
        *keys, "error", "segment_count", "payload_bytes", "over_budget", "exif_segments", F.coalesce("gps", F.lit("NO")).alias("gps"), "camera_model", "first_xmp",
        known.alias("jpeg_process"), F.when(whole, big_endian(F.col("frame.head"), 4, 2)).alias("width"), F.when(whole, big_endian(F.col("frame.head"), 2, 2)).alias("height"), "problems",
    )


def profiles(segments: DataFrame, keys: list[str], limits: Limits = DEFAULT) -> DataFrame:
    """(keys, profile, problem) of each file with chunks of a colour profile before its first scan: put together by number, or what is wrong.

    ``segments`` needs the payloads of ``APP2``. All of a file's chunks must be numbered from 1, agree on how many there are, and be there once.
    """
    data = F.col("payload")
    chunks = segments.where("is_icc and not late").select(
        *keys, (F.length(data) >= len(ICC_ID) + 2).alias("whole"), byte(data, len(ICC_ID) + 1).alias("no"), byte(data, len(ICC_ID) + 2).alias("of"),
        F.expr(f"substring(payload, {len(ICC_ID) + 3})").alias("data"),
    )
    sound = F.coalesce((F.col("no") > 0) & (F.col("of") > 0) & (F.col("no") <= F.col("of")), F.lit(False))
    each = chunks.groupBy(*keys).agg(
        F.count("*").alias("n"), F.bool_and("whole").alias("whole"), F.bool_and(sound).alias("sound"), F.min("of").alias("least"), F.max("of").alias("most"),
        F.collect_set("no").alias("numbers"), F.expr("listagg(data) within group (order by no)").alias("profile"),
    )
    wanted = F.sequence(F.lit(1), F.col("most"))
    same = (F.size(F.array_except("numbers", wanted)) == 0) & (F.size(F.array_except(wanted, F.col("numbers"))) == 0)
    problem = (
        F.when(F.col("n") > limits.max_icc_chunks, "too many ICC chunks").when(~F.col("whole"), "ICC chunk is short").when(~F.col("sound"), "ICC chunk numbering is invalid")
        .when(F.col("least") != F.col("most"), "ICC chunks disagree on their number").when(F.size("numbers") != F.col("n"), "duplicate ICC chunk")
        .when(~same, "ICC chunks are missing").when(F.length("profile") > limits.max_icc_profile_bytes, "ICC profile exceeds the limit")
    )
    return each.select(*keys, F.when(problem.isNull(), F.col("profile")).alias("profile"), problem.alias("problem"))


def profile_header(found: DataFrame, keys: list[str], limits: Limits = DEFAULT) -> DataFrame:
    """Header and tag table of each profile that ``profiles`` put together; a broken one is a row with its ``problem``."""
    p = F.col("profile")
    size, tags = big_endian(p, 1, 4), F.when(big_endian(p, 1, 4) >= 132, big_endian(p, 129, 4)).otherwise(0)
    text = lambda at: F.decode(F.substring(p, at, 4), "ISO-8859-1")
    named = lambda table, at: reduce(lambda out, kv: F.when(text(at) == kv[0], kv[1]).otherwise(out), table.items(), F.concat(F.lit("Unknown ("), text(at), F.lit(")")))
    rows = found.select(*keys, "profile", "problem", size.alias("size"), tags.alias("count"))
    entry = lambda k: F.struct(F.decode(F.substr(p, 133 + 12 * k, F.lit(4)), "ISO-8859-1").alias("signature"), big_endian(p, 137 + 12 * k, 4).alias("offset"), big_endian(p, 141 + 12 * k, 4).alias("size"))
    fits = (F.col("count") <= limits.max_icc_tags) & (132 + 12 * F.col("count") <= F.col("size"))
    rows = rows.withColumn("tags", F.when((F.col("count") > 0) & fits, F.transform(F.sequence(F.lit(0), (F.col("count") - 1).cast("int")), entry)).otherwise(F.array().cast("array<struct<signature:string,offset:bigint,size:bigint>>")))
    problem = F.coalesce(
        "problem", F.when(F.length(p) < 128, "ICC profile is short").when(~F.col("size").between(128, F.length(p)), "ICC profile's declared size is invalid")
        .when(text(37) != "acsp", "ICC signature is missing").when((F.col("size") >= 132) & (F.col("count") > limits.max_icc_tags), "too many ICC tags")
        .when((F.col("size") >= 132) & ~fits, "ICC tag table exceeds the profile").when(F.exists("tags", lambda t: t["offset"] + t["size"] > F.col("size")), "ICC tag lies outside the profile"),
    )
    version = F.concat_ws(".", byte(p, 9), F.shiftright(byte(p, 10), 4), byte(p, 10).bitwiseAND(15))
    facts = {"cmm": text(5), "version": version, "profile_class": named(CLASSES, 13), "color_space": named(SPACES, 17), "pcs": named(SPACES, 21), "platform": text(41)}
    return rows.withColumn("problem", problem).select(*keys, "problem", *[F.when(F.col("problem").isNull(), c).alias(n) for n, c in ({"size": F.col("size")} | facts | {"tags": F.col("tags")}).items()])


def _ordered(seq: pa.Array, data: pa.Array) -> list[bytes]:
    pairs = [(s, d) for s, d in zip(seq.to_pylist(), data.to_pylist(), strict=True) if s is not None and d is not None]
    return [d for _, d in sorted(pairs, key=lambda x: x[0])]


@F.arrow_udf(StringType())
def fingerprint(seq: pa.Array, payload: pa.Array) -> str:
    """SHA-256 over the payloads of a group in order of ``seq``, each after its length in four bytes; null without any. Usable in SQL as ``jpeg_fingerprint``."""
    found = _ordered(seq, payload)
    return hashlib.sha256(b"".join(len(p).to_bytes(4, "big") + p for p in found)).hexdigest() if found else None


@F.arrow_udf(StringType())
def ordered_sha256(seq: pa.Array, data: pa.Array) -> str:
    """SHA-256 over the bytes of a group in order of ``seq``: of a file's scans, whose stretches are rows of the marker SCAN. In SQL ``ordered_sha256``."""
    whole = hashlib.sha256()
    for d in _ordered(seq, data):
        whole.update(d)
    return whole.hexdigest()


def fingerprint_of(payload: str, by: str = "seq") -> str:
    """SQL of what ``fingerprint`` gives, as an aggregate of Spark's own."""
    return f"sha2(listagg(concat(unhex(lpad(hex(length({payload})), 8, '0')), {payload})) WITHIN GROUP (ORDER BY {by}), 256)"


def sha256_of(data: str, by: str) -> str:
    """SQL of what ``ordered_sha256`` gives, as an aggregate of Spark's own."""
    return f"sha2(coalesce(listagg({data}) WITHIN GROUP (ORDER BY {by}), X''), 256)"


def register(spark: SparkSession) -> None:
    """The two aggregates as SQL functions."""
    ship(spark)
    spark.udf.register("jpeg_fingerprint", fingerprint)
    spark.udf.register("ordered_sha256", ordered_sha256)
