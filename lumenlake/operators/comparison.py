"""Pairs of snapshots: what changed, and whether the image was encoded anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a snapshot compares.
KINDS = {"exif": "EXIF metadata", "gps": "GPS metadata", "xmp": "XMP metadata", "iptc": "IPTC metadata", "icc": "ICC profile"}
LIKELY, POSSIBLE, NONE = "LIKELY", "POSSIBLE", "NO EVIDENCE"
SNAPSHOT = (
    "size_bytes", "sha256", "width", "height", "jpeg_process", "exif", "gps", "xmp", "iptc", "icc", "camera_model", "quantization", "huffman", "scan_sha256", "trailing_bytes", "warnings", "error",
)

#: Columns of the bronze table that a snapshot takes. The codes and messages of changes, evidence and verdicts below.
NEEDS = ("width", "height", "jpeg_process", "quantization", "huffman", "scan_sha256", "trailing_bytes", "presence", "errors")
#: Those of them that tell whether an image was encoded anew.
CODING_NEEDS = tuple(c for c in NEEDS if c not in ("presence", "trailing_bytes"))


def _error(errors: Column) -> Column:
    return F.when(F.size(errors) > 0, F.try_element_at(F.filter(errors, lambda e: e["part"].isin("header", "dimensions", "structure")), F.lit(1))["message"])


def _facts(of: str) -> list[Column]:
    """Fields of a snapshot from columns, or from those of struct ``of.``; null where the file could not be read."""
    error = _error(F.col(f"{of}errors"))
    ok = error.isNull()
    facts = ["width", "height", "jpeg_process", "quantization", "huffman", "scan_sha256", "trailing_bytes"]
    shown = {c: F.when(ok, F.col(f"{of}{c}")) for c in facts} | {c: F.when(ok, F.col(f"{of}presence.{c}")) for c in (*KINDS, "camera_model", "warnings")} | {"error": error}
    return [shown.get(c, F.col(f"{of}{c}")).alias(c) for c in SNAPSHOT]


def snapshots(photos: DataFrame, keys: list[str]) -> DataFrame:
    """One row of comparable facts per file; ``photos`` carries size_bytes and sha256. Fields are null where the file could not be read."""
    return photos.select(*keys, *_facts(""))


def _change(when: Column, code: str, message: str) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(message).alias("message")))


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def changes(o: str, c: str) -> Column:
    """Changes from snapshot struct ``o`` to ``c``, in a fixed order. UNKNOWN presence never counts."""
    a, b = (lambda f: F.col(f"{o}.{f}")), (lambda f: F.col(f"{c}.{f}"))
    differ = lambda f: ~a(f).eqNullSafe(b(f))
    known = lambda f: F.coalesce(a(f) != b(f), F.lit(False))
    out = []
    for code, label in KINDS.items():
        out.append(_change((a(code) == "YES") & (b(code) == "NO"), f"{code}_removed", f"{label} removed"))
        out.append(_change((a(code) == "NO") & (b(code) == "YES"), f"{code}_added", f"{label} added"))
    model_a, model_b = _blank(a("camera_model")), _blank(b("camera_model"))
    out += [
        _change(~model_a & model_b, "camera_model_removed", "Camera model metadata removed"),
        _change(model_a & ~model_b, "camera_model_added", "Camera model metadata added"),
        _change(~model_a & ~model_b & (a("camera_model") != b("camera_model")), "camera_model_changed", "Camera model metadata changed"),
        _change(differ("width") | differ("height"), "resolution_changed", "Resolution changed"),
        _change(differ("jpeg_process"), "jpeg_process_changed", "JPEG coding process changed"),
        _change(known("quantization"), "quantization_changed", "JPEG quantization tables changed"),
        _change(known("huffman"), "huffman_changed", "JPEG Huffman tables changed"),
        _change(differ("scan_sha256"), "compressed_data_changed", "Compressed JPEG image data changed"),
    ]
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def _coding(o: str, c: str) -> tuple[Column, ...]:
    """Whether scans, sizes, quantisation tables, Huffman tables and processes differ."""
    a, b = (lambda f: F.col(f"{o}.{f}")), (lambda f: F.col(f"{c}.{f}"))
    differ = lambda f: ~a(f).eqNullSafe(b(f))
    known = lambda f: F.coalesce(a(f) != b(f), F.lit(False))
    return differ("scan_sha256"), differ("width") | differ("height"), known("quantization"), known("huffman"), differ("jpeg_process")


def levels(pairs: DataFrame) -> DataFrame:
    """``pairs`` with the level that ``recompression`` gives each; ``original`` and ``copy`` hold sha256 and ``CODING_NEEDS``. Null where a file could not be read."""
    scan, size, dqt, dht, process = _coding("original", "copy")
    ok = _error(F.col("original.errors")).isNull() & _error(F.col("copy.errors")).isNull()
    coded = F.when(scan & (size | dqt | process), LIKELY).when(scan | dqt | dht | process, POSSIBLE).otherwise(NONE)
    return pairs.withColumn("level", F.when(ok, F.when(F.col("original.sha256") == F.col("copy.sha256"), NONE).otherwise(coded)))


def recompression(o: str, c: str) -> Column:
    """struct<level,message,evidence>."""
    same = F.col(f"{o}.sha256") == F.col(f"{c}.sha256")
    scan, size, dqt, dht, process = _coding(o, c)
    texts = ((scan, "compressed JPEG image data differs"), (size, "resolution differs"), (dqt, "quantization tables differ"), (dht, "Huffman tables differ"), (process, "JPEG coding process differs"))
    evidence = F.filter(F.array(*[F.when(w, t) for w, t in texts]), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    said = lambda level, message, proof: F.struct(F.lit(level).alias("level"), F.lit(message).alias("message"), proof.alias("evidence"))
    return (
        F.when(same, said(NONE, "Files are byte-for-byte identical.", none))
        .when(scan & (size | dqt | process), said(LIKELY, "JPEG appears to have been recompressed or re-encoded (heuristic).", evidence))
        .when(scan | dqt | dht | process, said(POSSIBLE, "JPEG coding data changed; recompression or pixel modification is possible (heuristic).", evidence))
        .otherwise(said(NONE, "No JPEG re-encoding evidence detected by the supported heuristics.", none))
    )


def compare(original: DataFrame, copy: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of snapshots with equal ``on``: original, copy (structs), identical_files, changes, recompression.

    Snapshots are narrow rows without blobs, so the join moves little; Spark broadcasts a side
    only below its own size threshold and splits skewed keys.
    """
    pack = lambda df, name: df.select(*[F.col(k) for k in on], F.struct(*SNAPSHOT).alias(name))
    return compared(pack(original, "original").join(pack(copy, "copy"), on), on)


def side_by_side(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``compare`` of photos that come two in a row, as structs original and copy of size_bytes, sha256 and ``NEEDS``: nothing is joined."""
    return compared(pairs.select(*keys, *[F.struct(*_facts(f"{s}.")).alias(s) for s in ("original", "copy")]), keys)


def compared(pairs: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of snapshots, which are structs original and copy, with what differs."""
    ok = F.col("original.error").isNull() & F.col("copy.error").isNull()
    return pairs.select(
        *on, "original", "copy", (F.col("original.sha256") == F.col("copy.sha256")).alias("identical_files"),
        F.when(ok, changes("original", "copy")).alias("changes"), F.when(ok, recompression("original", "copy")).alias("recompression"),
    )


def same_scans(snapshot: DataFrame, key: str) -> DataFrame:
    """Groups of files with the same compressed image: scan_sha256, first and number of files; one row per group, not per pair."""
    return snapshot.where("scan_sha256 is not null").groupBy("scan_sha256").agg(F.min(key).alias("first"), F.count("*").alias("files")).where("files > 1")
