"""Files as tables of blobs, and blobs as tables of facts.

Blobs stay in the scan stage: a kernel reads them in small Arrow batches and hands on rows
without content, so no shuffle ever carries an image. Kernels never raise; what fails is
a null and a message in the row.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lumenlake.functions.places import with_captures, with_places
from lumenlake.kernels.containers import AVIF_BRANDS, GENERIC_BRANDS, HEIC_BRANDS, RAW_EXTENSIONS
from lumenlake.kernels.jpeg import Transform
from lumenlake.kernels.limits import DEFAULT, Limits
from lumenlake.plans.ship import ship
from lumenlake.sources.schema import CONTAINER, PHOTO, SCRUB, SEGMENT_ROW

#: Blobs in a batch handed to Python; with 1 GiB files the batch limit in bytes takes over.
BLOBS_PER_BATCH = 64
#: Small blobs that a kernel over many takes at a time, and their bytes.
MANY_BLOBS, MANY_BYTES = 1024, 4 << 20
#: First bytes of a file that tell its format; a file-type box of HEIF is no longer.
HEAD = 4096
#: Columns of the bronze table that are expressions over its tags.
SUMMARIES = {"location": with_places, "capture": with_captures}
#: Excluded paths that are broadcast; more are joined by Spark's own choice.
MOST_BROADCAST = 10_000


def scan_directory(spark: SparkSession, path: str, recursive: bool = False, exclude: list[str] | None = None, glob: str | None = None) -> DataFrame:
    """path, modificationTime, length, content of all files; ``exclude`` holds paths to leave out, of a folder with all that is in it."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    if exclude:
        out = spark.createDataFrame([(p,) for p in exclude], "x string")
        out = F.broadcast(out) if len(exclude) <= MOST_BROADCAST else out
        bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
        files = files.join(out, bare(F.col("path")) == bare(F.col("x")), "left_anti")
        if recursive:  # what is in a folder that is left out
            parts = F.split(bare(F.col("path")), "/")
            above = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
            names = reader.load(path).select("path").withColumn("up", F.explode(above))  # content is not read for these
            files = files.join(names.join(out, F.col("up") == F.rtrim(bare(F.col("x")), F.lit("/")), "left_semi").select("path").distinct(), "path", "left_anti")
    return files


def heads(files: DataFrame, size: int = HEAD) -> DataFrame:
    """path, length and, as ``content``, the first ``size`` bytes of each of ``files`` (path, length), by range reads: all that ``detect`` looks at, whatever a file's length."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lumenlake.sources.stores import open_store

        for batch in batches:
            for at in range(0, batch.num_rows, BLOBS_PER_BATCH):
                part, found = batch.slice(at, BLOBS_PER_BATCH), []
                for path in part.column(0).to_pylist():
                    store, inner, _ = open_store(path)
                    with store.open_input_file(inner) as file:
                        found.append(file.read(size))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], ["path", "length", "content"])

    return files.select("path", "length").mapInArrow(run, "path string, length bigint, content binary")


def ordered(files: DataFrame) -> DataFrame:
    """By path, case folded; for output only."""
    return files.orderBy(F.lower("path"), "path")


def detect(content: Column, path: Column, raw_backend: bool = False) -> Column:
    """Format by magic bytes; raw files by extension before TIFF. Without a raw reader they are UNSUPPORTED; with one, ``batch.items`` still has it open them."""
    starts = lambda raw: F.startswith(content, F.lit(raw))
    part = lambda at, n: F.substring(content, at, n)
    extension = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    return (
        F.when(starts(b"\xff\xd8"), "JPEG")
        .when(starts(b"\x89PNG\r\n\x1a\n"), "PNG")
        .when((part(1, 4) == F.lit(b"RIFF")) & (part(9, 4) == F.lit(b"WEBP")), "WEBP")
        .when(extension.isin(*RAW_EXTENSIONS), "RAW" if raw_backend else "UNSUPPORTED")
        .when(starts(b"II*\0") | starts(b"MM\0*"), "TIFF")
        .when(heif_format(content).isNotNull(), "HEIF")
        .otherwise("UNSUPPORTED")
    )


def strict_format(content: Column) -> Column:
    """struct<kind,format,mime> of a JPEG by its first bytes, whatever its name; null for anything else."""
    jpeg = F.struct(F.lit("Image").alias("kind"), F.lit("JPEG").alias("format"), F.lit("image/jpeg").alias("mime"))
    return F.when(F.startswith(content, F.lit(b"\xff\xd8")), jpeg)


def brands(content: Column) -> Column:
    """Major and compatible brands of the file-type box, as array<string>; null without a valid one."""
    size = F.conv(F.hex(F.substring(content, 1, 4)), 16, 10).cast("long")
    valid = (F.substring(content, 5, 4) == F.lit(b"ftyp")) & (size >= 16) & (size <= F.least(F.length(content), F.lit(4096)))
    text = lambda at: F.decode(F.substring(content, at, F.lit(4)), "ISO-8859-1")
    count = F.floor((size - 16) / 4).cast("int")
    more = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: text(17 + 4 * k))).otherwise(F.array().cast("array<string>"))
    return F.when(valid, F.concat(F.array(text(F.lit(9))), more))


def heif_format(content: Column) -> Column:
    found = brands(content)
    any_of = lambda names: F.arrays_overlap(found, F.array(*map(F.lit, names)))
    return F.when(any_of(AVIF_BRANDS), None).when(any_of(HEIC_BRANDS), "HEIC").when(any_of(GENERIC_BRANDS), "HEIF")


def failure(e: Exception) -> dict:
    """The row of a blob on which a kernel broke down: one hostile file must not end a job."""
    return {"error": f"{type(e).__name__}: {e}"}


@dataclass(frozen=True)
class Made:
    """Blobs made of ``columns`` of each row by the task that reads them, so that they never leave it."""

    columns: tuple[str, ...]
    make: Callable[[dict], bytes]


#: What a task tells of the blobs that it makes, as keys of their rows.
TOLD = "path string, size_bytes bigint, sha256 string"


def _told(name: str, stems: list, blobs: list[bytes]) -> pa.Array:
    if name == "path":
        return pa.array([f"file:/photos/{x}.jpg" for x in stems])
    return pa.array([len(x) for x in blobs], pa.int64()) if name == "size_bytes" else pa.array([sha256(x).hexdigest() for x in blobs])


@contextmanager
def _uncollected() -> Iterator[None]:
    """Rows of a slice hold no cycles, so looking for some while they are made only takes time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def _each(kernel: Callable[[bytes], dict], broken: Callable[[Exception], dict] = failure, skip_null: bool = False, many: Callable[[list[bytes]], list[dict | None]] | None = None) -> tuple[Callable, Callable]:
    """What makes a row of a blob, and rows of many small ones."""

    def row(data: bytes | None) -> dict:
        try:
            return {} if data is None and skip_null else kernel(data or b"")
        except Exception as e:  # noqa: BLE001
            return broken(e)

    def together(blobs: list[bytes | None]) -> list[dict | None]:
        try:
            return many([x or b"" for x in blobs])
        except Exception:  # noqa: BLE001
            return [None] * len(blobs)

    def rows(blobs: list[bytes | None]) -> list[dict]:
        return [row(x) if r is None else r for x, r in zip(blobs, together(blobs))]

    return row, rows


def over_blobs(
    df: DataFrame, keys: list[str], content: str | Made, schema: str, kernel: Callable[[bytes], dict], broken: Callable[[Exception], dict] = failure, skip_null: bool = False,
    many: Callable[[list[bytes]], list[dict | None]] | None = None,
) -> DataFrame:
    """``keys`` and the columns of ``schema``, which ``kernel`` makes of each blob, or ``broken`` where it raises.

    A null blob is empty, or with ``skip_null`` a row of nulls. ``many`` makes the same of many small blobs at a time, or None of one that it leaves to ``kernel``.
    Blobs of ``Made`` have keys of ``TOLD`` too, paths by the first of its columns.
    """
    ship(df.sparkSession)
    told = {f.name: f for f in StructType.fromDDL(TOLD).fields} if isinstance(content, Made) else {}
    out = StructType([told.get(k) or df.schema[k] for k in keys] + StructType.fromDDL(schema).fields)
    names = out.fieldNames()[len(keys) :]
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    row, rows_of = _each(kernel, broken, skip_null, many)

    def run_made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, MANY_BLOBS):
                part = batch.slice(at, MANY_BLOBS)
                with _uncollected():
                    blobs = [content.make(r) for r in part.to_pylist()]
                    small = many is not None and sum(map(len, blobs)) <= MANY_BYTES
                    stems = part.column(content.columns[0]).to_pylist() if "path" in keys else []
                    made = pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in (rows_of(blobs) if small else map(row, blobs))], schema=arrow)
                    made = pa.RecordBatch.from_arrays([*[_told(k, stems, blobs) if k in told else part.column(k) for k in keys], *made.columns], names=out.fieldNames())
                yield made

    if isinstance(content, Made):
        return df.select(*dict.fromkeys([*content.columns, *[k for k in keys if k not in told]])).mapInArrow(run_made, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small = many is not None and batch.nbytes <= MANY_BYTES // MANY_BLOBS * batch.num_rows
            step = MANY_BLOBS if small else BLOBS_PER_BATCH
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                with _uncollected():
                    rows = rows_of(part.column(len(keys)).to_pylist()) if small else [row(x.as_py()) for x in part.column(len(keys))]
                    made = pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema=arrow)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], *made.columns], names=out.fieldNames())

    return df.select(*keys, content).mapInArrow(run, out)


def broken_photo(e: Exception) -> dict:
    return {"errors": [{"part": "header", "message": failure(e)["error"]}], "segments": [], "tags": [], "xmp": [], "iptc": [], "has": [], "has_xmp": [], "structural": [], "exif_segments": 0}


def some_of(schema: str, columns: Iterable[str] | None) -> str:
    """Those of a schema's columns that are wanted, as DDL."""
    return schema if columns is None else ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in StructType.fromDDL(schema) if f.name in set(columns))


def photos(df: DataFrame, keys: list[str], content: str | Made = "content", limits: Limits = DEFAULT, columns: Iterable[str] | None = None, skip_null: bool = False, tags: Iterable[str] | None = None, values: bool = True) -> DataFrame:
    """Facts of each JPEG: the bronze table, or ``columns`` of it; only what these take is parsed, and ``errors`` tells of that.

    ``tags``: names with their groups (``GPS/GPSLatitude``) of those that ``columns`` and the caller read; others get no row. Without ``values`` rows tell of names only.

    Each set of rules names what it reads (``privacy.NEEDS`` and so on). A null blob is empty, or with ``skip_null`` a row of nulls.
    """
    wanted = None if columns is None else frozenset(columns)
    summed = [c for c in SUMMARIES if wanted is None or c in wanted]
    parsed = wanted if wanted is None or not summed else (wanted - SUMMARIES.keys()) | {"tags"}
    only = None if tags is None else frozenset(tags)
    all_of = frozenset(StructType.fromDDL(PHOTO).fieldNames()) if parsed is None else parsed

    def kernel(data: bytes) -> dict:
        from lumenlake.kernels.photo import parse

        return parse(data, limits, parsed, only, values)

    def many(blobs: list[bytes]) -> list[dict | None]:
        from lumenlake.kernels.many import parse_many

        return parse_many(blobs, all_of, limits, only, values)

    out = over_blobs(df, keys, content, some_of(PHOTO, parsed), kernel, broken_photo, skip_null, many)
    for c in summed:
        out = SUMMARIES[c](out)
    return out if not summed or wanted is None or "tags" in wanted else out.drop("tags")


def photo_sides(df: DataFrame, keys: list[str], sides: dict[str, Made], columns: Iterable[str], limits: Limits = DEFAULT) -> DataFrame:
    """``keys`` and for each of ``sides`` a struct of its photo's size_bytes, sha256 and ``columns`` of the bronze table: photos of one row stay together."""
    ship(df.sparkSession)
    wanted = frozenset(columns)
    facts = StructType.fromDDL(some_of(PHOTO, wanted))
    side = StructType(StructType.fromDDL(TOLD).fields[1:] + facts.fields)
    out = df.select(*keys).schema
    for name in sides:
        out = out.add(name, side)
    names, arrow = facts.fieldNames(), to_arrow_schema(side)

    def kernel(data: bytes) -> dict:
        from lumenlake.kernels.photo import parse

        return parse(data, limits, wanted)

    def many(blobs: list[bytes]) -> list[dict | None]:
        from lumenlake.kernels.many import parse_many

        return parse_many(blobs, wanted, limits)

    row, rows_of = _each(kernel, broken_photo, False, many)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, MANY_BLOBS):
                part = batch.slice(at, MANY_BLOBS)
                made = []
                with _uncollected():
                    given = part.to_pylist()
                    for x in sides.values():
                        blobs = [x.make(r) for r in given]
                        rows = rows_of(blobs) if sum(map(len, blobs)) <= MANY_BYTES else map(row, blobs)
                        found = pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema=pa.schema(list(arrow)[2:]))
                        made.append(pa.StructArray.from_arrays([_told("size_bytes", [], blobs), _told("sha256", [], blobs), *found.columns], fields=list(arrow)))
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], *made], names=out.fieldNames())

    return df.select(*dict.fromkeys([*keys, *[c for x in sides.values() for c in x.columns]])).mapInArrow(run, out)


def segment_rows(df: DataFrame, keys: list[str], content: str = "content", limits: Limits = DEFAULT, payload_of: Iterable[int] = (), markers: Iterable[int] | None = None) -> DataFrame:
    """``keys`` and a row for each segment of the whole file, in order by ``seq``; a file that has none is one row with its ``error``.

    Payloads stay behind but for the markers in ``payload_of``; ``head`` has the first 16 bytes. EXIF segments tell of GPS tags and model.
    With ``markers`` only their segments are rows.
    """
    whole, some = frozenset(payload_of), None if markers is None else frozenset(markers)

    def kernel(data: bytes) -> dict:
        from lumenlake.kernels.photo import segment_rows as rows

        return rows(data, limits, whole, some)

    found = over_blobs(df, keys, content, f"found array<{SEGMENT_ROW}>, error string", kernel)
    return found.select(*keys, "error", F.explode_outer("found").alias("x")).select(*keys, "error", "x.*")


def containers(df: DataFrame, keys: list[str], content: str = "content", limits: Limits = DEFAULT) -> DataFrame:
    """Facts of PNG, WebP and TIFF files."""

    def kernel(data: bytes) -> dict:
        from lumenlake.kernels.containers import inspect
        from lumenlake.kernels.limits import ParseError

        try:
            found = inspect(data, limits)
            return found | {"detected": found["format"], "error": None}
        except ParseError as e:
            return {"error": str(e)}

    return over_blobs(df, keys, content, CONTAINER, kernel)


def scrubbed(
    df: DataFrame, keys: list[str], mode: str | Transform, content: str = "content", limits: Limits = DEFAULT, facts: Iterable[str] = (), strip_trailing: bool = False
) -> DataFrame:
    """The sanitised blob of each JPEG, its change log and whether a second pass finds nothing and the scans are the same.

    ``mode`` is one of the modes of ``sanitize`` or a rule over segments, to which alone ``strip_trailing`` applies.

    With ``facts``, those columns of the bronze table too, as structs ``before`` and ``after``: one read of a file serves all.
    """
    wanted = frozenset(facts)
    known = StructType.fromDDL(some_of(PHOTO, wanted)).simpleString() if wanted else ""
    schema = SCRUB + (f", before {known}, after {known}" if wanted else "")

    def parsed(data: bytes) -> dict:
        from lumenlake.kernels.photo import parse

        try:
            return parse(data, limits, wanted)
        except Exception as e:  # noqa: BLE001
            return broken_photo(e)

    def kernel(data: bytes) -> dict:
        import struct

        from lumenlake.kernels.jpeg import full_walk
        from lumenlake.kernels.limits import ParseError
        from lumenlake.kernels.scrub import scrub

        before = {"before": parsed(data)} if wanted else {}
        try:
            clean = (lambda x: full_walk(x, mode, strip_trailing, limits)) if callable(mode) else lambda x: scrub(x, mode, limits)
            first = clean(data)
            again = clean(first.data)
            return before | ({"after": parsed(first.data)} if wanted else {}) | {
                "clean": first.data, "changes": first.changes, "scan_before": first.scan_sha256,
                "scan_after": again.scan_sha256, "idempotent": not again.changes, "error": None,
            }
        except (ParseError, struct.error) as e:
            return before | {"changes": [], "error": str(e)}

    return over_blobs(df, keys, content, schema, kernel, lambda e: failure(e) | {"changes": []})


def file_info(files: DataFrame) -> DataFrame:
    """Name, size and time of each file. Spark knows the modification time only."""
    from lumenlake.functions.text import file_size

    return files.select(
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size_bytes"), file_size(F.col("length")).alias("size_human"),
        F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("modified"),
    )


def stat_times(files: DataFrame) -> DataFrame:
    """Access, change and birth times of local files by ``os.stat``; null where the path is not local."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        for batch in batches:
            paths, rows = batch.column(0).to_pylist(), []
            for p in paths:
                try:
                    s = os.stat("/" + p.removeprefix("file:").lstrip("/"))
                    rows.append((s.st_atime, s.st_ctime, getattr(s, "st_birthtime", None)))
                except OSError:
                    rows.append((None, None, None))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], pa.float64()) for k in range(3)]], ["path", "accessed", "changed", "born"])

    return files.select("path").mapInArrow(run, "path string, accessed double, changed double, born double")
