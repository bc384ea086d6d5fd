"""Blobs forged from table rows, so that tables without images can exercise the parsers.

What a row's blob holds follows from its keys by simple rules, which the queries' SQL twins
restate; see ``queries``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.plans.ship import ship
from lumenlake.sources.files import Made


def spread(df: DataFrame) -> DataFrame:
    """Narrow rows over all cores before a kernel runs on them; large inputs come in enough splits already. A stream's batch may be one file, so it is always dealt."""
    want = 2 * df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming:
        return df.repartition(want)
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def forged(df: DataFrame, keys: list[str], make: Callable[[dict], bytes], extra: list[str] | None = None) -> DataFrame:
    """``keys``, path, length and content made of each row."""
    ship(df.sparkSession)
    used = keys + [c for c in extra or [] if c not in keys]
    out = df.select(*keys).schema.add("path", "string").add("length", "long").add("content", "binary")
    names = out.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = part.to_pylist()
                made = [make(r) for r in rows]
                data = [m if isinstance(m, bytes) else m[1] for m in made]
                paths = [f"file:/photos/{r[keys[0]]}.jpg" if isinstance(m, bytes) else m[0] for r, m in zip(rows, made)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], pa.array(paths), pa.array([len(d) for d in data], pa.int64()), pa.array(data, pa.binary())], names)

    return spread(df.select(*used)).mapInArrow(run, out)


def order_photo(row: dict) -> bytes:
    """A JPEG with what the order's keys ask for; every 101st is cut off inside its EXIF segment."""
    data = _order_photo(row)
    return data[:40] if row["o"] % 101 == 0 else data


@lru_cache(1 << 16)
def _stamp(d: date, days: int = 0) -> bytes:
    return (d + timedelta(days=days)).strftime("%Y:%m:%d %H:%M:%S").encode()


@lru_cache(1 << 16)
def _order_shape(big_endian: bool, make: bool, model: bool, software: bool, original: bool, serial: int, gps: int):
    """What makes the EXIF segment of orders whose photos have the same fields; ``serial``: digits of a number, ``gps``: number of tags, or 0."""
    from lumenlake.kernels import forge as f

    ifd0 = [(0x010F, 2, 6)] * make + [(0x0110, 2, 3)] * model + [(0x0112, 3, 1)] + [(0x0131, 2, 6)] * software + [(0x0132, 2, 20)]
    sub = [(0x829A, 5, 1), (0x829D, 5, 1), (0x8827, 3, 1)] + [(0x9003, 2, 20)] * original + [(0x9204, 10, 1), (0x920A, 5, 1), (0xA002, 4, 1), (0xA003, 4, 1)]
    sub += [(0xA431, 2, serial + 3)] if serial else []
    place = [(1, 2, 2), (2, 5, 3), (3, 2, 2), (4, 5, 3), (5, 1, 1), (6, 5, 1), (0x1D, 2, 11)][:gps]
    return f.exif_of(big_endian, tuple(ifd0), tuple(sub), tuple(place) if gps else None)


def _order_exif(o: int, c: int, d: date, width: int, height: int) -> bytes:
    make, model, software, original, serial = o % 17 > 0, o % 5 > 0, o % 11 == 0, o % 13 > 0, b"%d" % c if o % 8 == 0 else b""
    gps = 0 if o % 4 else 7 if o % 16 else 6
    values = [b"Make%d" % (c % 3)] if make else []
    if model:
        values.append(b"M%d" % (c % 7))
    values.append(1 + o % 8)
    if software:
        values.append(b"Adobe")
    values += (_stamp(d, o % 3 - 1), 1, 1 + o % 500, 10 + o % 200, 10, 100 * (1 + c % 8))
    if original:
        values.append(_stamp(d))
    values += (-(o % 7), 3, 1 + c % 100, 1, width + (o % 19 == 0), height)
    if serial:
        values.append(b"SN" + serial)
    if gps:
        values += (b"N" if o % 8 == 0 else b"S", c % 90, 1, o % 60, 1, c % 60, 1, b"E" if c % 2 == 0 else b"W", c % 180, 1, o % 60, 1, o % 60, 1, o % 12 // 4, c % 3000, 1)
        if gps == 7:
            values.append(_stamp(d)[:10])
    return _order_shape(o % 2 == 1, make, model, software, original, len(serial), gps)(values)


@cache
def _order_packet(tool: int, rating: int) -> bytes:
    from lumenlake.kernels import forge as f

    return f.xmp({"xmp:CreatorTool": f"Tool {tool}", "xmp:Rating": str(rating)})


@cache
def _order_datasets(city: int) -> bytes:
    from lumenlake.kernels import forge as f

    return f.iptc([(1, 90, b"\x1b%G"), (2, 25, "Öl".encode()), (2, 25, b"key"), (2, 90, f"City{city}".encode())])


@cache
def _order_profile(number: int, localized: bool) -> list[bytes]:
    from lumenlake.kernels import forge as f

    return f.icc(f.icc_profile(f"Profile {number}", localized=localized), 1 + localized)


def _order_photo(row: dict, exif: bool = True, q: int | None = None, scan: bytes | None = None, wider: int = 0) -> bytes:
    from lumenlake.kernels import forge as f

    o, c, d = row["o"], row["c"], row["d"]
    width, height = 16 + c % 4000 + wider, 16 + o % 3000
    parts = [_order_exif(o, c, d, width, height)] if exif else []
    if o % 12 == 0:
        parts.append(f.xmp({"xmp:CreatorTool": f"Tool {c % 4}", "xmp:Rating": str(c % 6)}, {"dc:creator": [f"Creator & {c}", "Second"]}))
    elif o % 6 == 0:
        parts.append(_order_packet(c % 4, c % 6))
    if o % 14 == 0:
        parts.append(f.iptc([(1, 90, b"\x1b%G"), (2, 25, "Öl".encode()), (2, 25, b"key"), (2, 90, f"City{c % 50}".encode()), (2, 80, f"By{c}".encode())]))
    elif o % 7 == 0:
        parts.append(_order_datasets(c % 50))
    if o % 9 == 0:
        parts += _order_profile(c % 10, o % 2 == 1)
    if o % 10 == 0:
        parts.append(b"\xff\xfe\x00\x0ba comment")
    scan = b"%d" % (c % 97) if scan is None else scan
    return f.jpeg(parts, width, height, scan, 1 + o % 50 if q is None else q, 0xC2 if o % 23 == 0 else 0xC0, b"tail" if o % 29 == 0 else b"")


def long_photo(row: dict) -> bytes:
    """An order's photo with a scan of 16 to 20 thousand bytes, no 255 among them."""
    o = row["o"]
    data = _order_photo(row, scan=bytes((o + k) % 251 for k in range(64)) * (256 + o % 64))
    return data[:40] if o % 101 == 0 else data


def packet_of_rating() -> bytes:
    """The payload of a packet with one property."""
    from lumenlake.kernels import forge as f

    return f.xmp({"xmp:Rating": "1"})[4:]


def blocks_photo(row: dict) -> bytes:
    """No to three EXIF blocks that differ in model and GPS tags, up to two packets, comments, and at times a frame header before the true one."""
    import struct

    from lumenlake.kernels import forge as f

    o, c = row["o"], row["c"]
    parts = [f.segment(0xFE, bytes(c % 50))]
    for j in range(o % 4):
        model = [(0x0110, 2, f" M{(o + j) % 7} ")] if (o + j) % 3 else []
        parts.append(f.exif([(0x010F, 2, "Make"), *model], None, [(1, 2, "N")] if (c + j) % 2 else None))
    parts += [f.xmp({"xmp:Rating": "1"})] * (o % 3)
    if o % 23 == 0:
        parts.append(f.segment(0xC1, struct.pack(">BHHB", 8, 7, 9, 1) + b"\x01\x11\x00"))
    return f.jpeg(parts, 16 + c % 4000, 16 + o % 3000, b"scan", 1 + o % 50)


def order_copy(row: dict) -> bytes:
    """A copy of an order's photo: whole, without EXIF, with another table, another scan, or wider with another table."""
    k = row["o"] % 5
    if k == 0:
        return _order_photo(row)
    return (
        _order_photo(row, exif=False) if k == 1 else _order_photo(row, q=60) if k == 2
        else _order_photo(row, scan=b"other") if k == 3 else _order_photo(row, q=60, scan=b"other", wider=1)
    )


def order_original(row: dict) -> bytes:
    return _order_photo(row)


def part_file(row: dict) -> tuple[str, bytes]:
    """Name and bytes of a file of one of eight kinds."""
    import struct
    import zlib

    from lumenlake.kernels import forge as f

    p, size = row["p"], row["size"]
    kind = p % 8
    width, height = 1 + p % 5000, 1 + size
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    tiff = f.tiff([(0x0100, 4, width), (0x0101, 4, height), (0x0106, 3, 2), (0x0115, 3, 3)], big_endian=p % 16 >= 8)
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
    png += (chunk(b"iTXt", b"XML:com.adobe.xmp\0\0\0\0\0<x/>") if size % 2 else b"") + (chunk(b"eXIf", tiff) if size % 3 == 0 else b"") + chunk(b"IEND", b"")
    vp8x = bytes((0x10 if size % 2 else 0, 0, 0, 0)) + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little")
    riff = b"WEBP" + b"VP8X" + struct.pack("<I", 10) + vp8x + b"".join(b"ANMF" + struct.pack("<I", 2) + b"\0\0" for _ in range(size % 4))
    made = [
        ("jpg", f.jpeg([], 8, 8)), ("png", png), ("webp", b"RIFF" + struct.pack("<I", len(riff)) + riff), ("tif", tiff),
        ("heic", f.ftyp(b"heic", [b"mif1", b"heic"])), ("avif", f.ftyp(b"avif", [b"mif1"])), ("nef", tiff), ("txt", b"plain text"),
    ][kind]
    return f"file:/files/{p}.{made[0]}", made[1]


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return table.select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("c"), F.col("o_orderdate").alias("d"))


def photo_files(spark: SparkSession, sf_dir: str, make=order_photo) -> DataFrame:
    """o, path, length, content of a photo per order."""
    return forged(orders(spark, sf_dir), ["o"], make, ["c", "d"])


def order_photos(make=order_photo) -> Made:
    """The same photos, made by the task that reads them."""
    return Made(("o", "c", "d"), make)


def mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p, size, path, length, content of a file per part."""
    table = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("p"), F.col("p_size").cast("long").alias("size"))
    return forged(table, ["p", "size"], part_file)
