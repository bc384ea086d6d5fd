"""Kernels as SQL functions: scalar ones over Arrow batches, table ones per blob. What fails in a blob is told in its row, as in ``sources.files``."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, StructType, _parse_datatype_string
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lumenlake.kernels.limits import DEFAULT
from lumenlake.plans.ship import ship
from lumenlake.sources.files import MANY_BLOBS, MANY_BYTES, broken_photo
from lumenlake.sources.schema import ICC, IPTC, PHOTO, SEGMENT, SEGMENT_ROW, TAG, XMP

#: Child tables of a photo by name: the column that holds the rows, and their fields.
TABLES = {"segments": ("segments", SEGMENT), "tags": ("tags", TAG), "xmp": ("xmp", XMP), "iptc": ("iptc", IPTC), "icc": ("icc", ICC), "errors": ("errors", "struct<part:string,message:string>"), "all_segments": (None, SEGMENT_ROW)}


def parsed(data: bytes, wanted: frozenset[str] | None = None, only: frozenset[str] | None = None) -> dict:
    """Facts of a blob; never raises."""
    from lumenlake.kernels.photo import parse

    try:
        return parse(data, wanted=wanted, only=only)
    except Exception as e:  # noqa: BLE001
        return broken_photo(e)


def parsed_many(blobs: list[bytes], wanted: frozenset[str] | None = None, only: frozenset[str] | None = None) -> list[dict]:
    """``parsed`` of each blob; plain ones all at once. ``only``: the tags that get rows."""
    from lumenlake.kernels.many import COLUMNS, parse_many

    try:
        found = parse_many(blobs, COLUMNS if wanted is None else wanted, only=only) if sum(map(len, blobs)) <= MANY_BYTES else [None] * len(blobs)
    except Exception:  # noqa: BLE001
        found = [None] * len(blobs)
    return [parsed(data, wanted, only) if row is None else row for data, row in zip(blobs, found)]


@lru_cache(256)
def names_of(listed: str | None) -> frozenset[str] | None:
    """Names that a text lists with commas between them; all (None) where there is no text."""
    return None if listed is None else frozenset(x for x in map(str.strip, listed.split(",")) if x)


def _alike(asks: Iterable[tuple], blobs: list[bytes | None]) -> dict[tuple, list[int]]:
    """Places of the blobs that the same is asked of."""
    out: dict[tuple, list[int]] = {}
    for k, (ask, blob) in enumerate(zip(asks, blobs)):
        if blob is not None:
            out.setdefault(ask, []).append(k)
    return out


def shaped(value: object, kind: DataType) -> object:
    """Dictionaries as tuples by the fields of ``kind``."""
    if value is None:
        return None
    if isinstance(kind, StructType):
        return tuple(shaped(value.get(f.name), f.dataType) for f in kind.fields)
    return [shaped(x, kind.elementType) for x in value] if isinstance(kind, ArrayType) else value


def child_rows(data: bytes, name: str, only: frozenset[str] | None = None) -> list[dict]:
    """The rows of a child table of a blob, of its tags those named ``only``; none where it cannot be read."""
    column = TABLES[name][0]
    if column is None:
        from lumenlake.kernels.photo import segment_rows

        try:
            return segment_rows(data, DEFAULT, frozenset())["found"]
        except Exception:  # noqa: BLE001
            return []
    found = parsed(data, frozenset({column}) if column != "errors" else None, only).get(column)
    return [found] if isinstance(found, dict) else found or []


def jpeg_table(kinds: dict[str, StructType]) -> type:
    """``jpeg_table(content, name)``: the child table of a blob that ``name``, a constant, says; its columns are that table's."""

    class JpegTable:
        @staticmethod
        def analyze(content: AnalyzeArgument, name: AnalyzeArgument) -> AnalyzeResult:
            if content.dataType.typeName() != "binary":
                raise ValueError("jpeg_table takes binary content")
            if not name.isConstantExpression or name.value not in kinds:
                raise ValueError(f"jpeg_table takes the name of a table: {', '.join(kinds)}")
            return AnalyzeResult(kinds[name.value])

        def eval(self, content: bytes, name: str) -> Iterator[tuple]:
            for row in child_rows(bytes(content or b""), name):
                yield shaped(row, kinds[name])

    return JpegTable


def register(spark: SparkSession) -> None:
    """``parse_jpeg(content)``, ``scrub_jpeg(content, mode)`` and the table functions ``jpeg_tags(content)`` and ``jpeg_table(content, name)``.

    ``parse_jpeg(content, columns)`` parses those columns of the bronze table alone, others are null; ``parse_jpeg(content, columns, tags)`` and
    ``jpeg_tags(content, tags)`` give rows of those tags alone. Columns and tags are texts, names between commas: ``'width,tags'``, ``'IFD0/Model'``.
    """
    ship(spark)
    photo = StructType.fromDDL(PHOTO)
    kind = to_arrow_type(photo)

    def parse_jpeg(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        made: list[pa.Array] = []
        for given in batches:
            blobs, *asked = given if isinstance(given, (tuple, list)) else [given]
            for at in range(0, len(blobs), MANY_BLOBS):
                part = blobs.slice(at, MANY_BLOBS).to_pylist()
                asks = zip(*[x.slice(at, MANY_BLOBS).to_pylist() for x in asked]) if asked else [()] * len(part)
                rows: list[dict | None] = [None] * len(part)
                for ask, places in _alike(asks, part).items():
                    wanted, only = [names_of(x) for x in (*ask, None, None)[:2]]
                    for k, row in zip(places, parsed_many([part[k] for k in places], wanted, only)):
                        rows[k] = row if wanted is None else {n: v for n, v in row.items() if n in wanted}
                made.append(pa.array(rows, kind))
            yield pa.concat_arrays(made) if made else pa.array([], kind)
            made.clear()

    def scrub_jpeg(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        from lumenlake.kernels.scrub import scrub

        def one(data: bytes | None, mode: str | None) -> bytes | None:
            try:
                return None if data is None else scrub(data, mode or "all").data
            except Exception:  # noqa: BLE001
                return None

        for blobs, modes in batches:
            yield pa.array([one(b.as_py(), m.as_py()) for b, m in zip(blobs, modes)], pa.binary())

    spark.udf.register("parse_jpeg", F.arrow_udf(parse_jpeg, photo))
    spark.udf.register("scrub_jpeg", F.arrow_udf(scrub_jpeg, "binary"))
    kinds = {name: StructType.fromDDL(ddl.removeprefix("struct<").removesuffix(">")) for name, (_, ddl) in TABLES.items()}
    tag = kinds["tags"]

    @F.udtf(returnType=_parse_datatype_string(TAG))
    class JpegTags:
        def eval(self, content: bytes, tags: str | None = None):
            for row in child_rows(bytes(content or b""), "tags", names_of(tags)):
                yield shaped(row, tag)

    spark.udtf.register("jpeg_tags", JpegTags)
    spark.udtf.register("jpeg_table", F.udtf(jpeg_table(kinds)))
