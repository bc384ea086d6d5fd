"""Documents from rows: JSON, CSV, HTML and text, one per file or one per directory.

Per-file documents are Column expressions, so they are made where the row is. A directory's
document is rows sorted by path over ranges and joined as files, whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.meanings import TABLES, interpret, interpret_value
from lumenlake.functions.text import bar, file_size, fit, general, hex_bytes, html, or_empty, plural, relative, shutter, strip_or_null, trim_zeros, yes_no
from lumenlake.functions.values import let, tag, text
from lumenlake.operators import batch, comparison, privacy
from lumenlake.sources.sink import write_document

VERSION = "1.0"
#: Columns of the CSV export.
CSV_COLUMNS = (
    "schema_version", "path", "format", "analyzed", "size_bytes", "sha256", "width", "height", "jpeg_process", "metadata_exif", "metadata_gps", "metadata_xmp",
    "metadata_iptc", "metadata_icc", "camera_model", "gps_detected", "privacy_level", "privacy_points", "error",
)
#: Columns of the bronze table that ``json_single`` reads; ``iptc`` and ``icc`` for their errors.
SINGLE_NEEDS = ("width", "height", "jpeg_process", "presence", "tags", "location", "capture", "iptc", "icc", *privacy.NEEDS)
SPECIAL = {
    "Orientation": "IFD0", "ExposureProgram": "ExifIFD", "MeteringMode": "ExifIFD", "WhiteBalance": "ExifIFD", "SceneCaptureType": "ExifIFD", "ColorSpace": "ExifIFD",
    "Flash": "ExifIFD", "GPSAltitudeRef": "GPS",
}


def csv_rows(items: DataFrame, root: str) -> DataFrame:
    return items.select(
        F.lit(VERSION).alias("schema_version"), relative(F.col("path"), root).alias("path"), "format", yes_no(batch.analyzed()).alias("analyzed"),
        *[or_empty(F.col(c)).alias(c) for c in ("size_bytes", "sha256", "width", "height", "jpeg_process")],
        *[or_empty(F.col(f"{k}_status")).alias(f"metadata_{k}") for k in comparison.KINDS], or_empty(F.col("camera_model")).alias("camera_model"),
        yes_no(F.col("gps_detected")).alias("gps_detected"), or_empty(F.col("privacy_level")).alias("privacy_level"),
        or_empty(F.col("privacy_points")).alias("privacy_points"), or_empty(F.col("error")).alias("error"),
    )


def write_csv(rows: DataFrame, path: str) -> None:
    """A folder of CSV parts with headers, written by Spark: for any size."""
    rows.write.option("header", True).option("emptyValue", "").mode("errorifexists").csv(path)


def by_path() -> list[Column]:
    """Order of files in a document: by path, case folded."""
    return [F.lower("path"), F.col("path")]


def csv_line(names: list[str]) -> Column:
    """A row's texts with commas between; quoted where they hold a comma, a quote or an end of line."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.concat_ws(",", *[F.when(F.col(n).rlike(r'[",\r\n]'), quoted(F.col(n))).otherwise(F.col(n)) for n in names])


def write_csv_file(rows: DataFrame, path: str) -> int:
    """One file with a byte-order mark, by path, replaced as a whole: for any size. Gives the number of rows."""
    pieces = rows.select("path", F.concat(csv_line(rows.columns), F.lit("\r\n")).alias("piece"))
    return write_document(pieces, by_path(), path, head="\ufeff" + ",".join(rows.columns) + "\r\n", replace=True)


def _json(value: Column, pretty: bool = False) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false", "pretty": str(pretty).lower()})


def finite(x: Column) -> Column:
    """A number that JSON can hold: null for NaN and the infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _location(sensitive: bool) -> Column:
    """Place and time of a file with GPS metadata; values only if asked, and none where they could not be read."""
    numbers, texts = ("latitude", "longitude", "altitude", "image_direction"), ("altitude_reference", "gps_date", "gps_time")
    known = (F.col("presence.gps") == "YES") & F.col("location.error").isNull() & F.lit(sensitive)
    shown = {n: finite(F.col(f"location.{n}")) for n in numbers} | {n: F.col(f"location.{n}") for n in (*texts, "altitude_ref")}
    return F.struct(
        F.col("presence.gps").alias("status"), F.coalesce(F.col("presence.gps") == "YES", F.lit(False)).alias("detected"), F.coalesce(known, F.lit(False)).alias("sensitive_values_included"),
        *[F.when(known, c).alias(n) for n, c in shown.items()], F.col("location.error").alias("error"),
    )


def _warnings() -> Column:
    """What could not be read, of the file's parts, of what its presence was looked for in, and of its place; each said once."""
    place = F.when(F.col("location.error").isNotNull(), F.array(F.concat(F.lit("GPS metadata could not be normalized: "), F.col("location.error"))))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.transform("errors", lambda e: e["message"]), F.coalesce("presence.warnings", none), F.coalesce(place, none)))


def json_single(assessed: DataFrame, keys: list[str], sensitive: bool = False, pretty: bool = False) -> DataFrame:
    """``keys`` and the JSON document of each assessed file of (path, size_bytes, sha256)."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    device = F.struct(
        strip_or_null(text(tag("IFD0", "Make"))).alias("make"), F.coalesce(strip_or_null(text(tag("IFD0", "Model"))), F.col("presence.camera_model")).alias("model"),
        strip_or_null(text(tag("IFD0", "Software"))).alias("software"),
    )
    capture = F.struct(strip_or_null(text(tag("ExifIFD", "DateTimeOriginal"))).alias("datetime_original"), *[F.col(f"capture.{c}").alias(c) for c in ("date", "time", "exposure", "iso", "aperture", "focal_length", "lens")])
    exposure = F.struct(
        F.col("findings").isNotNull().alias("available"), F.col("points").alias("points"), F.lit(privacy.MAXIMUM).alias("maximum"), F.col("level").alias("level"),
        F.col("findings").alias("findings"), F.col("privacy_error").alias("error"),
    )
    document = F.struct(
        F.lit(VERSION).alias("schema_version"), F.lit("single").alias("mode"),
        F.struct("path", name.alias("name"), F.lit("JPEG").alias("format"), F.lit("image/jpeg").alias("mime_type"), "size_bytes", "width", "height", "sha256", "jpeg_process").alias("file"),
        F.struct(*[F.col(f"presence.{k}").alias(k) for k in comparison.KINDS]).alias("metadata"), device.alias("device"), capture.alias("capture"),
        _location(sensitive).alias("gps"), exposure.alias("privacy"), _warnings().alias("warnings"),
    )
    return assessed.select(*keys, _json(document, pretty).alias("document"))


def json_files(items: DataFrame, root: str) -> DataFrame:
    """path and the JSON object of each file of a directory's document."""
    score = F.when(F.col("privacy_level").isNotNull(), F.struct(F.col("privacy_level").alias("level"), F.col("privacy_points").alias("points"), F.lit(privacy.MAXIMUM).alias("maximum")))
    one = F.struct(relative(F.col("path"), root).alias("path"), "format", batch.analyzed().alias("analyzed"), "gps_detected", score.alias("privacy"), "error")
    return items.select("path", _json(one).alias("document"))


def _json_head(items: DataFrame, root: str, recursive: bool) -> DataFrame:
    """One row: a directory's document up to its list of files, without the closing brace."""
    formats = F.struct(*[F.col(f"{f.lower()}_count").alias(f.lower()) for f in batch.FORMATS])
    summary = F.struct(
        "total_files", formats.alias("formats"), F.struct(F.col("analyzed_jpeg_count").alias("analyzed"), F.col("failed_jpeg_count").alias("failed")).alias("jpeg"),
        F.col("gps_detected_count").alias("gps_detected"), F.struct(*[F.col(f"{v}_privacy_count").alias(v) for v in ("high", "medium", "low")]).alias("privacy_exposure"),
    )
    head = F.struct(F.lit(VERSION).alias("schema_version"), F.lit("batch").alias("mode"), F.lit(root).alias("directory"), F.lit(recursive).alias("recursive"), summary.alias("summary"))
    return batch.summary(items).select(F.regexp_replace(_json(head), r"\}$", "").alias("head"))


def write_json(items: DataFrame, root: str, recursive: bool, path: str, replace: bool = False) -> int:
    """The whole directory as one JSON file, files by path: for any size. ``items`` are read twice; give a written table. Gives the number of files."""
    head = _json_head(items, root, recursive).first()["head"]
    pieces = json_files(items, root).withColumnRenamed("document", "piece")
    return write_document(pieces, by_path(), path, head=head + ',"files":[', separator=",", tail="]}", replace=replace)


def json_lines(items: DataFrame, root: str, path: str) -> None:
    """A folder of JSON lines, one per file, written by Spark: for any size."""
    json_files(items, root).select("document").write.mode("errorifexists").text(path)


def json_parts(items: DataFrame, root: str, recursive: bool) -> Iterator[str]:
    """The document of ``write_json`` piece by piece, by path, for a console; rows pass through the driver one by one."""
    yield _json_head(items, root, recursive).first()["head"] + ',"files":['
    comma = ""
    for row in json_files(items, root).orderBy(F.lower("path"), "path").toLocalIterator():
        yield comma + row["document"]
        comma = ","
    yield "]}"


def special_fields() -> Column:
    """Fields with a meaning: array<struct<name,raw,meaning>> of those present; a value that is no integer is called invalid."""
    said = lambda n, v: F.struct(F.lit(n).alias("name"), shown_value(v).alias("raw"), interpret_value(n, v).alias("meaning"))
    one = lambda n, ifd: let(tag(ifd, n), lambda v: said(n, v))  # noqa: E731  # a tag is looked for once
    return F.filter(F.array(*[one(n, SPECIAL[n]) for n in SPECIAL if n in TABLES]), lambda x: x["raw"].isNotNull())


def shown_value(v: Column) -> Column:
    """A tag's value for people: fractions as num/den, bytes as hex."""
    rationals = F.transform(v["rationals"], lambda r: F.when(r["den"] == 1, r["num"].cast("string")).otherwise(F.concat(r["num"].cast("string"), F.lit("/"), r["den"].cast("string"))))
    many = F.coalesce(rationals, F.transform(v["ints"], lambda i: i.cast("string")), F.transform(v["floats"], general))
    return F.when(v["kind"] == "text", v["text"]).when(v["kind"] == "bytes", F.concat(F.lit("0x"), F.lower(F.hex(v["bytes"])))).otherwise(F.array_join(many, ", "))


def _table(rows: Column) -> Column:
    """HTML table of array<struct<k,v>>."""
    cell = lambda r: F.concat(F.lit("<tr><th>"), html(r["k"]), F.lit("</th><td>"), html(F.coalesce(r["v"], F.lit("-"))), F.lit("</td></tr>"))
    return F.concat(F.lit("<table>"), F.array_join(F.transform(rows, cell), ""), F.lit("</table>"))


def _section(title: str, body: Column) -> Column:
    return F.concat(F.lit(f"<section><h2>{title}</h2>"), body, F.lit("</section>"))


def _pairs(**values: Column) -> Column:
    return F.array(*[F.struct(F.lit(k.replace("_", " ")).alias("k"), v.cast("string").alias("v")) for k, v in values.items()])


def _metadata(ifd: str, hidden: bool = False) -> Column:
    rows = F.transform(F.filter("tags", lambda t: t["ifd"] == ifd), lambda t: F.struct(F.lower(t["tag_name"]).alias("o"), t["tag_name"].alias("k"), (F.lit("[hidden]") if hidden else shown_value(t["value"])).alias("v")))
    return _table(F.transform(F.array_sort(rows), lambda r: F.struct(r["k"].alias("k"), r["v"].alias("v"))))


def html_report(judged: DataFrame, keys: list[str], sensitive: bool = False) -> DataFrame:
    """``keys`` and an HTML page per file with findings and anomalies; exact locations only if asked."""
    list_of = lambda xs, f: F.concat(F.lit("<ul>"), F.array_join(F.transform(xs, lambda x: F.concat(F.lit("<li>"), html(f(x)), F.lit("</li>"))), ""), F.lit("</ul>"))
    said = lambda f: F.concat(F.lit("["), F.upper(f["severity"]), F.lit("] "), f["message"])
    hide = lambda c: F.col(c) if sensitive else F.when(F.col(c).isNotNull(), F.lit("[hidden]"))
    pairs = F.transform(special_fields(), lambda s: F.struct(s["name"].alias("k"), s["meaning"].alias("v")))
    xmp = F.transform("xmp", lambda p: F.struct(p["qualified_name"].alias("k"), F.coalesce(p["value_text"], F.array_join(p["value_list"], ", ")).alias("v")))
    iptc = F.transform("iptc", lambda d: F.struct(d["name"].alias("k"), F.coalesce(d["text"], F.hex(d["raw"])).alias("v")))
    sections = [
        _section("File Information", _table(_pairs(path=F.col("path"), size=F.col("size_bytes"), width=F.col("width"), height=F.col("height"), process=F.col("jpeg_process"), sha256=F.col("sha256")))),
        _section("Capture", _table(_pairs(**{c: F.col(f"capture.{c}") for c in ("date", "time", "exposure", "iso", "aperture", "focal_length", "lens")}))),
        _section("Location", _table(_pairs(detected=F.col("location.gps_detected"), latitude=hide("location.latitude"), longitude=hide("location.longitude"), altitude=hide("location.altitude")))),
        _section("IFD0", _metadata("IFD0")), _section("EXIF", _metadata("ExifIFD")), _section("GPS", _metadata("GPS", not sensitive)),
        _section("XMP", _table(xmp)), _section("IPTC", _table(iptc)), _section("Special Fields", _table(pairs)),
        _section("Privacy", F.concat(F.lit("<p>"), or_empty(F.col("points")), F.lit(f"/{privacy.MAXIMUM} "), or_empty(F.col("level")), F.lit("</p>"), list_of(F.coalesce("findings", F.array().cast(privacy.FINDINGS)), said))),
        _section("Anomalies", list_of(F.col("anomalies"), said)),
        _section("Interpretation Notes", F.lit("<p>Findings are indicators for review. They are not proof.</p>")),
    ]
    warnings = F.when(F.size("errors") > 0, _section("Warnings", list_of(F.col("errors"), lambda e: F.concat(e["part"], F.lit(": "), e["message"])))).otherwise("")
    page = F.concat(F.lit('<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>'), html(F.col("path")), F.lit("</title></head><body>"), *sections, warnings, F.lit("</body></html>"))
    return judged.select(*keys, page.alias("document"))


def _lines(*lines: Column) -> Column:
    return F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n")


def text_scan(judged: DataFrame, keys: list[str]) -> DataFrame:
    """A text block per file: presence, camera, resolution, privacy."""
    row = lambda label, v: F.concat(F.lit(f"{label:<14}: "), F.coalesce(v.cast("string"), F.lit("-")))
    lines = [row(k.upper(), F.col(f"presence.{k}")) for k in comparison.KINDS] + [
        row("Camera", F.col("presence.camera_model")), row("Resolution", F.concat(F.col("width").cast("string"), F.lit(" x "), F.col("height").cast("string"))),
        row("Process", F.col("jpeg_process")), row("Exposure", F.concat(F.col("points").cast("string"), F.lit("/100 "), F.col("level"))),
        F.concat(F.lit("["), bar(F.coalesce("points", F.lit(0))), F.lit("]")),
    ]
    return judged.select(*keys, _lines(*lines).alias("document"))


def text_segments(photos: DataFrame, keys: list[str]) -> DataFrame:
    line = lambda s: F.concat(F.lpad(s["offset"].cast("string"), 10, " "), F.lit("  FF"), F.lpad(F.hex(s["marker"]), 2, "0"), F.lit("  "), F.rpad(s["name"], 12, " "), F.lpad(s["payload_length"].cast("string"), 7, " "))
    return photos.select(*keys, F.array_join(F.transform("segments", line), "\n").alias("document"))


def text_findings(judged: DataFrame, keys: list[str], column: str, detailed: bool = False) -> DataFrame:
    """Privacy or anomaly findings, one per line, with fields or evidence if ``detailed``."""
    more = (lambda f: F.array_join(f["fields"] if column == "findings" else f["evidence"], ", ")) if detailed else (lambda f: F.lit(""))
    line = lambda f: F.concat(F.lit("["), F.upper(f["severity"]), F.lit("] "), f["message"], F.when(more(f) != "", F.concat(F.lit(" ("), more(f), F.lit(")"))).otherwise(""))
    return judged.select(*keys, F.coalesce(F.nullif(F.array_join(F.transform(column, line), "\n"), F.lit("")), F.lit("No findings.")).alias("document"))


def text_gps(photos: DataFrame, keys: list[str]) -> DataFrame:
    at = F.concat(F.format_string("%.6f", F.col("location.latitude")), F.lit(", "), F.format_string("%.6f", F.col("location.longitude")))
    high = F.when(F.col("location.altitude").isNotNull(), F.concat(F.lit("Altitude: "), general(F.col("location.altitude")), F.lit(" m ("), F.col("location.altitude_reference"), F.lit(")")))
    time = F.when(F.col("location.gps_date").isNotNull(), F.concat_ws(" ", F.lit("Time:"), "location.gps_date", "location.gps_time"))
    none = F.when(~F.coalesce("location.gps_detected", F.lit(False)), F.lit("No GPS metadata."))
    return photos.select(*keys, F.coalesce(none, _lines(F.when(F.col("location.latitude").isNotNull() & F.col("location.longitude").isNotNull(), at), high, time)).alias("document"))


def text_gps_raw(photos: DataFrame, keys: list[str]) -> DataFrame:
    """Every GPS tag as it stands: fractions exact, bytes as hex."""
    listed = F.transform(F.filter("tags", lambda t: t["ifd"] == "GPS"), lambda t: F.concat(F.rpad(t["tag_name"], 28, " "), F.lit(": "), raw_value(t["value"])))
    return photos.select(*keys, F.coalesce(F.nullif(F.array_join(listed, "\n"), F.lit("")), F.lit("No GPS metadata.")).alias("document"))


def raw_value(v: Column) -> Column:
    """A tag's value without interpretation: every fraction as num/den, several in parentheses, bytes as pairs of hex digits."""
    many = F.coalesce(F.transform(v["rationals"], lambda r: F.concat_ws("/", r["num"].cast("string"), r["den"].cast("string"))), F.transform(v["ints"], lambda x: x.cast("string")), F.transform(v["floats"], lambda x: x.cast("string")))
    shown = F.when(v["is_scalar"], many[0]).otherwise(F.concat(F.lit("("), F.array_join(many, ", "), F.lit(")")))
    return F.when(v["kind"] == "text", v["text"]).when(v["kind"] == "bytes", F.lower(hex_bytes(v["bytes"]))).otherwise(shown)


def text_comparison(pairs: DataFrame, keys: list[str]) -> DataFrame:
    row = lambda label, f: F.concat(F.rpad(F.lit(label), 22, " "), fit(F.coalesce(F.col(f"original.{f}").cast("string"), F.lit("-")), 28), fit(F.coalesce(F.col(f"copy.{f}").cast("string"), F.lit("-")), 28))
    rows = [row(label, f) for label, f in (("Size", "size_bytes"), ("Width", "width"), ("Height", "height"), ("Process", "jpeg_process"), ("EXIF", "exif"), ("GPS", "gps"), ("XMP", "xmp"), ("IPTC", "iptc"), ("ICC", "icc"), ("Camera", "camera_model"))]
    points = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat(F.lit("- "), x)), "\n")
    changed = F.coalesce(F.nullif(points(F.transform("changes", lambda c: c["message"])), F.lit("")), F.lit("- no difference in what is compared"))
    titled = lambda title, xs: F.when(F.size(xs) > 0, F.concat(F.lit(title + "\n"), points(xs)))
    verdict = F.concat(F.lit("Recompression: "), F.col("recompression.level"), F.lit(" - "), F.col("recompression.message"))
    # What either file's parts could not be read for, the original's first.
    none = F.array().cast("array<string>")
    said = F.concat(*[F.coalesce(F.col(f"{side}.warnings"), none) for side in ("original", "copy")])
    return pairs.select(*keys, _lines(*rows, changed, verdict, titled("Evidence:", F.col("recompression.evidence")), titled("Warnings:", said)).alias("document"))


def text_scrub(report: DataFrame, keys: list[str]) -> DataFrame:
    """Before, after, what is preserved and how much went, of each file of ``sanitize.report``."""
    kept = lambda c: F.coalesce(yes_no(c), F.lit("NO"))
    sides = lambda c: F.concat_ws(" -> ", F.coalesce(F.col(f"before_{c}").cast("string"), F.lit("-")), F.coalesce(F.col(f"after_{c}").cast("string"), F.lit("-")))
    tail = F.coalesce(F.aggregate(F.filter("changes", lambda c: c["marker"] == -1), F.lit(0).cast("long"), lambda a, c: a + c["old_bytes"]), F.lit(0))
    shown = _rows(
        Mode=F.upper("mode"), GPS=sides("gps"), Privacy_findings=sides("findings"), JPEG_structure_valid=kept(F.col("error").isNull()),
        Dimensions_preserved=kept(F.col("before_size") == F.col("after_size")), Image_data_preserved=kept(F.col("same_scans")), Removed_segments=F.col("removed_segments"),
        Modified_segments=F.col("modified_segments"), Removed_bytes=F.col("removed_bytes"), Trailing_bytes_removed=F.when(tail > 0, tail), Verified=kept(F.col("verified")),
    )
    return report.select(*keys, _lines(shown, F.concat(F.lit("error: "), F.col("error"))).alias("document"))


def failure_lines(items: DataFrame, root: str) -> DataFrame:
    """path and a line of each JPEG that could not be analysed: for any number of files."""
    return batch.failed(items).select("path", F.concat(F.lit("- "), relative(F.col("path"), root), F.lit(": "), F.coalesce("error", F.lit("unknown"))).alias("line"))


def privacy_lines(items: DataFrame, root: str) -> DataFrame:
    """path and a line of each JPEG: level, points, GPS and name, or its error: for any number of files."""
    name = relative(F.col("path"), root)
    good = F.concat(F.lit("["), F.col("privacy_level"), F.lit("] "), F.col("privacy_points").cast("string"), F.lit(f"/{privacy.MAXIMUM} GPS="), F.when(F.coalesce("gps_detected", F.lit(False)), "YES").otherwise("NO"), F.lit(" "), name)
    bad = F.concat(F.lit("[ERROR] "), name, F.lit(" - "), F.col("error"))
    return items.where("format = 'JPEG'").select("path", F.when(F.col("error").isNull(), good).otherwise(bad).alias("line"))


def _with_lines(counts: DataFrame, head: Column, title: str, lines: DataFrame) -> DataFrame:
    """(section, path, piece): the lines of ``head`` over ``counts`` and, under a title, ``lines``."""
    top = counts.select(F.lit(0).alias("section"), F.posexplode(F.split(head, "\n")).alias("k", "piece")).select("section", F.format_string("%06d", "k").alias("path"), "piece")
    over = lines.select(F.lit(1).alias("section"), F.lit("").alias("path"), F.lit(title).alias("piece")).limit(1)
    return top.unionByName(over).unionByName(lines.select(F.lit(2).alias("section"), "path", F.col("line").alias("piece")))


def write_text(pieces: DataFrame, path: str, replace: bool = False) -> int:
    """The lines of ``text_batch`` or ``text_batch_privacy`` as one file: for any number of files. Gives the number of lines."""
    return write_document(pieces, [F.col("section"), *by_path()], path, separator="\n", replace=replace)


def _count_lines() -> Column:
    total = F.concat(F.col("total_files").cast("string"), F.lit(" "), plural(F.col("total_files"), "file", "files"))
    return _lines(
        F.concat(F.lit("Files: "), total), *[F.format_string(f"{f}: %d", f"{f.lower()}_count") for f in batch.FORMATS],
        F.format_string("JPEG analyzed: %d, failed: %d", "analyzed_jpeg_count", "failed_jpeg_count"), F.format_string("GPS detected: %d", "gps_detected_count"),
        F.format_string("Exposure HIGH: %d, MEDIUM: %d, LOW: %d", "high_privacy_count", "medium_privacy_count", "low_privacy_count"),
    )


def text_batch(items: DataFrame, root: str = "") -> DataFrame:
    """Lines (section, path, piece): counts of a directory, and the JPEGs that could not be analysed. ``items`` are read several times."""
    return _with_lines(batch.summary(items), _count_lines(), "Failed JPEG:", failure_lines(items, root))


def text_batch_privacy(items: DataFrame, root: str = "", detailed: bool = False) -> DataFrame:
    """Lines (section, path, piece): counts of a directory and, with ``detailed``, a line for each JPEG."""
    note = F.lit("Levels come from rules over metadata; they are not probabilities of harm.")
    head = _lines(_count_lines(), note)
    lines = privacy_lines(items, root)
    return _with_lines(batch.summary(items), head, "JPEG results:", lines if detailed else lines.where("false"))


def _rows(**values: Column) -> Column:
    """One ``label: value`` line per field; a missing value is a dash."""
    width = max(map(len, values))
    return _lines(*[F.concat(F.lit(f"{k.replace('_', ' '):<{width}} : "), F.coalesce(v.cast("string"), F.lit("-"))) for k, v in values.items()])


def text_score(judged: DataFrame, keys: list[str], detailed: bool = False) -> DataFrame:
    """Score, level and bar; with ``detailed`` also points by finding and the findings without points. ``judged`` has findings, or what ``privacy.judge`` found."""
    head = F.concat(or_empty(F.col("points")), F.lit(f"/{privacy.MAXIMUM} "), or_empty(F.col("level")), F.lit(" ["), bar(F.coalesce("points", F.lit(0))), F.lit("]"))
    rows = judged if "found" in judged.columns else judged.withColumn("found", privacy.found_in(F.col("findings")))
    there = lambda code, line: F.when(F.col("found")[code], F.lit(line))
    given = [there(c, f"+{p} {label}") for c, (p, label) in privacy.POINTS.items()]
    free = [there(c, f"not scored: {c}") for c in sorted(privacy.CODES - privacy.POINTS.keys())]
    return rows.select(*keys, F.coalesce("privacy_error", F.concat_ws("\n", head, *(given + free if detailed else []))).alias("document"))


def text_file_info(info: DataFrame, keys: list[str]) -> DataFrame:
    return info.select(*keys, _rows(Name=F.col("name"), Size=F.col("size_human"), Bytes=F.col("size_bytes"), Modified=F.col("modified")).alias("document"))


def text_special(photos: DataFrame, keys: list[str]) -> DataFrame:
    line = lambda s: F.concat(s["name"], F.lit(": "), s["meaning"], F.lit(" ("), s["raw"], F.lit(")"))
    return photos.select(*keys, F.array_join(F.transform(special_fields(), line), "\n").alias("document"))


def _size(w: str, h: str) -> Column:
    return F.concat(F.col(w).cast("string"), F.lit(" x "), F.col(h).cast("string"))


def _device() -> dict[str, Column]:
    turned = F.when(F.col("orientation").isNotNull(), F.concat(F.col("orientation").cast("string"), F.lit(" ("), interpret("Orientation", F.col("orientation")), F.lit(")")))
    return {"Make": F.col("make"), "Model": F.col("model"), "Software": F.col("software"), "Artist": F.col("artist"), "Date_original": F.col("datetime_original"), "Orientation": turned}


def _or_error(shown: Column, warnings: Column | None = None) -> Column:
    said = None if warnings is None else F.when(F.size(warnings) > 0, F.concat(F.lit("Warnings:\n"), F.array_join(F.transform(warnings, lambda w: F.concat(F.lit("- "), w)), "\n")))
    return F.coalesce(F.concat(F.lit("error: "), F.col("error")), shown if said is None else _lines(shown, said)).alias("document")


def text_container(containers: DataFrame, keys: list[str]) -> DataFrame:
    """PNG, WebP and TIFF."""
    shown = _rows(
        Format=F.col("detected"), MIME=F.col("mime"), Resolution=_size("width", "height"), Mode=F.col("mode"), Frames=F.col("frames"), Animated=yes_no(F.col("animated")),
        EXIF=F.col("exif"), GPS=F.col("gps"), XMP=F.col("xmp"), ICC=F.col("icc"), **_device(),
    )
    return containers.select(*keys, _or_error(shown, F.col("warnings")))


def text_heif(heif: DataFrame, keys: list[str]) -> DataFrame:
    """HEIF images of ``optional.heif_images``; the brands are shown even where the reader is missing."""
    box = {"Major_brand": F.try_element_at("brands", F.lit(1)), "Compatible": F.array_join(F.slice("brands", 2, 64), ", ")}
    shown = _rows(
        Format=F.col("format"), MIME=F.col("mime"), Size=file_size(F.col("size_bytes")), Resolution=_size("width", "height"), Mode=F.col("mode"), Images=F.col("images"),
        Bit_depth=F.col("bit_depth"), Chroma=F.col("chroma"), Alpha=yes_no(F.col("has_alpha")), SHA256=F.col("sha256"), **box, EXIF=F.col("exif"), GPS=F.col("gps"),
        XMP=F.col("xmp"), ICC=F.col("icc"), NCLX=F.col("nclx"), Other_blocks=F.col("other_blocks"), **_device(),
    )
    return heif.select(*keys, F.coalesce(F.concat(F.lit("error: "), F.col("error"), F.lit("\n"), _rows(**box)), _or_error(shown, F.col("warnings"))).alias("document"))


def number(x: Column) -> Column:
    """Four digits after the point at most; whole numbers without one."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(trim_zeros(F.format_string("%.4f", x)))


def text_raw(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Camera raw files of ``optional.raw_images``."""
    listed = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ", "), F.lit("]")))
    focal = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.2f mm", c))
    shown = _rows(
        Format=F.lit("RAW"), Variant=F.col("variant"), Size=file_size(F.col("size_bytes")), SHA256=F.col("sha256"), Raw_size=_size("raw_width", "raw_height"), Visible_size=_size("width", "height"),
        Top_margin=F.col("top_margin"), Left_margin=F.col("left_margin"), Crop=_size("crop_width", "crop_height"), Pixel_aspect=F.col("pixel_aspect"), Flip=F.col("flip"), Raw_type=F.col("raw_type"),
        Colors=F.col("num_colors"), Color_description=F.col("color_description"), White_level=F.col("white_level"), Black_levels=listed("black_level"), Camera_white=listed("camera_white_level"),
        Camera_balance=listed("camera_white_balance"), Daylight_balance=listed("daylight_white_balance"), ISO=number(F.col("iso_speed")), Shutter=shutter(F.col("shutter_speed")),
        Aperture=F.when(F.col("aperture").isNotNull(), F.format_string("f/%.2f", "aperture")), Focal_length=focal("focal_length"), Timestamp=F.col("timestamp"), Shot_order=F.col("shot_order"),
        Artist=F.col("artist"), Lens_make=F.col("lens_make"), Lens_model=F.col("lens_model"), Min_focal=focal("lens_min_focal"), Max_focal=focal("lens_max_focal"),
    )
    return raw.select(*keys, _or_error(shown))


def text_exiftool(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Normalised tool output; exact places are never shown."""
    size = F.concat(F.col("width").cast("string"), F.lit(" x "), F.col("height").cast("string"))
    groups = F.array_join(F.transform("group_counts", lambda g: F.concat(g["group"], F.lit("="), g["count"].cast("string"))), ", ")
    return facts.select(
        *keys,
        _rows(
            Type=F.col("file_type"), Resolution=size, MIME=F.col("mime"), Make=F.col("make"), Model=F.col("model"), Software=F.col("software"), Date_original=F.col("datetime_original"),
            Lens_make=F.col("lens_make"), Lens_model=F.col("lens_model"), Orientation=F.col("orientation"), EXIF=F.col("exif"), GPS=F.col("gps"), XMP=F.col("xmp"), IPTC=F.col("iptc"),
            ICC=F.col("icc"), QuickTime=F.col("quicktime"), Tags=F.col("tag_count"), Groups=groups, Warnings=F.array_join("warnings", "; "),
        ).alias("document"),
    )


def text_full(judged: DataFrame, keys: list[str]) -> DataFrame:
    """Scan, score, findings, anomalies and fields with a meaning, one after the other."""
    makers = (
        ("Scan", text_scan), ("Exposure", lambda d, k: text_score(d, k, True)), ("Privacy", lambda d, k: text_findings(d, k, "findings", True)),
        ("Anomalies", lambda d, k: text_findings(d, k, "anomalies", True)), ("Fields", text_special), ("Location", text_gps),
    )
    out, names = judged, judged.columns
    for title, make in makers:
        out = make(out, [*names, *[c for c in out.columns if c.startswith("doc_")]]).withColumnRenamed("document", f"doc_{title}")
    titled = [F.concat(F.lit(f"== {t} ==\n"), F.col(f"doc_{t}")) for t, _ in makers]
    return out.select(*keys, F.array_join(F.array(*titled), "\n").alias("document"))
