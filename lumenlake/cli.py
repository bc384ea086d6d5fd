"""Verbs on files and folders: scan, privacy, gps, report, hash, anomalies, compare, scrub."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.operators import anomalies, batch, comparison, exiftool, hashing, privacy, sanitize
from lumenlake.plans import reports, shared
from lumenlake.sources import files, optional

KEYS = ["path", "size_bytes", "sha256"]


def session() -> SparkSession:
    return SparkSession.builder.appName("lumenlake").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _blobs(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    rows = files.scan_directory(spark, path, recursive)
    return rows.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "content")


def _judged(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    return anomalies.detect(privacy.assess(files.photos(_blobs(spark, path, recursive), KEYS)))


def _print(documents: DataFrame) -> None:
    """One document after the other, by path; they pass through the driver one by one."""
    rows = documents.orderBy("path") if "path" in documents.columns else documents
    for row in rows.toLocalIterator():
        print(row["document"])


def _print_lines(lines: DataFrame) -> None:
    """A document's lines in order, one by one."""
    for row in lines.orderBy("section", *reports.by_path()).toLocalIterator():
        print(row["piece"])


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lumenlake", description=__doc__)
    verbs = top.add_subparsers(dest="verb")

    def verb(name: str, *paths: str) -> argparse.ArgumentParser:
        v = verbs.add_parser(name)
        for p in paths:
            v.add_argument(p)
        return v

    scan = verb("scan", "path")
    scan.add_argument("--directory", action="store_true")
    scan.add_argument("--recursive", action="store_true")
    kind = scan.add_mutually_exclusive_group()
    kind.add_argument("--json", action="store_true")
    kind.add_argument("--csv", metavar="FILE")
    kind.add_argument("--segments", action="store_true")
    scan.add_argument("--sensitive", action="store_true")
    scan.add_argument("--backend", choices=("native", "exiftool"), default="native")
    for name in ("privacy", "anomalies"):
        one = verb(name, "path")
        one.add_argument("--detailed", action="store_true")
        if name == "privacy":
            one.add_argument("--directory", action="store_true")
            one.add_argument("--recursive", action="store_true")
    verb("gps", "path").add_argument("--raw", action="store_true")
    report = verb("report", "path")
    report.add_argument("--text", action="store_true")
    report.add_argument("--output", default=None)
    report.add_argument("--force", action="store_true")
    report.add_argument("--sensitive", action="store_true")
    verb("hash", "path").add_argument("--algorithm", action="append")
    verb("compare", "original", "copy")
    scrub = verb("scrub", "path")
    scrub.add_argument("--mode", choices=sanitize.MODES, default="all")
    return top


def run(args: argparse.Namespace, spark: SparkSession) -> None:
    if args.verb == "scan":
        _scan(args, spark)
    elif args.verb == "privacy" and args.directory:
        items = shared.written(batch.items(files.scan_directory(spark, args.path, args.recursive)), "items")
        _print_lines(reports.text_batch_privacy(items, f"file:{args.path}", args.detailed))
    elif args.verb == "privacy":
        _print(reports.text_findings(_judged(spark, args.path), ["path"], "findings", args.detailed))
    elif args.verb == "anomalies":
        _print(reports.text_findings(_judged(spark, args.path), ["path"], "anomalies", args.detailed))
    elif args.verb == "gps":
        make = reports.text_gps_raw if args.raw else reports.text_gps
        _print(make(files.photos(_blobs(spark, args.path), KEYS), ["path"]))
    elif args.verb == "report":
        _report(args, spark)
    elif args.verb == "hash":
        names = tuple(args.algorithm or hashing.ALGORITHMS)
        for row in hashing.hashes(_blobs(spark, args.path), ["path"], "content", names).orderBy("path").toLocalIterator():
            for name in dict.fromkeys(map(hashing.algorithm, names)):
                print(f"{name}: {row[name]}  {row['path']}")
    elif args.verb == "compare":
        sides = [comparison.snapshots(files.photos(_blobs(spark, p), KEYS), ["path"]).withColumn("pair", F.lit(1)) for p in (args.original, args.copy)]
        _print(reports.text_comparison(comparison.compare(*sides, ["pair"]), ["pair"]))
    elif args.verb == "scrub":
        blobs = _blobs(spark, args.path)
        done = sanitize.scrub(blobs, args.mode, ["path"])
        for row in sanitize.write_files(done.where("verified")).toLocalIterator():
            print("/" + row["target"].removeprefix("file:").lstrip("/"))
        _print(reports.text_scrub(sanitize.report(blobs, args.mode, ["path"]), ["path"]))


def _scan(args: argparse.Namespace, spark: SparkSession) -> None:
    if args.sensitive and not args.json:
        raise ValueError("--sensitive needs --json")
    if args.directory or args.csv:
        items = shared.written(batch.items(files.scan_directory(spark, args.path, args.recursive, [args.csv] if args.csv else None)), "items")
        if args.csv:
            print(reports.write_csv_file(reports.csv_rows(items, f"file:{args.path}"), args.csv))
        elif args.json:
            for part in reports.json_parts(items, f"file:{args.path}", args.recursive):
                print(part, end="")
            print()
        else:
            _print_lines(reports.text_batch(items, f"file:{args.path}"))
    elif args.segments:
        _print(reports.text_segments(files.photos(_blobs(spark, args.path), KEYS), ["path"]))
    elif (kind := _kind(spark, args.path)) in ("PNG", "WEBP", "TIFF"):
        _print(reports.text_container(files.containers(_blobs(spark, args.path), ["path"]), ["path"]))
    elif kind == "HEIF":
        _print(reports.text_heif(optional.heif_images(_blobs(spark, args.path)), ["path"]))
    elif kind == "RAW":
        _print(reports.text_raw(optional.raw_images(_blobs(spark, args.path)), ["path"]))
    elif args.backend == "exiftool":
        found = optional.exiftool_json(_blobs(spark, args.path))
        _print(reports.text_exiftool(exiftool.normalise(found, ["path"]), ["path"]))
    else:
        judged = _judged(spark, args.path)
        _print(reports.json_single(judged, ["path"], args.sensitive, pretty=True) if args.json else reports.text_scan(judged, ["path"]))


def _kind(spark: SparkSession, path: str) -> str | None:
    """Format of one file; a camera raw file counts as one even where its reader is missing."""
    row = files.scan_directory(spark, path).select(files.detect(F.col("content"), F.col("path"), raw_backend=True).alias("f")).first()
    return row["f"] if row else None


def _report(args: argparse.Namespace, spark: SparkSession) -> None:
    import os

    judged = _judged(spark, args.path)
    if args.text:
        if args.output or args.force:
            raise ValueError("--text excludes --output and --force")
        _print(reports.text_full(judged, ["path"]))
        return
    target = args.output or "report.html"
    if os.path.exists(target) and not args.force:
        raise ValueError(f"{target} exists; --force overwrites it")
    row = reports.html_report(judged, ["path"], args.sensitive).first()
    with open(f"{target}.part", "w", encoding="utf-8") as f:
        f.write(row["document"])
    os.replace(f"{target}.part", target)
    print(target)


def main(argv: list[str] | None = None) -> int:
    top = parser()
    args = top.parse_args(argv)
    if not args.verb:
        top.print_help()
        return 0
    try:
        run(args, session())
    except Exception as e:  # every failure is one line and a status
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
