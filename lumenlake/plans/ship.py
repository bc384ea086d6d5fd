"""Make this package importable in the executors' Python workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources once per application; Spark hands them to every executor, also to later ones."""
    app = spark.sparkContext.applicationId
    if app in _done:
        return
    top = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="lumenlake-src-")
    atexit.register(shutil.rmtree, folder, True)
    stage = Path(folder) / "src"
    shutil.copytree(top, stage / top.name, ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{top.name}", "zip", stage))
    _done.add(app)
