"""Send this package to the executors, so that functions of its modules can run there wherever it was imported from."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Keeps the archive that executors fetch, for as long as this process lives.
_FOLDER = tempfile.TemporaryDirectory()


def ship(spark: SparkSession) -> None:
    """Add the package's archive to the Spark context, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_ridgeline_sent", False):
        return
    package = Path(_FOLDER.name, "src", "ridgeline")
    if not package.exists():
        shutil.copytree(Path(__file__).resolve().parent, package, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(os.path.join(_FOLDER.name, "ridgeline"), "zip", package.parent))
    context._ridgeline_sent = True
