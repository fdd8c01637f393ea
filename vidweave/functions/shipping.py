"""Sends this package to the executors, so that functions in its modules can run in their workers."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's files, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with tempfile.TemporaryDirectory() as tmp:
        staged = os.path.join(tmp, "staged")
        shutil.copytree(package, os.path.join(staged, os.path.basename(package)), ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="package-"), "vidweave"), "zip", staged)
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
