"""Getting this package to the executors."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the Python workers of this application once, so they need no path of the driver's."""
    context = spark.sparkContext
    if context.applicationId not in _sent:
        here = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="wavelode-code-")
        copy = os.path.join(folder, "package")
        shutil.copytree(here, os.path.join(copy, "wavelode"), ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
        context.addPyFile(shutil.make_archive(os.path.join(folder, "wavelode"), "zip", copy))
        shutil.rmtree(copy)
        _sent.add(context.applicationId)
    return spark
