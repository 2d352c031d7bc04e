"""Sending the package to the executors of a session whose machines do not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> str:
    """Adds the package as a zip to the session: tasks import it from there. Returns the zip's path on the driver, from where Spark serves it."""
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), "fleetrisk.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("fleetrisk", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    return path
