"""Sending this package to the executors of a session that cannot import it from their own path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's modules to the session, once."""
    context = spark.sparkContext
    if context.applicationId in _DONE:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="pegspark-code-"), "pegspark_code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("pegspark", os.path.relpath(full, root)))
    context.addPyFile(path)
    _DONE.add(context.applicationId)
