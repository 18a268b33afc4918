"""Makes this package importable in the Python workers of every executor."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_DONE: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources once to the session's cluster; Spark also gives them to executors that join later."""
    app = spark.sparkContext.applicationId
    if app not in _DONE:
        name = os.path.basename(_PACKAGE)
        path = os.path.join(tempfile.mkdtemp(prefix="strandloom-src-"), name + ".zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, files in os.walk(_PACKAGE):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        z.write(full, os.path.join(name, os.path.relpath(full, _PACKAGE)))
        spark.sparkContext.addPyFile(path)
        _DONE.add(app)
    return spark
