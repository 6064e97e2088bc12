"""What a session needs before Python code of this package runs on executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors with Spark's own file transfer, once per application.

    Where the driver and executors find the package on PYTHONPATH already, the copy is merely unused.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    at = tempfile.mkdtemp()  # the driver serves the archive from here while the application runs
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    shutil.copytree(root, f"{at}/tree/{os.path.basename(root)}", ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(f"{at}/{os.path.basename(root)}_py", "zip", f"{at}/tree"))
    _shipped.add(sc.applicationId)
