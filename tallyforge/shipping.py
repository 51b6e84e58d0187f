"""Puts the package on the Python path of Spark's workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add this package to the session as a zip, once per application, so that functions
    sent to workers find their modules wherever the driver was started from."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="spark-package-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, f"{root.name}/{source.relative_to(root)}")
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
