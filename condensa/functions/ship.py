"""Give executors this package, also where it isn't installed or on their PYTHONPATH."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add a zip of the package to the Spark application, once."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    top = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="condensa-"), "condensa.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f"{top.name}/{f.relative_to(top)}")
    sc.addPyFile(path)
    _SENT.add(sc.applicationId)
