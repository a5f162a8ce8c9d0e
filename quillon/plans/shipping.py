"""Sending the package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds this package to the application's Python files, once, so that tasks can import it wherever the driver did.

    The archive is written beside the driver and served by it; nothing is needed on the executors.
    """
    sc = spark.sparkContext
    root = Path(__file__).parents[1]
    if sc.applicationId in _shipped or not root.is_dir():
        return
    path = Path(tempfile.mkdtemp(prefix="quillon-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)
