"""Makes this library importable in the executors' Python, where the cluster has not installed it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import postmill

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands the library's source files to all executors, once per application; Spark serves them from the driver."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(postmill.__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="postmill-")) / f"postmill-{context.applicationId}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
