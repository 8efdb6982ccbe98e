"""Send the package to the executors, for sessions that were started without it on their Python path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package's own sources to the session, once. Needed before any stage with Python workers is planned."""
    context = spark.sparkContext
    if getattr(context, "_listforge_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(os.path.realpath(tempfile.mkdtemp(prefix="listforge-")), "listforge.zip")
    with zipfile.ZipFile(path, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(str(path))
    context._listforge_shipped = True
