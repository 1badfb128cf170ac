"""Sends the package to the executors' Python workers, which need it wherever a query runs Python."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds a zip of the package to the session's Python files, once an application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SENT:
        top = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="bitloom-")) / "bitloom-package.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(top.rglob("*")):
                if p.is_file() and "__pycache__" not in p.parts:
                    z.write(p, p.relative_to(top.parent))
        sc.addPyFile(str(path))
        _SENT.add(sc.applicationId)
    return spark
