"""Sends this package to the executors' Python workers, once per Spark context."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Workers import the package from here where it isn't installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    handle, name = tempfile.mkstemp(prefix="mnemospark-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted((root / "mnemospark").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(name)
    atexit.register(Path(name).unlink, True)  # the driver serves the file while it runs
    _shipped.add(sc.applicationId)
