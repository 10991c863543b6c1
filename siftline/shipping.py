"""Gets this package to the Python workers where they wouldn't find it by themselves."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def _workers_find_it() -> bool:
    """Workers inherit the driver's PYTHONPATH and, in local mode, its working folder."""
    places = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    return any(p and Path(p).resolve() == _ROOT for p in places)


def ship(spark: SparkSession) -> None:
    """Once an application, hands the package to Spark (as --py-files does), which serves it to all executors."""
    app = spark.sparkContext.applicationId
    if app in _shipped or _workers_find_it():
        return
    folder = tempfile.mkdtemp(prefix="siftline-")  # the driver's copy; executors fetch it from the driver
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/siftline.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((_ROOT / "siftline").rglob("*.py")):
            z.write(f, f.relative_to(_ROOT))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
