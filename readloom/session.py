"""What a session needs before queries run: executors that can import this package."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors, once per application, unless they are threads of this process and its import path has it."""
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    places = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    here = (master == "local" or master.startswith("local[")) and any(p and (Path(p) / "readloom").exists() for p in places)
    if app in _shipped or here:
        return
    archive = Path(tempfile.mkdtemp(prefix="readloom-ship-")) / "readloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for f in sorted((_ROOT / "readloom").rglob("*.py")):
            out.write(f, f.relative_to(_ROOT))
    known = list(sys.path)
    spark.sparkContext.addPyFile(str(archive))
    sys.path[:] = known
    _shipped.add(app)
