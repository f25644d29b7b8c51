"""What a Spark session needs before Python code of this package runs on its executors."""

from __future__ import annotations

import tempfile
import threading
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import SparkSession


_shipping = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the executors' Python workers, once for each Spark context."""
    with _shipping:  # shards are asked side by side, and a context refuses a second package of this name
        _ship(spark.sparkContext)


def _ship(sc: SparkContext) -> None:
    if getattr(sc, "_nearfield_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="nearfield-")) / "nearfield.zip"  # the driver serves it to all executors
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._nearfield_shipped = True
