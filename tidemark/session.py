"""Session builder for tests, the bench and small installations."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once an application. Operators that run Python call it themselves, so
    it need not be installed there."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
    atexit.register(shutil.rmtree, at.parent, ignore_errors=True)  # the driver serves it as long as it runs
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, Path("tidemark") / p.relative_to(home))
    sc.addPyFile(str(at))
    _shipped.add(sc.applicationId)


def build(app: str = "tidemark", cores: int | str = "*", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session in UTC with adaptive execution.

    On a cluster, pass an existing session to the operators instead; they read
    every setting they need from it and change none.
    """
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark
