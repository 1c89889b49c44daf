"""Sessions: the package's code on the executors, and settings for tests."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROWS_PER_BATCH = "2000"
BATCH_BYTES = 16 << 20
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).parent
    fd, name = tempfile.mkstemp(suffix=".zip", prefix="loupe-")  # Spark copies it to the executors
    os.close(fd)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)


def small_batches(spark: SparkSession) -> None:
    """For operators with Python in them: the workers have this package, and Arrow batches of whole texts fit beside the JVM in an executor.

    Batches end by bytes, also where rows are few and large; a number of rows or
    bytes that the user has set lower stays.
    """
    ship(spark)
    for key, most in ((_BATCH_ROWS, int(ROWS_PER_BATCH)), (_BATCH_BYTES, BATCH_BYTES)):
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def local(cores: int = 8, partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("loupe").config("spark.sql.shuffle.partitions", partitions).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
