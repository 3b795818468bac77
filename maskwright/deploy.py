"""Make this package known to the Python workers of any cluster."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


#: Rows of a batch for Python; they are texts, so a batch of Spark's 10,000 would be tens of megabytes, several times over.
BATCH_ROWS = 2_048


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once per application; Spark serves the archive from the driver.  Larger batches for Python become ``BATCH_ROWS``."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(batch)) <= BATCH_ROWS:
        spark.conf.set(batch, str(BATCH_ROWS))
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        handle, path = tempfile.mkstemp(prefix="maskwright-", suffix=".zip")
        os.close(handle)
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(path)
        atexit.register(lambda: os.path.exists(path) and os.unlink(path))
        _shipped.add(sc.applicationId)
    return spark
