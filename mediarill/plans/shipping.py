"""Make this package importable in Python workers of clusters that don't have it installed, and their batches small."""

from __future__ import annotations

import os
import tempfile
import zipfile
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Rows that go to a Python worker at once, where the session has Spark's default of 10,000: rows here hold whole texts.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS = 1000
#: Bytes of such a batch, where the session has Spark's default of 64 MB; texts may be very long.
BYTES, MOST_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once an application; batches for Python hold ``ROWS`` rows and ``MOST_BYTES`` unless the session says otherwise."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, str(ROWS))
    if spark.conf.get(BYTES) in ("64MB", "67108864b", "67108864"):
        spark.conf.set(BYTES, str(MOST_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    made = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{top.name}.zip")
    with zipfile.ZipFile(made, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(made)
    _shipped.add(app)


def shipped(query):
    """``query(spark, ...)`` with the package sent ahead."""

    @wraps(query)
    def call(spark, *args, **more):
        ship(spark)
        return query(spark, *args, **more)

    return call
