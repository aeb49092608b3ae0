"""What a session needs before functions run over Arrow batches in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of one Arrow batch handed to Python, so that a few thousand long texts don't come at once.
BATCH_BYTES = 8 << 20

_shipped: set[str] = set()


def bound_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Bound Arrow batches by bytes as well as by rows, unless the session already has a smaller bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > size:
        spark.conf.set(key, str(size))


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once for each application, so that it need not be installed there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="rankloom-"), "rankloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def ready(spark: SparkSession) -> None:
    bound_batches(spark)
    ship(spark)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` over enough partitions for every core, however few bytes it has: for rows that take long each."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *columns)
