"""Tables that cut a plan's lineage, kept in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
#: Folders written so far, by application.
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, a temporary one in local mode, which has no other
    machine; on a cluster RuntimeError, as executors couldn't see a folder of the driver's."""
    path = spark.conf.get(_KEY, None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"{_KEY} must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="rankloom-")
        spark.conf.set(_KEY, path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    app = spark.sparkContext.applicationId
    if app not in _written:
        _written[app] = []
        atexit.register(_clean, spark, app)
    _written[app].append(path)
    return path


def keep(df: DataFrame, name: str, by: str | None = None, group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder, with a folder for each value of ``by`` if given, and read it from there.

    ``group_bytes`` bounds the row groups of tables with large values: a reader takes up to 4,096 rows of a group at once,
    however large they are. Sizes are checked every few rows.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    write = df.write.partitionBy(by) if by else df.write
    if group_bytes:
        write = write.options(**{"parquet.block.size": group_bytes, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 4, "parquet.enable.dictionary": "false"})
    write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared one."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean(spark: SparkSession) -> int:
    """Delete all tables kept so far by this application, whose results must have been read or written by then; how many there were.

    Called by itself when the driver's Python ends while its session still runs.
    """
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        drop(spark, p)
    return len(paths)


def _clean(spark: SparkSession, app: str) -> None:
    try:
        if spark.sparkContext._jsc is not None and spark.sparkContext.applicationId == app:
            clean(spark)
    except Exception:  # the session has ended; nothing can be reached any more
        pass
