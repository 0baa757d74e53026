"""Session helpers: where intermediate tables live and how they are written.

Lineage is cut with tables written under ``spark.checkpoint.dir`` (a folder all
executors share), never with local checkpoints: an executor may be lost at any
time and the next stage must still find its input.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, taken from ``spark.checkpoint.dir``.

    Only where that is unset and the master is local (tests) a temporary folder
    is made; on a cluster an unset folder is an error, because a machine-local
    one would lose data with its machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if base:
        folder = f"{base.rstrip('/')}/{app}"
        if app not in _LOCAL:
            # the application's tables go with it
            _LOCAL[app] = folder
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            fs.mkdirs(where)
            fs.deleteOnExit(where)
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="tracksift-")
        atexit.register(shutil.rmtree, _LOCAL[app], True)
    return f"file://{_LOCAL[app]}"


def new_path(spark: SparkSession, label: str) -> str:
    """A name in the shared folder that nothing has yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    scan = spark.read.schema(df.schema).parquet(path)
    scan._tracksift_path = path
    return scan


def discard(*tables: DataFrame | None) -> None:
    """Remove written tables that no result reads any more (results of
    ``materialize`` themselves; anything else is left alone)."""
    for df in tables:
        path = getattr(df, "_tracksift_path", None)
        if path:
            spark = df.sparkSession
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_parts(spark: SparkSession, at_least: int = 1) -> int:
    """Partitions for an explicit repartition: the session's setting, which the
    deployment sizes to its data."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
