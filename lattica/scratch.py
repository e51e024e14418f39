"""Tables written to the cluster's shared folder, to cut lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_temporary: dict[str, str] = {}
_shared: set[str] = set()


def _remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared store when the driver's Python ends; the JVM may be gone by then."""
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)


def path(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``.

    Where that is unset, a temporary one, but only if driver and executors are one process: elsewhere executors would
    write to disks of their own. What an application has written here goes when it ends.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    app = context.applicationId
    if root:
        folder = f"{root.rstrip('/')}/lattica-{app}"
        if folder not in _shared:
            _shared.add(folder)
            atexit.register(_remove, spark, folder)
    else:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if app not in _temporary:
            _temporary[app] = tempfile.mkdtemp(prefix="lattica-")
            atexit.register(shutil.rmtree, _temporary[app], ignore_errors=True)
        folder = "file://" + _temporary[app]
    return f"{folder}/{uuid.uuid4().hex}"


def written(df: DataFrame, **options: str) -> DataFrame:
    """``df`` written as Parquet under ``path`` and read back."""
    where = path(df.sparkSession)
    df.write.options(**options).parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
