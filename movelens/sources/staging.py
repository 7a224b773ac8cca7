"""Cutting lineage by writing a table to the shared checkpoint folder.

A staged table survives the loss of any executor, is computed once however
often it is read, and carries real file sizes, so the optimizer broadcasts it
only when it is small.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def stage_root(spark: SparkSession) -> str:
    """Folder for staged tables: the session's ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; on a cluster the
    folder has to be shared, so an unset setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="movelens-stage-")
    return _LOCAL_DIRS[app]


def stage(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet under :func:`stage_root` and read it back."""
    spark = df.sparkSession
    path = f"{stage_root(spark).rstrip('/')}/movelens/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_path = path
    return staged


def union_staged(parts: Sequence[DataFrame]) -> DataFrame:
    """The union of staged tables, to be removed as one."""
    out = reduce(DataFrame.unionByName, parts) if len(parts) > 1 else parts[0].select("*")
    out._staged_parts = tuple(parts)
    return out


def unstage(*tables: DataFrame | None) -> None:
    """Removes staged tables that nothing will read any more; other tables and None are left alone."""
    for df in tables:
        unstage(*getattr(df, "_staged_parts", ()))
        path = getattr(df, "_staged_path", None)
        if path is not None:
            jvm = df.sparkSession.sparkContext._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def free_shuffles(spark: SparkSession) -> None:
    """Has the driver collect garbage, so that Spark removes the shuffle files of steps that are done.

    Spark does so by itself only when the driver's memory runs short, or every half hour. What ran last is let go a
    moment after its end, so the second collection finds it.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.1)
