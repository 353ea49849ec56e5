"""Intermediate tables in the folder that the whole cluster shares.

``stage`` cuts lineage by writing a Parquet table and reading it back, so a lost
executor costs a re-read and never a recomputation of what came before.  The
folder is the one named in ``spark.checkpoint.dir``.  Where that is unset, a session
whose executors are this very process (master ``local``) gets a folder of its own, and
any other is refused: machines would not see each other's files.

Results read staged tables lazily, so tables stay until ``drop_staged`` is called or
the driver's Python ends; either deletes all that this application has staged.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_registered: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, without a trailing slash."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        return os.path.join(tempfile.gettempdir(), "pairloom-local")
    raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/pairloom/{spark.sparkContext.applicationId}"


def drop_staged(spark: SparkSession) -> None:
    """Delete the tables staged by this application; results that read them can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    folder = _own_folder(spark)
    if folder not in _registered:
        _registered.add(folder)
        atexit.register(_at_end, spark)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def _at_end(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may be stopped already
        drop_staged(spark)


def stage(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and return it as read back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, size: str = "8m") -> None:
    """Let Spark cut what it sends to Python by bytes as well as rows, unless the session says otherwise: texts may be long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, size)
