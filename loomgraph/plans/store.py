"""Scratch tables in the folder that the driver and all executors share.

Loops and multi-pass operators cut their lineage by writing a table and reading it
back.  The folder is the one the cluster names in ``spark.checkpoint.dir``; only a
single-process local session without that setting gets one of its own.  Written
tables survive the loss of any executor, unlike a local checkpoint.
"""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for scratch tables, from the session's own setting."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), "checkpoints", spark.sparkContext.applicationId)
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/loomgraph-{spark.sparkContext.applicationId}"


_scopes: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the tables materialized inside when the block ends, but for those it was told to keep.

    The block gets the function that keeps a table (for an enclosing block, if there is one).
    Whatever the block hands out may read kept tables only.
    """
    made: list[str] = []
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._scratch_path)
        return df

    _scopes.append(made)
    try:
        yield keep
    finally:
        _scopes.pop()
        for path in made:
            if path not in kept:
                _delete(spark, path)
        if _scopes:
            _scopes[-1].extend(kept)
        free_shuffles(spark)


def materialize(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back (lineage ends there)."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    if _scopes:
        _scopes[-1].append(path)
    return back


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared scratch folder, for files of any format."""
    return f"{_own_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and nothing will read any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        _delete(df.sparkSession, path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this application wrote; call it once its results are stored elsewhere."""
    _delete(spark, _own_folder(spark))


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver find shuffles that no plan needs any more, so that executors drop their files.

    Spark does this whenever the driver collects its garbage, which on an idle driver can take long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once an application, for the functions that run there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    name = os.path.basename(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp()  # the driver serves the archive from here until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, name), "zip", top, name))
    _shipped.add(app)
