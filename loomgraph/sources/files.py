"""Files of any Hadoop file system: copy in, delete, list, and the user's home."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def copy_from_local(spark: SparkSession, local: str, target: str, progress: Callable[[str, int], None] | None = None, piece: int = 8 << 20) -> None:
    """Copy a local file or folder; ``progress`` is told a file's name and its bytes so far after each piece."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source = jvm.org.apache.hadoop.fs.Path(f"file://{local}" if local.startswith("/") else local)
    here = source.getFileSystem(conf)
    path, there = _at(spark, target)

    def copy(origin, goal) -> None:
        status = here.getFileStatus(origin)
        if status.isDirectory():
            there.mkdirs(goal)
            for x in here.listStatus(origin):
                copy(x.getPath(), jvm.org.apache.hadoop.fs.Path(goal, x.getPath().getName()))
            return
        done, reader, writer = 0, here.open(origin), there.create(goal, True)
        try:
            while done < status.getLen():
                done += jvm.org.apache.commons.io.IOUtils.copyLarge(reader, writer, 0, min(piece, status.getLen() - done))
                if progress:
                    progress(goal.toString(), done)
        finally:
            reader.close()
            writer.close()

    copy(source, path)


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder with all it holds; False if there was none."""
    p, fs = _at(spark, path)
    return bool(fs.delete(p, True))


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern, sorted."""
    p, fs = _at(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(p) or [])


def user_name(spark: SparkSession) -> str:
    """The last part of the home folder's path."""
    _, fs = _at(spark, "/")
    return fs.getHomeDirectory().getName()
