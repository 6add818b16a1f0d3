"""Names and small texts in folders, on whatever file system Spark reads.

The driver asks the file system itself: no job is run for a listing or a small record.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def child_names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, hidden ones left out; none if it does not exist."""
    system, at = _located(spark, path)
    if not system.exists(at):
        return []
    names = [status.getPath().getName() for status in system.listStatus(at)]
    return [name for name in names if not name.startswith((".", "_"))]


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _located(spark, path)
    return system.exists(at)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None if there is none."""
    system, at = _located(spark, path)
    if not system.exists(at):
        return None
    stream = system.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file whole: it is renamed into place."""
    folder, _, name = path.rpartition("/")
    system, at = _located(spark, path)
    _, started = _located(spark, f"{folder}/_{name}")
    stream = system.create(started, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    system.delete(at, False)
    if not system.rename(started, at):
        raise OSError(f"could not write {path}")


def _located(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at
