"""Folders of the store that Spark writes to, whatever file system that is."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    """(file system, path) in Hadoop's terms."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def inside(spark: SparkSession, path: str, mark: str) -> list[tuple[int, str]]:
    """(n, path) of the folders ``mark=n`` in ``path``, in order of n."""
    store, at = _at(spark, path)
    if not store.exists(at):
        return []
    found = [x.getPath() for x in store.listStatus(at) if x.isDirectory() and x.getPath().getName().startswith(f"{mark}=")]
    return sorted((int(x.getName().split("=")[1]), x.toString()) for x in found)


def whole(spark: SparkSession, path: str) -> bool:
    """Whether a job has written ``path`` to its end."""
    store, at = _at(spark, f"{path}/_SUCCESS")
    return store.exists(at)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files in ``path``."""
    store, at = _at(spark, path)
    return store.getContentSummary(at).getLength() if store.exists(at) else 0


def remove(spark: SparkSession, path: str) -> None:
    store, at = _at(spark, path)
    store.delete(at, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is none."""
    store, at = _at(spark, path)
    if not store.exists(at):
        return None
    stream = store.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, which must not be there yet: two writers of one name cannot both succeed."""
    store, at = _at(spark, path)
    stream = store.create(at, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
