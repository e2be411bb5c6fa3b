"""Single files and folders of any store that Spark's readers know: small texts, existence, names, copies."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    """The store's handle and the path in it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def whole(spark: SparkSession, folder: str) -> bool:
    """Whether a table was written to its end."""
    return exists(spark, f"{folder}/_SUCCESS")


def names(spark: SparkSession, folder: str, kind: str | None = None) -> list[str]:
    """Names in a folder, sorted; of folders or files only, if ``kind`` says so. A missing folder has none."""
    fs, p = _at(spark, folder)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if kind is None or s.isDirectory() == (kind == "folder"))


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file; nothing if it is not there."""
    if not exists(spark, path):
        return None
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _at(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def copy(spark: SparkSession, source: str, target: str) -> bool:
    """Copy a file; one that is there already is left alone."""
    a, p = _at(spark, source)
    b, q = _at(spark, target)
    if b.exists(q):
        return False
    return spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, spark._jsc.hadoopConfiguration())
