"""Single-file operations through the Hadoop file system of the session."""

from __future__ import annotations

from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    return target.getFileSystem(conf), target


def qualified(spark: SparkSession, path: str) -> str:
    """The path as file listings spell it, with scheme and no slash at the end."""
    fs, target = _file_system(spark, path)
    return fs.makeQualified(target).toString().rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _file_system(spark, path)
    return fs.exists(target)


class Found(NamedTuple):
    path: str
    modified_ms: int
    is_folder: bool


def matching(spark: SparkSession, pattern: str) -> list[Found]:
    """What there is by a pattern, possibly nothing. Folders are not looked into."""
    fs, target = _file_system(spark, pattern)
    return [
        Found(s.getPath().toString(), s.getModificationTime(), s.isDirectory())
        for s in fs.globStatus(target) or []
    ]


def children(spark: SparkSession, path: str) -> list[tuple[str, bool, int, int]]:
    """(name, is a folder, milliseconds, bytes) of what is in a folder; nothing if there is none."""
    fs, target = _file_system(spark, path)
    if not fs.exists(target):
        return []
    return [
        (s.getPath().getName(), s.isDirectory(), s.getModificationTime(), s.getLen()) for s in fs.listStatus(target)
    ]


def total_bytes(spark: SparkSession, path: str) -> int:
    fs, target = _file_system(spark, path)
    return fs.getContentSummary(target).getLength()


def delete(spark: SparkSession, path: str) -> bool:
    fs, target = _file_system(spark, path)
    return fs.delete(target, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, target = _file_system(spark, path)
    stream = fs.create(target, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file that is not there yet; says whether it was this call that made it.

    Which of two writers is first is decided by the store, if it can (HDFS and local
    folders; object stores only with conditional writes).
    """
    fs, target = _file_system(spark, path)
    try:
        stream = fs.create(target, False)
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName() or "already exists" in str(error.java_exception):
            return False
        raise
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    fs, target = _file_system(spark, path)
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()
