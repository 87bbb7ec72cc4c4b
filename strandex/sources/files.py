"""Small text files in any file system that Spark knows: pointers, checkpoints, artifacts."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a file, or None if there is none."""
    p, fs = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write the file whole or not at all: beside its place first, then a rename over it."""
    jvm = spark.sparkContext._jvm
    target, fs = _at(spark, path)
    fs.mkdirs(target.getParent())
    held, _ = _at(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(held)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    context.rename(fs.makeQualified(held), fs.makeQualified(target), how)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no folder."""
    p, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.delete(p, True)


def existing(spark: SparkSession, paths) -> list[str]:
    """Those of a few paths that are files."""
    out = []
    for path in sorted(paths):
        p, fs = _at(spark, path)
        if fs.exists(p) and not fs.getFileStatus(p).isDirectory():
            out.append(path)
    return out


def create_new(spark: SparkSession, path: str, text: str = "") -> bool:
    """Make a file that is not there yet; False if it is. Of several callers one succeeds."""
    p, fs = _at(spark, path)
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if fs.exists(p):
            return False
        raise e
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


@contextmanager
def lock(spark: SparkSession, path: str, wait: float = 60.0, stale: float = 600.0) -> Iterator[None]:
    """Hold the file `path` for a short block; one that is older than `stale` seconds was left by a lost process and goes."""
    p, fs = _at(spark, path)
    end = time.monotonic() + wait
    while not create_new(spark, path):
        if fs.exists(p) and time.time() - fs.getFileStatus(p).getModificationTime() / 1000 > stale:
            fs.delete(p, False)
        elif time.monotonic() > end:
            raise TimeoutError(f"{path} is held")
        else:
            time.sleep(0.1)
    try:
        yield
    finally:
        fs.delete(p, False)
