"""Places that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset in a local session, as in tests, a temporary folder that becomes it."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if at is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="strandex-"))
        at = sc.getCheckpointDir()
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of whole texts that JVM and Python exchange at once: both hold a few such batches for each task.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2500", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is planned within the block exchanges small batches; the session's settings are as before at its end."""
    before = {k: spark.conf.get(k, None) for k in BATCH}
    try:
        for k, v in BATCH.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def stored(df: DataFrame, path: str) -> DataFrame:
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: lineage ends there, and lost executors lose nothing."""
    return stored(df, new_path(df.sparkSession, name))


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables that are needed until a result is written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def written(self, df: DataFrame, name: str) -> DataFrame:
        return stored(df, f"{self.path}/{name}-{uuid.uuid4().hex}")


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[Scratch]:
    """Its tables are removed at the end of the block, so what is to last must be written elsewhere by then."""
    path = new_path(spark, name)
    try:
        yield Scratch(spark, path)
    finally:
        remove(spark, path)
