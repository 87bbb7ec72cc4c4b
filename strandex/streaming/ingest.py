"""Notes as a stream: each micro-batch of new or changed files is split and upserted.

A batch's sections go to a folder of its own, named by its number, so a batch that is
run again after a failure replaces itself; readers take the newest version of each path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import files, markdown

_SOURCE = "path string, modificationTime timestamp, length long, content binary"


def changed_notes(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """path, content, content_hash of the Markdown files below a folder, as they appear or change."""
    rows = spark.readStream.format("binaryFile").schema(_SOURCE).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(folder)
    rows = rows.filter(F.lower("path").rlike(r"\.(md|markdown)$"))
    return rows.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content", F.sha2("content", 256).alias("content_hash"), "modificationTime")


def ingest(spark: SparkSession, folder: str, store: str, root_id: str, section_bytes: int = 12000) -> StreamingQuery:
    """Write the sections of what is there and end; called again, only of what is new or changed since."""

    def write(batch: DataFrame, number: int) -> None:
        notes = batch.select("path", F.lit(root_id).alias("root_id"), "content")
        rows = markdown.split(notes, section_bytes).join(batch.select("path", F.col("modificationTime").alias("seen_at")), "path")
        rows.write.mode("overwrite").parquet(f"{store}/batches/batch={number}")

    return changed_notes(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", f"{store}/progress").trigger(availableNow=True).start()


def current(spark: SparkSession, store: str) -> DataFrame:
    """The sections of the newest version of each note; a note's versions meet by path, whose number is that of its changes."""
    if not files.names(spark, f"{store}/batches"):
        raise ValueError(f"nothing was ingested into {store}")
    rows = spark.read.parquet(f"{store}/batches")
    newest = F.max("batch").over(Window.partitionBy("path"))
    return rows.withColumn("newest", newest).filter("batch = newest").drop("newest", "batch")
