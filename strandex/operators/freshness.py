"""Comparisons of an index with its live sources: staleness, diffs, upserts, deletions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fresh_hits(hits: DataFrame, live: DataFrame) -> DataFrame:
    """Hits whose source still has the content that was indexed (path and content_hash)."""
    return hits.join(live.select("path", "content_hash"), ["path", "content_hash"], "left_semi")


def refresh_set(hits: DataFrame, live: DataFrame) -> DataFrame:
    """Paths of hits whose source is gone or has changed."""
    return hits.join(live.select("path", "content_hash"), ["path", "content_hash"], "left_anti").select("path").distinct()


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change: insert, update, delete or unchanged; a file is unchanged if root and content are."""
    a = old.select("path", F.struct("root_id", "content_hash").alias("was"))
    b = new.select("path", F.struct("root_id", "content_hash").alias("now"))
    change = F.when(F.col("was").isNull(), "insert").when(F.col("now").isNull(), "delete").when(F.col("was") == F.col("now"), "unchanged").otherwise("update")
    return a.join(b, "path", "full_outer").select("path", change.alias("change"))


def same_sources(a: DataFrame, b: DataFrame) -> bool:
    x, y = a.select("path", "content_hash"), b.select("path", "content_hash")
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def delete_by(rows: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def needs_embedding(sections: DataFrame, vectors: DataFrame, versions: list[str]) -> DataFrame:
    """Sections without a vector of their present content, versions and size."""
    return sections.join(vectors, ["section_id", "content_hash", *versions], "left_anti")
