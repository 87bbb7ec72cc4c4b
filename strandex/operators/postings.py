"""The inverted index as a table: a row for each term, field and section, with positions.

Rows are written in buckets of their term, sorted by term, so a query reads the files of
its terms' buckets only, and of those the row groups whose term range fits. Within a
bucket, rows are dealt by section, so that a term that every section has is many files
and many tasks, never one.

`matches` gathers what a query needs: a row for each section with one of its words and
the places of each word, a group of at most (words of the query x fields) rows. Lanes,
statistics and guard atoms of `lexical` take it in the place of the whole index.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a bucket should hold, and that a task writes of a bucket that holds more.
BUCKET_ROWS, MOST_BUCKETS = 4_000_000, 4096
SCHEMA = "term string, field string, section_id string, root_id string, path string, n_words int, places array<int>"


def postings(indexed: DataFrame) -> DataFrame:
    """Rows of SCHEMA of an indexed table (heading_words, text_words, n_words), without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [pa.string()] * 5
        kinds = pa.schema(list(zip(("term", "field", "section_id", "root_id", "path", "n_words", "places"), [*texts, pa.int32(), pa.list_(pa.int32())], strict=True)))
        for batch in batches:
            keys = [batch.column(c).to_pylist() for c in ("section_id", "root_id", "path", "n_words")]
            for field in ("heading", "text"):
                for *own, words in zip(*keys, batch.column(f"{field}_words").to_pylist(), strict=True):
                    if not words:
                        continue
                    terms, which = np.unique(np.array(words, object).astype(str), return_inverse=True)
                    ends = np.append(0, np.cumsum(np.bincount(which)))
                    places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.argsort(which, kind="stable"), pa.int32()))
                    same = [pa.array([v] * len(terms), t) for v, t in zip([field, *own], [*texts[1:], pa.int32()], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(terms.tolist(), pa.string()), *same, places], schema=kinds)

    return indexed.select("section_id", "root_id", "path", "n_words", "heading_words", "text_words").mapInArrow(run, SCHEMA)


def postings_size(rows: DataFrame) -> dict:
    """rows of the table, and words of all sections."""
    got = rows.agg(F.count(F.lit(1)), F.sum(F.size("places"))).first()
    return {"rows": got[0], "words": got[1] or 0}


def buckets_for(rows: int) -> int:
    """A power of two from 4 to MOST_BUCKETS."""
    return min(MOST_BUCKETS, 1 << max(2, (rows // BUCKET_ROWS).bit_length()))


def bucket(term, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def bucket_of(term: str, buckets: int) -> int:
    """The same on the driver: Spark's xxhash64 is XXH64 with seed 42, as a signed number."""
    h = xxhash.xxh64_intdigest(term.encode(), 42)
    return (h - (h >> 63 << 64)) % buckets


def write(rows: DataFrame, path: str, buckets: int, parts: int = 1) -> None:
    """The table at `path`; parts: tasks that share the rows of a bucket, by section."""
    own = rows.withColumn("bucket", bucket("term", buckets))
    dealt = own.repartition(buckets * parts, "bucket", F.pmod(F.xxhash64("section_id"), F.lit(parts)))
    dealt.sortWithinPartitions("bucket", "term", "section_id").write.mode("overwrite").partitionBy("bucket").parquet(path)


def matches(table: DataFrame, words: Iterable[str], rows: int, mean_length: float, buckets: int | None = None) -> DataFrame:
    """section_id, root_id, path, n_words, places (map of `field:word` to positions) of the sections that hold a word.

    rows and mean_length are those of the whole index, for the scores. With `buckets`,
    the number that the table was written with, the words' buckets are computed on the
    driver, so the scan prunes its partitions.
    """
    words = sorted(set(words))
    some = table.filter(F.col("term").isin(words) if words else F.lit(False))
    if words and buckets:
        some = some.filter(F.col("bucket").isin(sorted({bucket_of(w, buckets) for w in words})))
    entry = F.struct(F.concat_ws(":", "field", "term"), "places")
    grouped = some.groupBy("section_id", "root_id", "path", "n_words").agg(F.map_from_entries(F.collect_list(entry)).alias("places"))
    return grouped.withColumns({"corpus_rows": F.lit(rows).cast("long"), "corpus_mean": F.lit(float(mean_length))})
