"""Exact cosine retrieval, batch first, and the semantic filters."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import identifiers
from ..functions.vectors import dot, is_valid, literal, normalised, unit

SCORE_FLOOR, RELATIVE_FLOOR = 0.30, 0.70


def valid_vectors(vectors: DataFrame, size: int, vector: str = "vector") -> DataFrame:
    return vectors.filter(is_valid(F.col(vector), size))


def compatible(vectors: DataFrame, generation: int, versions: dict[str, str]) -> DataFrame:
    """Rows of the generation with the given version columns."""
    rows = vectors.filter(F.col("generation") == generation)
    for name, value in versions.items():
        rows = rows.filter(F.col(name) == value)
    return rows


def ready(metadata: dict, sections: int, complete: int, generation: int, fingerprint: str) -> str | None:
    """None if the vector table can serve the generation, else the reason why not."""
    if metadata.get("state") != "ready":
        return metadata.get("reason") or "NOT_READY"
    if metadata.get("semantic_generation") != generation:
        return "GENERATION_MISMATCH"
    if metadata.get("fingerprint") != fingerprint:
        return "FINGERPRINT_MISMATCH"
    return None if complete == sections else "INCOMPLETE"


def cosine(vectors: DataFrame, query: list[float], where: Column | None = None, limit: int | None = None, digits: int | None = None) -> DataFrame:
    """section_id, vector_score of one query against all vectors in scope, best first up to `limit`."""
    rows = vectors if where is None else vectors.filter(where)
    score = dot(F.col("vector"), literal(unit(query)))
    rows = rows.select("section_id", (F.round(score, digits) if digits else score).alias("vector_score"))
    return rows.orderBy(F.desc("vector_score"), "section_id").limit(limit) if limit else rows


#: Scores (rows x queries) that one matrix product of a task gives, about: 32 MB of float64.
SCORES_AT_ONCE = 1 << 22


def cosine_batch(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6, block: int = 4096) -> DataFrame:
    """query_id, section_id, vector_score, vector_rank: the best k rows (vectors of unit length) for each of many queries (query_id, vector).

    Queries go in blocks of a stated size, each broadcast once: one scan of the vectors
    serves a block by matrix products of at most SCORES_AT_ONCE scores, each of which yields
    the best k of its rows for each query, so what is shuffled is k rows for each query and
    product. Scores
    are rounded before the ranks, so equal vectors tie on their id. Vectors that are null,
    of another size or not finite are no results; as queries they are errors.
    """
    spark, parts = vectors.sparkSession, []
    rows = queries.select(F.col("query_id").cast("long").alias("query_id"), "vector").orderBy("query_id").toLocalIterator()
    while held := list(islice(rows, block)):
        own = np.array([unit(list(r["vector"])) for r in held])
        shared = spark.sparkContext.broadcast((np.array([r["query_id"] for r in held]), own))
        parts.append(valid_vectors(vectors, own.shape[1]).select(F.col("section_id").cast("string").alias("section_id"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(_best_of_batch(shared, k, digits), "query_id long, section_id string, vector_score double"))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, section_id string, vector_score double, vector_rank int")
    scored = reduce(DataFrame.unionByName, parts).withColumn("vector_score", F.round("vector_score", digits))
    order = Window.partitionBy("query_id").orderBy(F.desc("vector_score"), "section_id")
    return scored.withColumn("vector_rank", F.row_number().over(order)).filter(F.col("vector_rank") <= k)


def _best_of_batch(shared, k: int, digits: int):
    """A task's work: of each batch, the rows that may be among the best k (ties after rounding included)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        for batch in batches:
            lists = batch.column("vector")
            if not len(lists):
                continue
            whole = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
            step = max(k, SCORES_AT_ONCE // max(len(ids), 1))
            for lo in range(0, len(whole), step):
                m = whole[lo : lo + step]
                scores = m @ q.T
                least = np.partition(scores, len(m) - k, axis=0)[len(m) - k] if len(m) > k else np.full(len(ids), -np.inf)
                row, query = np.nonzero(scores >= least - 10.0**-digits)
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(ids[query], pa.int64()), "section_id": batch.column("section_id").take(pa.array(lo + row)), "vector_score": pa.array(scores[row, query], pa.float64())})

    return run


def normalise_vectors(vectors: DataFrame, vector: str = "vector") -> DataFrame:
    return vectors.withColumn(vector, normalised(F.col(vector)).cast("array<float>"))


def relative_floor(semantic: DataFrame, lexical: DataFrame, floor: float | None = SCORE_FLOOR, relative: float | None = RELATIVE_FLOOR) -> DataFrame:
    """Hits that are lexical too, or reach max(floor, relative * best score of a lexical hit).

    Without a lexical hit all stay; lexical hits are exempt here, not from the absolute
    floor, which the fusion applies to all.
    """
    if relative is None:
        return semantic
    marked = semantic.join(lexical.select("section_id", F.lit(True).alias("is_lexical")), "section_id", "left")
    best = marked.filter("is_lexical").agg(F.max("vector_score")).first()[0]
    if best is None:
        return semantic
    least = relative * best if floor is None else max(floor, relative * best)
    return marked.filter(F.col("is_lexical").isNotNull() | (F.col("vector_score") >= least)).drop("is_lexical")


def same_ticket(rows: DataFrame, query_ids: list[str], text: Column) -> DataFrame:
    """Rows that mention no identifier other than the query's; all rows if it has none."""
    if not query_ids:
        return rows
    own = F.array(*[F.lit(i.lower()) for i in query_ids])
    return rows.filter(F.size(F.array_except(identifiers(text), own)) == 0)
