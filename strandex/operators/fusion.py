"""Fusion of a lexical and a semantic lane: admission, reciprocal ranks, protected hits.

Both lanes have `query_id, section_id` and their rank; every window is by query, over at
most two lanes of candidates each. Admission goes through the lanes in one order
(interleaved, lexical first; or all of the lexical lane first if the query is guarded) and
stops at the first new section beyond the bound. A section that is admitted from the
lexical lane gains the credit of its semantic row if that comes before the stop; one that
is admitted from the semantic lane never gains lexical credit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANK_CONSTANT = 60
_LAST = 201


def admit(lexical: DataFrame, semantic: DataFrame, bound: int, interleave: bool) -> DataFrame:
    """query_id, section_id, lexical_rank, vector_rank, vector_score, first_lane of admitted sections."""
    by_query = Window.partitionBy("query_id")
    a = lexical.select("query_id", "section_id", F.lit(0).alias("lane"), F.col("lexical_rank").alias("rank"), F.lit(None).cast("double").alias("vector_score"))
    b = semantic.select("query_id", "section_id", F.lit(1).alias("lane"), F.col("vector_rank").alias("rank"), F.col("vector_score").cast("double"))
    rows = a.unionByName(b)
    rows = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("query_id", "lane").orderBy("rank", "section_id")))
    order = ["ordinal", "lane"] if interleave else ["lane", "ordinal"]
    rows = rows.withColumn("pos", F.row_number().over(by_query.orderBy(*order)))
    rows = rows.withColumn("first", F.min("pos").over(Window.partitionBy("query_id", "section_id")))
    running = by_query.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("new", F.sum((F.col("pos") == F.col("first")).cast("int")).over(running))
    stop = F.min(F.when((F.col("pos") == F.col("first")) & (F.col("new") > bound), F.col("pos"))).over(by_query)
    rows = rows.withColumn("stop", stop).filter(F.col("stop").isNull() | (F.col("pos") < F.col("stop")))
    per = rows.groupBy("query_id", "section_id").agg(
        F.min_by("lane", "pos").alias("first_lane"),
        F.max(F.when(F.col("lane") == 0, F.col("rank"))).alias("any_lexical"),
        F.max(F.when(F.col("lane") == 1, F.col("rank"))).alias("vector_rank"),
        F.max("vector_score").alias("vector_score"),
    )
    return per.withColumn("lexical_rank", F.when(F.col("first_lane") == 0, F.col("any_lexical"))).drop("any_lexical")


def fuse(lexical: DataFrame, semantic: DataFrame, bound: int, limit: int, guarded: bool = False, balanced: bool = True, protected: DataFrame | None = None, floor: float | None = None) -> DataFrame:
    """The ranked union: query_id, section_id, rank, fused_score, lexical_rank, vector_rank, vector_score, lane, guard_reason.

    protected: query_id, section_id, atom, primary_rank; a lexical hit among them comes
    before all others. Semantic rows below `floor` take no part, not even in the admission.
    """
    if floor is not None:
        semantic = semantic.filter(F.coalesce("vector_score", F.lit(0.0)) >= floor)
    rows = admit(lexical, semantic, bound, balanced and not guarded)
    part = lambda c: F.coalesce(1.0 / (RANK_CONSTANT + F.col(c)), F.lit(0.0))
    rows = rows.withColumn("fused_score", part("lexical_rank") + part("vector_rank"))
    lanes = F.array(F.when(F.col("lexical_rank").isNotNull(), "lexical"), F.when(F.col("vector_rank").isNotNull(), "semantic"))
    rows = rows.withColumn("lane", F.array_join(lanes, "+"))
    if protected is None:
        rows = rows.withColumns({"atom": F.lit(None).cast("int"), "primary_rank": F.lit(None).cast("int")})
    else:
        own = protected.filter("primary_rank IS NOT NULL").select("query_id", "section_id", "atom", "primary_rank")
        rows = rows.join(own, ["query_id", "section_id"], "left")
        rows = rows.withColumn("atom", F.when(F.col("lexical_rank").isNotNull(), F.col("atom")))
    ranks = [F.coalesce("lexical_rank", F.lit(_LAST)), F.coalesce("vector_rank", F.lit(_LAST)), F.col("section_id")]
    rest = [F.col("lexical_rank").isNull(), *ranks] if guarded else [F.desc("fused_score"), *ranks]
    first = [F.when(F.col("atom").isNotNull(), F.col(c)) for c in ("lexical_rank", "primary_rank", "atom")]
    by_query = Window.partitionBy("query_id")
    some = F.max(F.col("atom").isNotNull()).over(by_query)
    guard = F.when(F.col("atom").isNotNull(), F.concat(F.lit("protected:atom-"), F.col("atom"))).when(some, "not-protected:guard-active").otherwise("bypassed:no-protected-hit:candidate" if guarded else "not-applicable:candidate")
    order = by_query.orderBy(F.col("atom").isNull(), *first, *rest)
    out = rows.withColumns({"rank": F.row_number().over(order), "guard_reason": guard}).filter(F.col("rank") <= limit)
    return out.select("query_id", "section_id", "rank", "fused_score", "lexical_rank", "vector_rank", "vector_score", "lane", "guard_reason")
