"""Aggregates of the reports: nearest-rank percentiles, latency and score summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nearest_rank(q: float, c: str) -> Column:
    """The smallest value with at least q of all values at or below it; null over nothing."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY `{c}`)")


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def latency_summary(c: str) -> list[Column]:
    return [F.count(c).alias("n"), or_zero(nearest_rank(0.5, c)).alias("p50"), or_zero(nearest_rank(0.95, c)).alias("p95"), or_zero(F.max(c)).alias("max")]


def score_summary(c: str) -> list[Column]:
    """p50 is the lower median."""
    return [F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), F.round(F.avg(c), 6).alias("mean"), nearest_rank(0.5, c).alias("p50"), nearest_rank(0.95, c).alias("p95")]


def share(condition: Column) -> Column:
    return F.round(F.count_if(condition) / F.count(F.lit(1)), 6)


def headroom(value: float, limit: float) -> dict:
    return {"value": value, "limit": limit, "passed": value <= limit, "headroom": limit / value if value > 0 else float("inf")}
