"""Scoring of ranked hits against cases: per cutoff, per category, with gates and ablations.

hits: case_id, rank, path (and section_id); cases: case_id, category, expected, forbidden
(arrays of paths), abstain. Cases without hits stay: abstention is about emptiness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUTOFFS = (1, 2, 4, 8)


def score_cases(hits: DataFrame, cases: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """A row for each case and cutoff: n_hits, recall, precision, rr, n_forbidden, score, passed, complete.

    Recall counts distinct paths; precision counts rows, so two sections of one file
    lower it; rr is that of the first relevant row. A case without expected paths is right
    if it has no hits. The score is the recall, 0 with a forbidden hit; a case passes from
    0.5 on, and is complete if it abstains as it should, or finds all and nothing forbidden.
    """
    per = cases.select("case_id", "category", "expected", "forbidden", "abstain", F.explode(F.array(*[F.lit(k) for k in cutoffs])).alias("k"))
    rows = per.join(hits.select("case_id", "rank", "path"), "case_id", "left").withColumn("ok", F.array_contains("expected", F.col("path")))
    rows = rows.withColumn("seen", F.coalesce(F.col("rank") <= F.col("k"), F.lit(False)))
    got = rows.groupBy("case_id", "category", "k", "abstain", "expected").agg(
        F.count_if("seen").alias("n_hits"),
        F.countDistinct(F.when(F.col("seen") & F.col("ok"), F.col("path"))).alias("found"),
        F.min(F.when(F.col("seen") & F.col("ok"), F.col("rank"))).alias("first"),
        F.countDistinct(F.when(F.col("seen") & F.array_contains("forbidden", F.col("path")), F.col("path"))).alias("n_forbidden"),
    )
    size = F.size(F.array_distinct("expected"))
    recall = F.when(size > 0, F.col("found") / size)
    precision = F.when(size > 0, F.coalesce(F.col("found") / F.when(F.col("n_hits") > 0, F.col("n_hits")), F.lit(0.0)))
    rr = F.when(size > 0, F.coalesce(1.0 / F.col("first"), F.lit(0.0)))
    quiet = (F.col("n_hits") == 0) & (F.col("n_forbidden") == 0)
    score = F.when(size > 0, F.when(F.col("n_forbidden") > 0, 0.0).otherwise(recall)).otherwise(quiet.cast("double"))
    complete = F.when(F.col("abstain"), quiet).otherwise((F.col("found") == size) & (F.col("n_forbidden") == 0))
    named = {"recall": recall, "precision": precision, "rr": rr, "score": score, "passed": score >= 0.5, "complete": complete}
    return got.withColumns(named).select("case_id", "category", "k", "abstain", "n_hits", "recall", "precision", "rr", "n_forbidden", "score", "passed", "complete")


def case_failures(scores: DataFrame) -> DataFrame:
    """case_id, k, failure of the cases that are not complete."""
    why = F.when(F.col("abstain"), "expected abstention").otherwise(F.format_string("missing expected sources (recall %.3f)", "recall"))
    bad = F.when(F.col("n_forbidden") > 0, F.format_string("returned %d forbidden sources", "n_forbidden"))
    missing = F.when(F.col("abstain"), F.col("n_hits") > 0).otherwise(F.coalesce(F.col("recall"), F.lit(0.0)) < 1)
    parts = F.array_compact(F.array(F.when(missing, why), bad))
    return scores.filter("NOT complete").select("case_id", "k", F.array_join(parts, "; ").alias("failure"))


def gate_measures() -> list[Column]:
    """Means over the cases that expect something, and over those that abstain; 1 where there is none."""

    def mean(c):
        return F.round(F.coalesce(F.avg(c), F.lit(1.0)), 6)

    return [
        F.count(F.lit(1)).alias("n_cases"),
        mean("recall").alias("recall"),
        mean("precision").alias("precision"),
        mean("rr").alias("mrr"),
        mean(F.when(F.col("abstain"), F.col("passed").cast("double"))).alias("abstention_accuracy"),
        F.sum("n_forbidden").alias("forbidden"),
        mean(F.col("passed").cast("double")).alias("accuracy"),
        mean("score").alias("mean_score"),
    ]


def gates(scores: DataFrame) -> DataFrame:
    """k, category (null: all), measures: grouping sets ((k), (k, category))."""
    both = scores.groupingSets([("k",), ("k", "category")], "k", "category").agg(*gate_measures())
    return both.select("k", "category", "n_cases", "recall", "precision", "mrr", "abstention_accuracy", "forbidden", "accuracy", "mean_score")


def failures(gate: dict, thresholds: dict) -> list[str]:
    """Measures below their threshold (above it for counts of violations)."""
    return [m for m, t in thresholds.items() if (gate[m] > t if m.startswith("forbidden") else gate[m] < t)]


def gate_report(gated: DataFrame, thresholds: dict, k: int) -> dict:
    """Whether all cases together and each category pass at cutoff k; a category without thresholds of its own takes the global ones."""
    own = {m: t for m, t in thresholds.items() if not isinstance(t, dict)}
    rows = {r["category"]: r.asDict() for r in gated.filter(F.col("k") == k).collect()}  # a row for each category
    missed = {c: failures(r, thresholds.get("categories", {}).get(c, own) if c else own) for c, r in rows.items()}
    return {"passed": not any(missed.values()), "failures": {c or "all": m for c, m in missed.items() if m}}


def ablation_deltas(gated: DataFrame, active: str = "active") -> DataFrame:
    """policy, k, measure differences of each policy from the active one; gated: policy, k, measures."""
    names = ["recall", "precision", "mrr", "accuracy"]
    base = gated.filter(F.col("policy") == active).select("k", *[F.col(n).alias(f"base_{n}") for n in names])
    other = gated.filter(F.col("policy") != active)
    return other.join(base, "k").select("policy", "k", *[F.round(F.col(n) - F.col(f"base_{n}"), 6).alias(f"d_{n}") for n in names])


def containment(hits: DataFrame, targets: DataFrame) -> DataFrame:
    """Hits that contain a target's lines: same path, line_start <= t_start and line_end >= t_end."""
    t = targets.select("path", "evidence_id", F.col("line_start").alias("t_start"), F.col("line_end").alias("t_end"))
    return hits.join(t, "path").filter("line_start <= t_start AND line_end >= t_end")


def evidence_outcome(hits: DataFrame, targets: DataFrame, cutoffs: tuple[int, ...]) -> DataFrame:
    """question_id, k, recall over targets, precision over rows, mrr of hits with the question's evidence.

    A question without targets has recall 0 and stays. targets: question_id, path,
    evidence_id, line_start, line_end; a repeated reference counts in the recall's denominator.
    """
    sizes = targets.groupBy("question_id").agg(F.count("evidence_id").alias("n_targets"))
    t = targets.select("question_id", "path", "evidence_id", F.col("line_start").alias("t_start"), F.col("line_end").alias("t_end"))
    m = hits.join(t, ["question_id", "path"]).filter("line_start <= t_start AND line_end >= t_end").select("question_id", "section_id", "rank", "evidence_id")
    ks = F.explode(F.array(*[F.lit(k) for k in cutoffs])).alias("k")
    found = m.select("*", ks).filter("rank <= k").groupBy("question_id", "k").agg(F.countDistinct("evidence_id").alias("found"), F.countDistinct("section_id").alias("matched"), F.min("rank").alias("first"))
    rows = hits.select("question_id", "rank", ks).filter("rank <= k").groupBy("question_id", "k").agg(F.count(F.lit(1)).alias("n"))
    base = hits.select("question_id").union(targets.select("question_id")).distinct().select("question_id", ks)
    out = base.join(sizes, "question_id", "left").join(rows, ["question_id", "k"], "left").join(found, ["question_id", "k"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("question_id", "k", zero(F.col("found") / F.col("n_targets")).alias("recall"), zero(F.col("matched") / F.col("n")).alias("precision"), zero(1.0 / F.col("first")).alias("mrr"))


def abstention(records: DataFrame, group: str = "conv_id") -> DataFrame:
    """By group and overall: records (with errors), errors, abstained, false injection rate and mean hits."""
    agg = [
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.count_if(F.col("error").isNull() & (F.col("n_hits") == 0)).alias("abstained"),
        F.round(F.count_if(F.col("error").isNull() & (F.col("n_hits") > 0)) / F.count(F.lit(1)), 6).alias("false_injection_rate"),
        F.round(F.coalesce(F.avg(F.when(F.col("error").isNull(), F.col("n_hits"))), F.lit(0.0)), 6).alias("mean_hits"),
    ]
    return records.groupingSets([(group,), ()], group).agg(*agg).select(group, "n", "errors", "abstained", "false_injection_rate", "mean_hits")


def failure_reason(d: Column) -> Column:
    """Why a selection failed, from its diagnostics (struct of status, fallback, failure_reason); null if it did not."""
    text = lambda c: F.when(c != "", c)
    reason, status = text(d["failure_reason"]), text(d["status"])
    return (
        F.when(d.isNull(), "missing_diagnostics")
        .when(F.coalesce(d["status"], F.lit("")) != "ok", F.coalesce(reason, status, F.lit("selection_failed")))
        .when(~F.coalesce(~d["fallback"], F.lit(False)), F.coalesce(reason, F.lit("fallback")))
        .otherwise(reason)
    )


def abstention_outcomes(records: DataFrame, cutoffs: tuple[int, ...]) -> DataFrame:
    """question_id, k, injected, abstained, score, error of questions that have no answer; records: question_id, n_hits, diagnostics."""
    error = failure_reason(F.col("diagnostics"))
    rows = records.select("question_id", "n_hits", error.alias("reason"), F.explode(F.array(*[F.lit(k) for k in cutoffs])).alias("k"))
    injected = F.least(F.col("n_hits"), F.col("k"))
    right = F.when(F.col("reason").isNull(), injected == 0)
    return rows.select("question_id", "k", injected.alias("injected"), right.alias("abstained"), F.coalesce(right.cast("double"), F.lit(0.0)).alias("score"), F.when(F.col("reason").isNotNull(), "retrieval_error").alias("error"), "reason")


def retrieval_groups(outcomes: DataFrame) -> DataFrame:
    """k, category (null: all), total, relevant, recall, precision, mrr; missing measures count as 0. outcomes: category, k, relevant, recall, precision, mrr."""
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6).alias(c)
    own = outcomes.groupingSets([("k",), ("k", "category")], "k", "category")
    return own.agg(F.count(F.lit(1)).alias("total"), F.sum("relevant").alias("relevant"), mean("recall"), mean("precision"), mean("mrr"))


def answer_groups(outcomes: DataFrame) -> DataFrame:
    """k, category (null: all), total, correct, accuracy and mean score in per cent, errors. outcomes: category, k, score, error."""
    right = F.count_if(F.col("score") >= 0.5)
    own = outcomes.groupingSets([("k",), ("k", "category")], "k", "category")
    return own.agg(F.count(F.lit(1)).alias("total"), right.alias("correct"), F.round(100.0 * right / F.count(F.lit(1)), 6).alias("accuracy"), F.round(100.0 * F.avg("score"), 6).alias("mean_score"), F.count("error").alias("errors"))


def diagnostics_counts(records: DataFrame) -> dict:
    """Searches by mode, state and failure, and the fallbacks among them; records: retrieval_mode, semantic_state, failure_reason, fallback."""
    names = {"retrieval_mode": "retrieval_mode_counts", "semantic_state": "semantic_state_counts", "failure_reason": "failure_reason_counts"}
    rows = records.groupingSets([(n,) for n in names] + [()], *names).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("fallback", F.lit(False))).alias("fallbacks")).collect()
    whole = next((r for r in rows if r["g"] == 7), None)
    out: dict = {"searches": whole["n"] if whole else 0, "fallback_count": whole["fallbacks"] if whole else 0}
    for k, (name, title) in enumerate(names.items()):
        mine = {r[name]: r["n"] for r in rows if r["g"] == 7 - (4 >> k) and r[name]}
        out[title] = dict(sorted(mine.items()))
    return out
