"""Answers and verdicts by injected functions, for each question and cutoff.

An answerer takes (question, memories, reference date) and returns text; a judge takes
(question, answer, response, evidence) and returns {"label": "CORRECT" or "WRONG",
"reasoning": ...}. Both are called in the tasks, with retries; an error scores 0 and stays.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ATTEMPTS, MEMORIES = 5, 200
_SCHEMA = "question_id string, k int, answer string, judgment string, reason string, score double, error string"


def retried(f: Callable, *args, attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep):
    """f(*args), tried again after 2, 4, 6 and 8 seconds; the last error is raised."""
    for n in range(attempts):
        try:
            return f(*args)
        except Exception:  # foreign code
            if n == attempts - 1:
                raise
            wait(2.0 * (n + 1))


def extract_answer(text: str) -> str:
    """What follows the last ANSWER:, or the whole text."""
    return text.rpartition("ANSWER:")[2].strip()


def verdict(payload) -> tuple[str, str]:
    label = str(payload.get("label", "")).upper() if isinstance(payload, dict) else ""
    if label not in ("CORRECT", "WRONG"):
        raise ValueError("a verdict needs the label CORRECT or WRONG")
    return label, str(payload.get("reasoning", ""))


def answered(questions: DataFrame, hits: DataFrame, cutoffs: tuple[int, ...], answerer: Callable, judge: Callable, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """question_id, k, answer, judgment, reason, score, error.

    questions: question_id, question, ground_truth, reference_date, evidence; hits:
    question_id, rank, memory, created_at. At most MEMORIES hits of a question count, so
    a question's group is bounded.
    """
    own = hits.filter(F.col("rank") <= min(MEMORIES, max(cutoffs))).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "memory", "created_at"))).alias("memories"))
    rows = questions.select("question_id", "question", "ground_truth", "reference_date", "evidence").join(own, "question_id", "left")

    def one(r, k: int) -> tuple:
        memories = [{"memory": m["memory"], "created_at": m["created_at"]} for m in (r.memories if r.memories is not None else []) if m["rank"] <= k]
        try:
            text = extract_answer(retried(answerer, r.question, memories, r.reference_date, wait=wait))
        except Exception:  # foreign code
            return (r.question_id, k, None, "ERROR", None, 0.0, "answerer_error")
        try:
            label, why = retried(lambda: verdict(judge(r.question, r.ground_truth, text, r.evidence)), wait=wait)
        except Exception:  # foreign code
            return (r.question_id, k, text, "ERROR", None, 0.0, "judge_error")
        return (r.question_id, k, text, label, why, float(label == "CORRECT"), None)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([one(r, k) for r in f.itertuples() for k in cutoffs], columns=[c.split()[0] for c in _SCHEMA.split(", ")])

    return rows.mapInPandas(run, _SCHEMA)
