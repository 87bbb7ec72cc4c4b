"""Runs of golden cases: search each case, score it, compare policies, check the gates."""

from __future__ import annotations

import json
import time
from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import latency_summary
from ..functions.text import multiset_fingerprint
from ..operators import evaluate
from ..operators.search import Policies
from ..sources.artifacts import Result, Run, done_cases, pending_cases, read_checkpoint
from ..sources.config import Config, fingerprint
from ..sources.store import Store
from .service import Engine, policy_diagnostics

CUTOFFS = (1, 2, 4, 8)
ABLATIONS = {
    "semantic_score_floor_disabled": {"semantic_score_floor": None},
    "relative_semantic_score_floor_disabled": {"relative_semantic_score_floor": None},
    "ticket_id_cross_reference_filter_disabled": {"ticket_id_cross_reference_filter": False},
    "balanced_admission_disabled": {"balanced_admission": False},
    "synonym_expansion_disabled": {"synonym_expansion": False},
    "relaxed_matching_disabled": {"relaxed_matching": False},
}
_HITS = "case_id string, rank int, path string, section_id string"


def search_case(engine: Engine, case, mode: str, limit: int, policies: Policies, base: str = "") -> dict:
    """hits and timings of one case (a row of `config.read_cases`), whose `deleted` sources count as gone while it is searched."""
    gone = {f"{base}/{p}" if base and not p.startswith("/") else p for p in case.asDict().get("deleted") or []}
    began = time.perf_counter()
    got = engine.search(case["query"], case["project"], case["root"], case["all_projects"], limit, mode, policies, gone=gone)
    return {"hits": [[r["rank"], r["path"], r["section_id"]] for r in got.items], "ms": (time.perf_counter() - began) * 1000, "retrieval_mode": got.metrics.retrieval_mode, "fallback": got.metrics.fallback, "failure_reason": got.metrics.failure_reason, "semantic_state": got.metrics.semantic_state}


def _hits(spark: SparkSession, outputs: dict[str, dict], base: str) -> DataFrame:
    rel = lambda p: p[len(base) + 1 :] if base and p.startswith(base + "/") else p
    return spark.createDataFrame([(c, n, rel(p), s) for c, o in outputs.items() for n, p, s in o["hits"]], _HITS)


def run_cases(spark: SparkSession, config: Config, cases: DataFrame, folder: str, thresholds: dict | None = None, encoder=None, mode: str = "lexical", base: str = "", cutoffs: tuple[int, ...] = CUTOFFS, gate_at: int = 4, ablate: bool = False, resume: bool = True) -> Result:
    """Index, search all cases, score them; the result is written to `folder`/result.json.

    Cases that a run of the same configuration has searched are taken from its
    checkpoints. base: folder that the cases' paths are relative to. The golden cases are
    a small file, so they are walked on the driver, one search each.
    """
    engine = Engine(spark, config, encoder)
    pointer = engine.index()
    started = datetime.now(UTC).isoformat(timespec="milliseconds")
    rows = cases.collect()
    note = F.sha2(F.concat_ws("\n", "path", "content_hash"), 256)
    corpus = fingerprint(list(Store(spark, config.store).table("files").agg(F.count(F.lit(1)), multiset_fingerprint(note)).first()))
    settings = {"mode": mode, "cutoffs": list(cutoffs), "policies": policy_diagnostics(config), "config": config.fingerprint, "encoder": engine.encoder_version}
    run = Run(fingerprint(settings)[:16], settings, fingerprint([r.asDict() for r in rows]), corpus, pointer["generation"] if encoder else None, cutoffs)
    known = read_checkpoint(spark, folder, run, "evaluate") if resume else None
    done = done_cases(spark, folder, run) if resume else spark.createDataFrame([], "case_id string, output string")
    outputs = {r["case_id"]: json.loads(r["output"]) for r in done.collect()}
    run.checkpoint("ingest", {"generation": pointer["generation"], "sections": pointer["sections"]}).write(spark, folder)
    for case in pending_cases(cases, done).orderBy("case_id").collect():
        outputs[case["case_id"]] = out = search_case(engine, case, mode, max(cutoffs), Policies(), base)
        run.checkpoint("search", out, case["case_id"]).write(spark, folder)
    shaped = cases.select("case_id", "category", "expected", "forbidden", "abstain")
    scored = evaluate.score_cases(_hits(spark, outputs, base), shaped, cutoffs)
    gated = evaluate.gates(scored)
    report = evaluate.gate_report(gated, thresholds or {}, gate_at)
    metrics = {"gates": [r.asDict() for r in gated.orderBy("k", "category").collect()], **report, "case_failures": [r.asDict() for r in evaluate.case_failures(scored.filter(F.col("k") == gate_at)).orderBy("case_id").collect()]}
    times = spark.createDataFrame([(o["ms"], o["retrieval_mode"], o["semantic_state"], o["failure_reason"], o["fallback"]) for o in outputs.values()], "ms double, retrieval_mode string, semantic_state string, failure_reason string, fallback boolean")
    metrics["latency"] = times.agg(*latency_summary("ms")).first().asDict()
    metrics["diagnostics"] = evaluate.diagnostics_counts(times)
    if ablate:
        metrics["ablations"] = _ablations(spark, engine, rows, shaped, base, mode, cutoffs, scored)
    result = Result({"run_id": run.run_id, "settings": settings, "case_set": run.case_set, "corpus": corpus, "generation": pointer["generation"], "started_at": started, "finished_at": datetime.now(UTC).isoformat(timespec="milliseconds"), "resumed": known is not None}, metrics, [{"case_id": c, **o} for c, o in sorted(outputs.items())])
    result.write(spark, f"{folder}/result.json")
    run.checkpoint("evaluate", {"passed": report["passed"]}).write(spark, folder)
    return result


def _ablations(spark, engine, rows, shaped, base, mode, cutoffs, active: DataFrame) -> list[dict]:
    parts = active.withColumn("policy", F.lit("active"))
    for name, change in ABLATIONS.items():
        outputs = {c["case_id"]: search_case(engine, c, mode, max(cutoffs), replace(Policies(), **change), base) for c in rows}
        parts = parts.unionByName(evaluate.score_cases(_hits(spark, outputs, base), shaped, cutoffs).withColumn("policy", F.lit(name)))
    return [r.asDict() for r in evaluate.ablation_deltas(parts.groupBy("policy", "k").agg(*evaluate.gate_measures())).orderBy("policy", "k").collect()]
