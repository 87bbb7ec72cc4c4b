"""A benchmark of indexing and searching a synthetic corpus, one query after the other."""

from __future__ import annotations

import tempfile
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encoder import HashEncoder
from ..functions.stats import headroom, latency_summary
from ..operators.workload import hit_count_mix
from ..sources import markdown, synthetic
from ..sources.config import Config
from ..sources.store import Store
from .query import Root, Synonyms
from .service import Engine

COLD = 5
TARGETS = {"first_query_ms": 750.0, "warm_p95_ms": 300.0, "warm_max_ms": 750.0}


def prepare(spark: SparkSession, folder: str, count: int, seed: int, synonyms: Synonyms | None = None) -> tuple[Config, DataFrame]:
    """Write a corpus of `count` notes below folder; its configuration, and its notes as documents of a workload."""
    corpus = synthetic.notes(spark, count, seed)
    synthetic.write_notes(corpus, f"{folder}/notes")
    roots = tuple(Root(p, p, f"{folder}/notes/{p}") for p in synthetic.PROJECTS[:count])
    marks = corpus.filter("is_global").select("path").collect()  # one in twenty notes of a corpus made for a test
    config = Config(roots, f"{folder}/store", global_notes=tuple(f"{folder}/notes/{r['path']}" for r in marks), synonyms=synonyms or Synonyms())
    docs = corpus.select("path", "project", F.col("project").alias("root_id"), "is_global", F.col("content").alias("text"))
    return config, docs


def configured(spark: SparkSession, config: Config) -> DataFrame:
    """The notes of configured roots as documents of a workload."""
    project = F.create_map(*[x for r in config.roots for x in (F.lit(r.id), F.lit(r.project))])[F.col("root_id")]
    notes = markdown.scan(spark, list(config.roots), list(config.private))
    is_global = F.col("path").isin(list(config.global_notes)) if config.global_notes else F.lit(False)
    return notes.select("path", project.alias("project"), "root_id", is_global.alias("is_global"), F.col("content").cast("string").alias("text"))


@contextmanager
def corpus_folder(spark: SparkSession, folder: str | None) -> Iterator[str]:
    """The folder asked for, or a temporary one where driver and tasks share a machine."""
    if folder is not None:
        yield folder.rstrip("/")
        return
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster a benchmark needs a folder for its corpus that all machines share")
    with tempfile.TemporaryDirectory(prefix="strandex-bench-") as made:
        yield made


def _timed(f):
    began = time.perf_counter()
    return f(), (time.perf_counter() - began) * 1000


def run(spark: SparkSession, count: int = 2000, queries: int = 200, seed: int = 0, hook_path: bool = False, corpus_dir: str | None = None, config: Config | None = None, synonyms: Synonyms | None = None) -> dict:
    """The report; the gate is enforced for the default size of a synthetic corpus, and the mix of hits is checked there.

    config: real notes in the place of a synthetic corpus. With hook_path queries are fused,
    the report has their stages, and up to COLD queries are asked again with nothing cached.
    """
    if count < 1 or queries < 1:
        raise ValueError("notes and queries must be positive")
    real = config is not None
    with corpus_folder(spark, corpus_dir) as folder:
        config, docs = (config, configured(spark, config)) if real else prepare(spark, folder, count, seed, synonyms)
        engine = Engine(spark, config, HashEncoder() if hook_path else None)
        pointer, build_ms = _timed(lambda: engine.index(rebuild=True))
        _, refresh_ms = _timed(engine.index)
        asked = synthetic.workload(docs, queries, seed).orderBy("number").collect()
        mode = "auto" if hook_path else "lexical"

        def one(q):
            got, ms = _timed(lambda: engine.search(q["query"], q["project"], q["root_id"], q["all_projects"], mode=mode))
            return q["mode"], len(got.items), ms, got.metrics.fallback, got.metrics.encode_ms, got.metrics.search_ms

        first_ms = one(asked[0])[2] if asked else 0.0
        samples = [one(q) for q in asked]
        cold = []
        for q in asked[: COLD if hook_path else 0]:
            engine.close()
            spark.catalog.clearCache()
            cold.append((one(q)[2],))
        files = Store(spark, config.store).table("files").count()
        engine.close()
    rows = spark.createDataFrame(samples, "mode string, n_hits long, ms double, fallback boolean, encode_ms double, search_ms double")
    warm = rows.agg(*latency_summary("ms"), F.count_if("fallback").alias("fallbacks"), F.sum("ms").alias("total")).first().asDict()
    modes = {r["mode"]: r.asDict() for r in rows.groupBy("mode").agg(*latency_summary("ms"), F.min("n_hits").alias("least_hits"), F.max("n_hits").alias("most_hits")).collect()}
    mix = hit_count_mix(rows).first().asDict()
    metrics = {"index_build_ms": build_ms, "refresh_ms": refresh_ms, "first_query_ms": first_ms, "warm_p50_ms": warm["p50"], "warm_p95_ms": warm["p95"], "warm_max_ms": warm["max"], "queries_per_second": 1000 * warm["n"] / warm["total"], "sections_per_second": 1000 * pointer["sections"] / build_ms}
    checks = {k: headroom(metrics[k], t) for k, t in TARGETS.items()}
    report = {"files": files, "sections": pointer["sections"], "seed": seed, "queries": len(samples), "mix": mix, "modes": modes, "fallbacks": warm["fallbacks"], "metrics": metrics, "checks": checks}
    report["gate"] = {"enforced": not real and count == 2000 and queries == 200, "passed": checks["warm_p95_ms"]["passed"] and mix["valid"]}
    if hook_path:
        stages = {c: rows.agg(*latency_summary(c)).first().asDict() for c in ("encode_ms", "search_ms")}
        report["hook_path"] = {"stages": stages, "cold": spark.createDataFrame(cold, "ms double").agg(*latency_summary("ms")).first().asDict()}
    return report


def report_text(report: dict) -> str:
    out = [f"{report['files']} files, {report['sections']} sections, {report['queries']} queries", ""]
    out += [f"{k:22} {v:12.2f}" + (f"   {'ok' if report['checks'][k]['passed'] else 'missed'} ({report['checks'][k]['limit']:g})" if k in report["checks"] else "") for k, v in report["metrics"].items()]
    return "\n".join(out)
