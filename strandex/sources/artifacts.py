"""Evaluation runs on disk: checkpoints that let a run go on, results, locks, reports.

A checkpoint is a JSON file for a stage and, within the search stage, for a case. It is
read only if its keys are exactly those of a checkpoint and it belongs to the same run
(configuration, case set, corpus, generation, cutoffs); anything else counts as absent,
and the case is searched again.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from . import files
from .config import canonical_json, fingerprint

STAGES = ("ingest", "search", "evaluate")
VERSION = "1"


@dataclass(frozen=True)
class Checkpoint:
    stage: str
    run_id: str
    config: dict
    case_set: str | None
    corpus: str | None
    generation: int | None
    cutoffs: list[int]
    output: dict
    status: str = "complete"
    case_id: str | None = None
    version: str = VERSION

    def path(self, folder: str) -> str:
        return f"{folder}/{self.stage}{'' if self.case_id is None else '-' + fingerprint(self.case_id)[:32]}.json"

    def write(self, spark: SparkSession, folder: str) -> None:
        files.replace_text(spark, self.path(folder), canonical_json(asdict(self)) + "\n")


@dataclass(frozen=True)
class Run:
    """What a checkpoint must agree with."""

    run_id: str
    config: dict
    case_set: str | None
    corpus: str | None
    generation: int | None
    cutoffs: tuple[int, ...]

    def checkpoint(self, stage: str, output: dict, case_id: str | None = None) -> Checkpoint:
        return Checkpoint(stage, self.run_id, self.config, self.case_set, self.corpus, self.generation, list(self.cutoffs), output, case_id=case_id)


def _types_are_right(c: dict) -> bool:
    text = lambda k: c[k] is None or isinstance(c[k], str)
    whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
    return (
        all(isinstance(c[k], str) for k in ("stage", "run_id", "status", "version"))
        and all(isinstance(c[k], dict) for k in ("config", "output"))
        and all(text(k) for k in ("case_set", "corpus", "case_id"))
        and (c["generation"] is None or whole(c["generation"]))
        and isinstance(c["cutoffs"], list)
        and all(whole(k) and k > 0 for k in c["cutoffs"])
    )


def parse_checkpoint(text: str) -> Checkpoint | None:
    try:
        c = json.loads(text)
    except ValueError:
        return None
    if not isinstance(c, dict) or set(c) != set(Checkpoint.__dataclass_fields__) or not _types_are_right(c):
        return None
    return Checkpoint(**c) if c["version"] == VERSION and c["stage"] in STAGES else None


def read_checkpoint(spark: SparkSession, folder: str, run: Run, stage: str, case_id: str | None = None) -> Checkpoint | None:
    wanted = run.checkpoint(stage, {}, case_id)
    text = files.read_text(spark, wanted.path(folder))
    got = parse_checkpoint(text) if text is not None else None
    same = got is not None and all(getattr(got, k) == getattr(wanted, k) for k in ("stage", "run_id", "config", "case_set", "corpus", "generation", "cutoffs", "case_id", "status"))
    return got if same else None


def done_cases(spark: SparkSession, folder: str, run: Run) -> DataFrame:
    """case_id, output (JSON) of the search checkpoints that belong to the run."""
    rows = []
    for name in files.names(spark, folder):
        if name.startswith("search-") and name.endswith(".json"):
            c = parse_checkpoint(files.read_text(spark, f"{folder}/{name}") or "")
            if c is not None and c.case_id is not None and read_checkpoint(spark, folder, run, "search", c.case_id) is not None:
                rows.append((c.case_id, canonical_json(c.output)))
    return spark.createDataFrame(rows, "case_id string, output string")


def pending_cases(cases: DataFrame, done: DataFrame) -> DataFrame:
    return cases.join(done.select("case_id"), "case_id", "left_anti")


def case_set_fingerprint(text: str) -> str:
    return fingerprint(json.loads(text))


def verify_lock(cases: str, lock: str) -> str:
    """The fingerprint of the cases (JSON text); an error if the lock (JSON text) names another."""
    own = case_set_fingerprint(cases)
    if json.loads(lock).get("case_set_fingerprint") != own:
        raise ValueError("the cases are not those of the lock")
    return own


@dataclass(frozen=True)
class Result:
    """A run's outcome as one JSON document."""

    metadata: dict
    metrics: dict
    evaluations: list[dict] = field(default_factory=list)
    version: str = VERSION

    def write(self, spark: SparkSession, path: str) -> None:
        files.replace_text(spark, path, json.dumps(asdict(self), sort_keys=True, indent=2, ensure_ascii=False) + "\n")


def _row(cells) -> str:
    return "| " + " | ".join(map(str, cells)) + " |"


def _table(head: list[str], rows: list[list]) -> list[str]:
    return [_row(head), _row(["---", *["---:"] * (len(head) - 1)]), *map(_row, rows), ""]


def _percent(share: float) -> str:
    return f"{100 * share:.2f}%"


def abstention_report(modes: dict[str, dict]) -> str:
    """Markdown on the questions without an answer, for each retrieval mode.

    modes: mode -> {total, abstained, errors, false_injections, false_injection_rate,
    histogram {hits: questions}, scores {count, min, p50, p95, max, mean}, conversations
    {id: {total, errors, false_injections, false_injection_rate}}}.
    """
    out = ["# Abstention", "", "Questions that the notes do not answer; the right result is none. Failed selections are errors.", ""]
    out += _table(["mode", "questions", "abstained", "errors", "false injections", "rate"], [[m, d["total"], d["abstained"], d["errors"], d["false_injections"], _percent(d["false_injection_rate"])] for m, d in modes.items()])
    counts = sorted({int(n) for d in modes.values() for n in d["histogram"]})
    out += ["## Results for a question", "", *_table(["results", *modes], [[n, *[d["histogram"].get(str(n), d["histogram"].get(n, 0)) for d in modes.values()]] for n in counts])]
    names = ("count", "min", "p50", "p95", "max", "mean")
    out += ["## Scores of results", "", *_table(["mode", *names], [[m, d["scores"]["count"], *[f"{d['scores'][n]:.6f}" for n in names[1:]]] for m, d in modes.items()])]
    whole = sorted({int(c) for d in modes.values() for c in d["conversations"]})
    cell = lambda d, c, k: d["conversations"].get(str(c), d["conversations"].get(c, {})).get(k, 0)
    rows = [[c, *[x for d in modes.values() for x in (cell(d, c, "total"), cell(d, c, "errors"), cell(d, c, "false_injections"), _percent(cell(d, c, "false_injection_rate")))]] for c in whole]
    out += ["## By conversation", "", *_table(["conversation", *[f"{m} {k}" for m in modes for k in ("total", "errors", "false", "rate")]], rows)]
    return "\n".join(out)
