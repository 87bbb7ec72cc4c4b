"""Scoring, reports, checkpoints, conversations, answers, the synthetic corpus and its benchmark."""

import json
import os

import pytest
from pyspark.sql import functions as F

from strandex.operators import evaluate
from strandex.plans import answering, benchmark, evaluation
from strandex.plans.query import Root
from strandex.sources import artifacts, conversations, synthetic
from strandex.sources import config as conf


def case(spark, *rows):
    return spark.createDataFrame(rows, "case_id string, category string, expected array<string>, forbidden array<string>, abstain boolean")


def hits(spark, *rows):
    return spark.createDataFrame(rows, "case_id string, rank int, path string")


def test_scores(spark):
    cases = case(spark, ("a", "x", ["good"], ["noise"], False), ("b", "y", [], [], True), ("c", "y", [], [], True), ("d", "x", ["p", "q"], [], False))
    got = evaluate.score_cases(hits(spark, ("a", 1, "good"), ("a", 2, "noise"), ("c", 1, "z"), ("d", 1, "p"), ("d", 2, "p")), cases, (4,))
    s = {r.case_id: r for r in got.collect()}
    assert (s["a"].recall, s["a"].precision, s["a"].rr, s["a"].n_forbidden, s["a"].score, s["a"].passed) == (1, 0.5, 1, 1, 0, False)
    assert s["b"].passed and s["b"].recall is None and not s["c"].passed
    assert (s["d"].recall, s["d"].precision, s["d"].passed, s["d"].complete) == (0.5, 0.5, True, False)
    why = {r.case_id: r.failure for r in evaluate.case_failures(got).collect()}
    assert why == {"a": "returned 1 forbidden sources", "c": "expected abstention", "d": "missing expected sources (recall 0.500)"}
    gated = evaluate.gates(got)
    whole = gated.filter("category IS NULL").first()
    assert (whole.recall, whole.abstention_accuracy, whole.forbidden) == (0.75, 0.5, 1)
    report = evaluate.gate_report(gated, {"recall": 0.7, "forbidden": 0, "categories": {"y": {"abstention_accuracy": 0.5}}}, 4)
    assert report == {"passed": False, "failures": {"all": ["forbidden"], "x": ["forbidden"]}}


def test_empty_groups_count_as_one(spark):
    only = evaluate.gates(evaluate.score_cases(hits(spark), case(spark, ("b", "y", [], [], True)), (4,))).first()
    assert (only.recall, only.precision, only.mrr, only.abstention_accuracy) == (1, 1, 1, 1)


def test_abstention_outcomes(spark):
    d = "struct<status:string,fallback:boolean,failure_reason:string>"
    rows = spark.createDataFrame(
        [("a", 0, ("ok", False, None)), ("b", 3, ("ok", False, "")), ("c", 0, None), ("d", 0, ("timeout", False, None)), ("e", 0, ("ok", True, None)), ("f", 0, ("error", False, "broken"))], f"question_id string, n_hits int, diagnostics {d}"
    )
    got = {r.question_id: (r.abstained, r.score, r.error, r.reason) for r in evaluate.abstention_outcomes(rows, (2,)).collect()}
    assert got["a"] == (True, 1.0, None, None) and got["b"] == (False, 0.0, None, None)
    assert [got[k][3] for k in "cdef"] == ["missing_diagnostics", "timeout", "fallback", "broken"] and got["c"][:3] == (None, 0.0, "retrieval_error")


def test_diagnostics_counts(spark):
    rows = spark.createDataFrame([("fused", "ready", None, False), ("lexical", "stale", "x", True), ("lexical", "ready", "", None)], "retrieval_mode string, semantic_state string, failure_reason string, fallback boolean")
    assert evaluate.diagnostics_counts(rows) == {"searches": 3, "fallback_count": 1, "retrieval_mode_counts": {"fused": 1, "lexical": 2}, "semantic_state_counts": {"ready": 2, "stale": 1}, "failure_reason_counts": {"x": 1}}
    assert evaluate.diagnostics_counts(rows.limit(0))["searches"] == 0


TALK = [
    {
        "conversation": {
            "session_2": [{"dia_id": "D2:1", "speaker": "Ann", "text": "later\r\nlines"}],
            "session_2_date_time": "1:56 pm on 8 May, 2023",
            "session_1": [{"dia_id": "D1:0", "speaker": "Ann", "text": "hello"}, {"dia_id": "D1:1", "speaker": "Bob", "text": "", "query": "cat", "blip_caption": "a cat"}],
            "session_1_date_time": "10:00 am on 2 Jan, 2023",
            "session_3": [], "session_3_date_time": "someday", "speaker_a": "Ann",
        },
        "qa": [
            {"question": "who", "answer": "Ann", "category": 4, "evidence": ["D1:0", "D9:9", "D1:0"]},
            {"question": "trick", "category": 5, "evidence": []},
            {"question": "none", "answer": "x", "category": 1, "evidence": []},
        ],
    }
]


@pytest.fixture
def talk(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps(TALK))
    return conversations.read(spark, f"{tmp_path}/t.json", {1: 1, 4: 1, 5: 1})


def test_conversations(spark, talk, tmp_path):
    rows = conversations.sessions(talk)
    assert [r.session for r in rows.orderBy("place").collect()] == [1, 2, 3]
    made = conversations.render_sessions(rows)
    first = made.filter("session = 1").first()
    assert first.path == "conversation-00--session-01.md"
    assert first.markdown == (
        "# conversation 00\n\n## session 01 | timestamp: 10:00 am on 2 Jan, 2023\n\n### turn D1:0 | speaker: Ann | timestamp: 10:00 am on 2 Jan, 2023\n\nhello\n\n"
        "### turn D1:1 | speaker: Bob | timestamp: 10:00 am on 2 Jan, 2023\n\n[image query: cat; caption: a cat]\n"
    )
    assert [tuple(r) for r in first.ranges] == [("D1:0", 5, 7), ("D1:1", 9, 11)]
    for r in first.ranges:
        assert first.markdown.split("\n")[r.line_start - 1].startswith(f"### turn {r.dia_id}")
    assert [tuple(r) for r in made.filter("session = 2").first().ranges] == [("D2:1", 5, 8)]
    targets = conversations.question_targets(talk, made)
    assert [r.evidence_id for r in targets.collect()] == ["conversation-00--session-01.md#00000005-00000007"] * 2
    assert "hello" in conversations.evidence_text(targets, made).first().evidence
    assert [r.question_id for r in conversations.questions(talk).collect()] == ["conv0_q0", "conv0_q2"]
    assert [r.question_id for r in conversations.questions(talk, adversarial=True).collect()] == ["conv0_q1"]
    (tmp_path / "bad.json").write_text('{"a": 1}')
    for path, counts in ((f"{tmp_path}/bad.json", None), (f"{tmp_path}/t.json", {1: 2})):
        with pytest.raises(ValueError):
            conversations.read(spark, path, counts)


def test_dates(spark):
    texts = ["1:56 pm on 8 May, 2023", "(2023-05-08)", "2023-05-08T13:56:00.120Z", "2023-05-08T13:56:00", "2023-05-08 13:56:00", "soon", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(conversations.parse_date(F.col("t"))).collect()]
    assert [str(d) if d else None for d in got] == ["2023-05-08 13:56:00", "2023-05-08 00:00:00", "2023-05-08 13:56:00.120000", "2023-05-08 13:56:00", "2023-05-08 13:56:00", None, None]


def test_answers(spark):
    questions = spark.createDataFrame([("a", "q1", "x", None, "e"), ("b", "q2", "y", None, None), ("c", "fail", "z", None, None)], "question_id string, question string, ground_truth string, reference_date string, evidence string")
    found = spark.createDataFrame([("a", 1, "x", "d"), ("a", 2, "w", "d"), ("b", 1, "n", "d")], "question_id string, rank int, memory string, created_at string")

    def answerer(question, memories, date):
        if question == "fail":
            raise RuntimeError("down")
        return "thought ANSWER: " + ",".join(m["memory"] for m in memories)

    def judge(question, truth, response, evidence):
        return {"label": "correct" if truth in response else "wrong", "reasoning": "r"} if question == "q1" else {"label": "?"}

    got = {(r.question_id, r.k): r for r in answering.answered(questions, found, (1, 2), answerer, judge, wait=lambda s: None).collect()}
    assert (got["a", 1].answer, got["a", 2].answer, got["a", 1].score) == ("x", "x,w", 1.0)
    assert got["b", 1].error == "judge_error" and got["c", 2].error == "answerer_error" and got["c", 1].score == 0
    groups = evaluate.answer_groups(spark.createDataFrame([("s", 1, 1.0, None), ("s", 1, 0.0, "judge_error")], "category string, k int, score double, error string"))
    assert {(r.category, r.total, r.correct, r.accuracy, r.errors) for r in groups.collect()} == {(None, 2, 1, 50.0, 1), ("s", 2, 1, 50.0, 1)}
    waits = []
    with pytest.raises(ZeroDivisionError):
        answering.retried(lambda: 1 / 0, wait=waits.append)
    assert waits == [2, 4, 6, 8]


def test_checkpoints(spark, tmp_path):
    run = artifacts.Run("r", {"a": 1}, "cases", None, 3, (1, 4))
    run.checkpoint("search", {"hits": []}, "c1").write(spark, str(tmp_path))
    assert artifacts.read_checkpoint(spark, str(tmp_path), run, "search", "c1").output == {"hits": []}
    for other in (artifacts.Run("r", {"a": 2}, "cases", None, 3, (1, 4)), artifacts.Run("r", {"a": 1}, "cases", None, 4, (1, 4)), artifacts.Run("r", {"a": 1}, "cases", None, 3, (1,))):
        assert artifacts.read_checkpoint(spark, str(tmp_path), other, "search", "c1") is None
    cases = spark.createDataFrame([("c1",), ("c2",)], "case_id string")
    assert [r.case_id for r in artifacts.pending_cases(cases, artifacts.done_cases(spark, str(tmp_path), run)).collect()] == ["c2"]
    name = next(n for n in os.listdir(tmp_path) if n.endswith(".json"))
    good = json.loads((tmp_path / name).read_text())
    for bad in (good | {"extra": 1}, good | {"cutoffs": [True]}, good | {"version": "0"}, [], {k: v for k, v in good.items() if k != "output"}):
        assert artifacts.parse_checkpoint(json.dumps(bad)) is None
    assert artifacts.parse_checkpoint("{") is None
    assert artifacts.verify_lock('{"b": 1, "a": 2}', json.dumps({"case_set_fingerprint": conf.fingerprint({"a": 2, "b": 1})}))
    with pytest.raises(ValueError):
        artifacts.verify_lock("{}", "{}")


def test_report():
    one = {"total": 4, "abstained": 3, "errors": 0, "false_injections": 1, "false_injection_rate": 0.25, "histogram": {"0": 3, "2": 1}, "scores": dict.fromkeys(("count", "min", "p50", "p95", "max", "mean"), 1), "conversations": {"0": {"total": 4, "errors": 0, "false_injections": 1, "false_injection_rate": 0.25}}}
    text = artifacts.abstention_report({"lexical": one, "fused": one})
    assert "| lexical | 4 | 3 | 0 | 1 | 25.00% |" in text and "| 2 | 1 | 1 |" in text and "| 0 | 4 | 0 | 1 | 25.00% | 4 | 0 | 1 | 25.00% |" in text


def test_golden_cases(spark, tmp_path):
    good = {"status": "DRAFT", "cases": [{"id": f"c{n}", "query": "q", "scope": {"project": "p"}, "expected_source_paths": ["a.md"], "category": "verbatim"} for n in range(40)]}
    at = tmp_path / "cases.json"
    at.write_text(json.dumps(good))
    assert conf.read_cases(spark, str(at)).count() == 40
    for bad in (good | {"status": "?"}, good | {"cases": good["cases"][:39]}, good | {"cases": [*good["cases"], good["cases"][0]]}, good | {"cases": [*good["cases"], {"id": "x", "query": 1}]}):
        at.write_text(json.dumps(bad))
        with pytest.raises(conf.ConfigError):
            conf.read_cases(spark, str(at))
    (tmp_path / "t.toml").write_text("recall = true")
    with pytest.raises(conf.ConfigError):
        conf.read_thresholds(f"{tmp_path}/t.toml")


def test_run_of_cases(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(evaluation, "ABLATIONS", {"relaxed_matching_disabled": evaluation.ABLATIONS["relaxed_matching_disabled"]})
    os.makedirs(tmp_path / "notes")
    (tmp_path / "notes/a.md").write_text("# Cache\nthe cache budget\n")
    (tmp_path / "notes/b.md").write_text("# Other\nsomething else\n")
    config = conf.Config((Root("n", "p", f"{tmp_path}/notes"),), f"{tmp_path}/store")
    cases = spark.createDataFrame([("DRAFT", "one", "verbatim", "cache budget", ["a.md"], [], False, "p", None, False, []), ("DRAFT", "two", "abstention", "nowhere", [], [], True, "p", None, False, None)], conf.CASES)
    go = lambda **k: evaluation.run_cases(spark, config, cases, f"{tmp_path}/run", {"recall": 1.0, "abstention_accuracy": 1.0}, base=f"{tmp_path}/notes", **k)
    first = go(ablate=True)
    assert first.metrics["passed"] and len(first.metrics["ablations"]) == 4 and all(d["d_recall"] == 0 for d in first.metrics["ablations"])
    assert not first.metadata["resumed"] and go().metadata["resumed"]
    assert json.loads((tmp_path / "run/result.json").read_text())["metrics"]["passed"]


def test_synthetic_corpus(spark, tmp_path):
    a, b = ([tuple(r) for r in synthetic.notes(spark, 45, s).orderBy("number").collect()] for s in (0, 0))
    assert a == b and len({r[1] for r in a}) == 45 and sum(r[4] for r in a) == 3
    assert a != [tuple(r) for r in synthetic.notes(spark, 45, 1).orderBy("number").collect()]
    config, docs = benchmark.prepare(spark, str(tmp_path), 45, 0)
    asked = synthetic.workload(docs, 40).collect()
    modes = [r["mode"] for r in asked]
    assert (modes.count("multi"), modes.count("miss"), modes.count("global")) == (24, 2, 2)
    assert all(r["query"].startswith('"') for r in asked if r["mode"] == "phrase") and all(r["root_id"] for r in asked if r["mode"] == "scoped")
    assert sum(len(f) for _, _, f in os.walk(tmp_path / "notes")) == 45


def test_benchmark_report(spark):
    report = benchmark.run(spark, 24, 4)
    assert report["mix"]["valid"] and not report["gate"]["enforced"] and report["modes"]["multi"]["n"] == 4
    assert "warm_p95_ms" in benchmark.report_text(report)
