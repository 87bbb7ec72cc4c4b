"""One long-lived engine for many queries: modes, deadlines, fallback, metrics, JSON results.

A query runs in a thread under a job tag of its own. At the deadline its jobs are
cancelled and the answer is a lexical one if there is time, else empty, with the reason
in the metrics; a cancelled or failed query leaves nothing behind.
"""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from ..functions.encoder import DISABLED, MODEL_MISSING, READY
from ..operators.fusion import RANK_CONSTANT
from ..operators.lexical import COVERAGE_IDF
from ..operators.search import Policies, search
from ..sources.config import Config
from ..sources.store import build, open_index, state_of
from .query import MAX_CANDIDATES, MAX_TOKENS, MIN_CANDIDATES, OVERSAMPLE, RELAXED_SHARE

DEADLINE_MS = 750.0
MODES = ("auto", "fused", "lexical")
LEAST_MS = 1e-6


@dataclass(frozen=True)
class Metrics:
    encode_ms: float = LEAST_MS
    search_ms: float = LEAST_MS
    fallback_ms: float = LEAST_MS
    total_ms: float = LEAST_MS
    fallback: bool = False
    failure_reason: str | None = None
    semantic_state: str = "unknown"
    status: str = "ok"
    retrieval_mode: str = "lexical"


@dataclass(frozen=True)
class Response:
    items: list[dict]
    metrics: Metrics
    refresh: set[str] = field(default_factory=set)


#: Why each policy is there, for the diagnostics.
RATIONALE = {
    "semantic_score_floor": "Vectors below this cosine are noise for short questions.",
    "relative_semantic_score_floor": "A vector hit far below the best lexical hit's cosine is off the topic.",
    "ticket_id_cross_reference_filter": "A question about one identifier is not answered by a section about another.",
    "balanced_admission": "Lanes take turns, so that a full lexical lane leaves room for vectors.",
    "synonym_expansion": "A configured form finds sections that use another form of it.",
    "synonym_variant_merge": "Variants merge by best score, so their order plays no part.",
    "relaxed_lexical_matching": "A question rarely has all its words in one section.",
}


def policy_diagnostics(config: Config | None = None, policies: Policies | None = None) -> dict:
    """The fixed numbers of the fusion, and the policies in force with their reasons."""
    policies = policies or Policies()
    table = config.synonyms.metadata(policies.synonym_expansion) if config else {"configured": False, "version": None, "fingerprint": None, "groups": 0, "enabled": False}
    expands = bool(policies.synonym_expansion and table["groups"])
    floors = {n: {"enabled": v is not None, "value": v} for n, v in asdict(policies).items() if n.endswith("floor")}
    switches = {
        "ticket_id_cross_reference_filter": {"enabled": policies.ticket_id_cross_reference_filter},
        "balanced_admission": {"enabled": policies.balanced_admission},
        "synonym_expansion": {"enabled": expands},
        "synonym_variant_merge": {"enabled": expands},
        "relaxed_lexical_matching": {
            "enabled": policies.relaxed_matching, "value": RELAXED_SHARE, "idf_coverage": COVERAGE_IDF,
            "with_strict_hits": {"content_term_coverage": "complete", "heading_anchor": "own_heading", "rank": "after_strict_hits"},
            "without_strict_hits": {"content_term_coverage": "relaxed_thresholds", "heading_anchor": "not_required"},
        },
    }
    own = {n: {**v, "rationale": RATIONALE[n]} for n, v in (floors | switches).items()}
    pool = {"minimum": MIN_CANDIDATES, "oversample": OVERSAMPLE, "maximum": MAX_CANDIDATES}
    shown = {n: own[n] for n in own if n not in ("synonym_expansion", "relaxed_lexical_matching")}
    return {"algorithm": "rrf", "candidate_pool": pool, "rrf_rank_constant": RANK_CONSTANT, "query_term_cap": MAX_TOKENS, "selection_policies": own, **shown, "synonym_table": table}


class Deadline(Exception):
    pass


class Engine:
    """encoder: an object with `encode` and `version`, or a callable; None: lexical only.

    With keep_vectors, the executors hold the vectors of the current generation from query
    to query (in memory, and on their disks beyond it).
    """

    def __init__(self, spark: SparkSession, config: Config, encoder=None, live: bool = True, keep_vectors: bool = True):
        self.spark, self.config, self.encoder, self.live, self.keep_vectors = spark, config, encoder, live, keep_vectors
        self._kept: tuple[int, DataFrame] | None = None

    @property
    def encoder_version(self) -> str:
        return getattr(self.encoder, "version", "callable") if self.encoder is not None else "none"

    def index(self, rebuild: bool = False) -> dict:
        from ..functions.encoder import encode_rows

        apply = None if self.encoder is None else lambda rows: encode_rows(rows, self.encoder)
        return build(self.spark, self.config, rebuild, apply, self.encoder_version)

    def search(self, query: str, project=None, root_id=None, all_projects=False, limit: int = 20, mode: str = "auto", policies: Policies | None = None, deadline_ms: float | None = None, gone: set[str] = frozenset()) -> Response:
        """gone: sources that count as deleted for this query."""
        if mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        if deadline_ms is not None and deadline_ms <= 0:
            raise ValueError("deadline must be positive")
        if not isinstance(query, str) or not isinstance(all_projects, bool) or isinstance(limit, bool) or not isinstance(limit, int):
            raise ValueError("query must be text, all_projects true or false, limit a whole number")
        if limit < 1:
            raise ValueError("limit must be positive")
        began = time.perf_counter()
        left = lambda: None if deadline_ms is None else deadline_ms / 1000 - (time.perf_counter() - began)
        state, why = state_of(self.spark, self.config, self.encoder_version if self.encoder is not None else None)
        options = {"project": project, "root_id": root_id, "all_projects": all_projects, "limit": limit, "policies": policies}
        gone = frozenset(gone)
        m = Metrics(semantic_state=state)
        done = lambda items, refresh=frozenset(), **k: Response(items, replace(m, total_ms=_ms(began), **k), set(refresh))
        if state == DISABLED and why in ("INDEX_MISSING", "INDEX_UNAVAILABLE"):
            return done([], status="semantic_disabled", failure_reason=why)
        failure = None
        if mode != "lexical":
            if self.encoder is None:
                failure, status = why if state != READY else MODEL_MISSING, "semantic_disabled"
            elif state != READY:
                failure, status = why or "semantic backend unavailable", "semantic_failure"
            else:
                try:
                    return self._fused(query, options, gone, left(), done)
                except Deadline:
                    failure, status = "deadline_exceeded", "timeout"
                except Exception as e:  # an encoder or a broken table: the lexical lane still serves
                    failure, status = str(e).split("\n")[0] or "semantic query failed", "semantic_failure"
        start = time.perf_counter()
        try:
            items, refresh = self._within(lambda: self._rows(query, None, options, gone), left())
        except Deadline:
            return done([], status="timeout", failure_reason="deadline_exceeded", fallback=mode != "lexical")
        spent = {"search_ms": _ms(start)} if mode == "lexical" else {"fallback_ms": _ms(start), "fallback": True, "failure_reason": failure, "status": status}
        return done(items, refresh, **spent)

    def _fused(self, query, options, gone, left, done) -> Response:
        start = time.perf_counter()
        vector = getattr(self.encoder, "encode", self.encoder)([query])[0]
        encode_ms, start = _ms(start), time.perf_counter()
        items, refresh = self._within(lambda: self._rows(query, list(vector), options, gone), None if left is None else left - encode_ms / 1000)
        lexical = bool(refresh)
        return done(items, refresh, encode_ms=encode_ms, search_ms=_ms(start), retrieval_mode="lexical" if lexical else "fused", fallback=lexical, failure_reason="stale sources" if lexical else None)

    def _rows(self, query, vector, options, gone) -> tuple[list[dict], set[str]]:
        refresh: set[str] = set()
        index = open_index(self.spark, self.config, self.live, gone)
        if vector is not None and index.vectors is not None and self.keep_vectors:
            if self._kept is None or self._kept[0] != index.generation:
                self.close()
                self._kept = (index.generation, index.vectors.persist())
            index.vectors = self._kept[1]
        try:
            return [r.asDict() for r in search(index, query, query_vector=vector, refresh=refresh, **options).collect()], refresh  # `limit` rows
        finally:
            index.release()

    def close(self) -> None:
        """Let go of the vectors."""
        if self._kept is not None:
            self._kept[1].unpersist()
            self._kept = None

    def _within(self, work, left: float | None):
        """The result of work, or Deadline after `left` seconds, with its jobs cancelled."""
        if left is not None and left <= 0:
            raise Deadline
        tag, out = f"strandex-{uuid.uuid4().hex}", {}

        def run():
            self.spark.addTag(tag)
            try:
                out["value"] = work()
            except BaseException as e:  # handed to the caller
                out["error"] = e
            finally:
                self.spark.removeTag(tag)

        if left is None:
            run()
        else:
            t = threading.Thread(target=run, daemon=True)
            t.start()
            t.join(left)
            if t.is_alive():
                self.spark.interruptTag(tag)
                raise Deadline
        if "error" in out:
            raise out["error"]
        return out["value"]


def _ms(since: float) -> float:
    return max((time.perf_counter() - since) * 1000, LEAST_MS)


def item(row: dict, diagnostics: bool = False, config: Config | None = None, mode: str | None = None) -> dict:
    """A result as it is printed."""
    out = {
        "excerpt": row["excerpt"], "path": row["path"], "heading": list(row["heading_path"] or []), "line_range": [row["line_start"], row["line_end"]],
        "dates": {"updated": row["updated_date"], "created": row["created_date"]}, "score": row["score"], "reason": row["reason"], "content_hash": row["content_hash"],
    }
    if diagnostics:
        out |= {k: row[k] for k in ("lane", "lexical_rank", "vector_rank", "lexical_score", "vector_score", "fused_score", "guard_reason")}
        out |= {"fusion_policies": policy_diagnostics(config), "retrieval_mode": mode or ("fused" if row["fused_score"] is not None else "lexical")}
    return out


def envelope(items: list[dict], requested: str, metrics: Metrics, explicit: bool, backend_ready: bool):
    """An array, or an object with diagnostics if they are asked for, or the mode is fused and a backend is there."""
    if not (explicit or (requested == "fused" and backend_ready)):
        return items
    return {"items": items, "diagnostics": {"requested_mode": requested, "retrieval_mode": metrics.retrieval_mode, "semantic_state": metrics.semantic_state, "semantic_reason": metrics.failure_reason, "fallback": metrics.fallback}}
