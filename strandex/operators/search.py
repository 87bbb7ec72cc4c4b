"""Search over an index: the lexical operator, fusion with vectors, reading, batches."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cut_bytes, excerpt, fold_udf, query_tokens
from ..functions.vectors import is_valid
from ..plans.query import Root, Scope, Synonyms, candidate_bound, compile_query, content_terms, guard_atoms, index_words, query_variants, resolve_scope
from ..plans.query import fold as fold_text
from . import lexical
from .fusion import fuse
from .postings import matches
from .vector import RELATIVE_FLOOR, SCORE_FLOOR, cosine, relative_floor, same_ticket


@dataclass(frozen=True)
class Policies:
    semantic_score_floor: float | None = SCORE_FLOOR
    relative_semantic_score_floor: float | None = RELATIVE_FLOOR
    ticket_id_cross_reference_filter: bool = True
    balanced_admission: bool = True
    synonym_expansion: bool = True
    relaxed_matching: bool = True

    def __post_init__(self):
        for name in ("semantic_score_floor", "relative_semantic_score_floor"):
            v = getattr(self, name)
            if v is not None and (isinstance(v, bool) or not isinstance(v, (int, float)) or not 0 <= v <= 1):
                raise ValueError(f"{name} must be between 0 and 1, or None")
        for name in ("ticket_id_cross_reference_filter", "balanced_admission", "synonym_expansion", "relaxed_matching"):
            if not isinstance(getattr(self, name), bool):
                raise ValueError(f"{name} must be true or false")


@dataclass
class Index:
    """sections (columns of SECTION), live sources and vectors.

    live: a function from paths to the content hashes that these files have now (a path
    without a file has none); None: hits are not checked. It is asked for the candidates
    of a query only. vectors: section_id, path, root_id, content_hash, vector.

    With postings (a table of `postings.write`, and n_rows and mean_length of the index) a
    query reads the postings of its words; without, it scans the sections.
    """

    sections: DataFrame
    roots: list[Root]
    global_paths: list[str] = field(default_factory=list)
    live: Callable[[set[str]], dict[str, str]] | None = None
    vectors: DataFrame | None = None
    synonyms: Synonyms = Synonyms()
    postings: DataFrame | None = None
    n_rows: int = 0
    mean_length: float = 0.0
    buckets: int | None = None
    generation: int = 0
    _held: list = field(default_factory=list)

    def __post_init__(self):
        for name, kind in SECTION.items():
            if name not in self.sections.columns:
                self.sections = self.sections.withColumn(name, F.lit(None).cast(kind))

    def view(self, forms, atoms=()) -> DataFrame:
        """What the lexical operators need for compiled queries and guard atoms."""
        if self.postings is None:
            return lexical.index(self.sections)
        words = {w for f in forms for c in (*f.clauses, *map(index_words, f.tokens)) for w in c} | {w for a in atoms for w in index_words(a)}
        return self.hold(matches(self.postings, words, self.n_rows, self.mean_length, self.buckets))

    def hold(self, rows: DataFrame) -> DataFrame:
        """Keep rows that several plans of a query read until `release`: of a generation only, which never changes, not of live files."""
        self._held.append(rows.persist())
        return self._held[-1]

    def release(self) -> None:
        while self._held:
            self._held.pop().unpersist()

    def scope(self, project=None, root_id=None, all_projects=False) -> Scope:
        return resolve_scope(self.roots, self.global_paths, project, root_id, all_projects)


SECTION = {
    "section_id": "string", "path": "string", "root_id": "string", "content_hash": "string", "heading": "string",
    "heading_path": "array<string>", "line_start": "int", "line_end": "int", "text": "string",
    "note_type": "string", "updated_date": "string", "created_date": "string",
}
SCORES = {"lexical_score": "double", "vector_score": "double", "fused_score": "double", "lexical_rank": "int", "vector_rank": "int"}
#: Columns of a result: a section, how it was found, and its excerpt.
RESULT = ["rank", *SECTION, "project", "score", "reason", "lane", "guard_reason", *SCORES, "excerpt"]


def _folded_tokens(column):
    return query_tokens(fold_udf(column))


def _local(index: Index, rows: pa.Table) -> DataFrame:
    """A few rows of the driver as a table."""
    return index.sections.sparkSession.createDataFrame(rows)


@dataclass
class Lane:
    """Ranked lexical hits whose sources are as they were indexed (with the columns of their sections), and the paths of those that are not."""

    hits: pa.Table
    stale: set[str]


def lexical_lane(index: Index, query: str, scope: Scope, bound: int, policies: Policies) -> Lane | None:
    """hits: lexical_score, score, reason, lexical_rank and SECTION; None for an empty query or scope.

    Three passes, whatever the query: the statistics of all its forms, the best rows of all
    lanes (a few bounds of ids and counts, which the driver merges), their sections.
    """
    norm = fold_text(query)
    compiled = compile_query(norm)
    if scope.empty or compiled.empty:
        return None
    variants = [compile_query(v) for v in query_variants(norm, index.synonyms)] if policies.synonym_expansion else []
    forms = [compiled, *[v for v in variants if not v.empty]]
    expanded = len(forms) > 1
    view = index.view(forms)
    plan = lexical.relaxation(compiled.tokens, '"' in norm) if policies.relaxed_matching else None
    asked = [(list(f.clauses), fields) for f in forms for fields in lexical.LANES] + ([(list(plan.phrases), lexical.FIELDS)] if plan else [])
    stats, _ = lexical.gather(view, asked)
    none = F.lit(None).cast("array<int>")
    parts = []
    for n, f in enumerate(forms):
        own = lexical.lanes(view, f, scope, bound, n, stats[len(lexical.LANES) * n : len(lexical.LANES) * (n + 1)])
        parts.append(own.select("section_id", "fts_score", "step", none.alias("heads"), none.alias("bodies")))
    if plan:
        parts.append(lexical.relaxed_lane(view, plan, scope, bound, stats[-1]).select("section_id", "fts_score", F.lit(-1).alias("step"), "heads", "bodies"))
    got = reduce(DataFrame.unionByName, parts).toArrow().to_pylist()  # at most a few bounds
    strict: dict[str, tuple] = {}
    for r in sorted((r for r in got if r["step"] >= 0), key=lambda r: r["step"]):
        best = strict.get(r["section_id"])
        if best is None or not expanded or r["fts_score"] < best[0]:
            strict[r["section_id"]] = (r["fts_score"], None, None)
    loose = {r["section_id"]: (r["fts_score"], r["heads"], r["bodies"]) for r in got if r["step"] < 0 and r["section_id"] not in strict}
    rows = [(k, *v) for k, v in (strict | loose).items()]
    few = F.broadcast(index.sections.sparkSession.createDataFrame(rows, "section_id string, fts_score double, heads array<int>, bodies array<int>"))
    found = index.sections.select(*SECTION).join(few, "section_id")
    heading, body, path = (_folded_tokens(c) for c in (F.coalesce("heading", F.lit("")), F.col("text"), F.array_join("heading_path", "\n")))
    found = found.withColumns({"h": heading, "b": body, "p": path})
    exact = found.filter("heads IS NULL").withColumns({"matched": F.lit(None).cast("int"), "of_terms": F.lit(None).cast("int"), "weight": F.lit(None).cast("double")})
    if plan:
        relaxed = lexical.covered(found.filter("heads IS NOT NULL"), plan, stats[-1], bool(strict), F.col("p"))
        exact = exact.unionByName(relaxed.withColumn("h", F.array_union("h", "p")))
    is_relaxed = F.col("matched").isNotNull()
    a = lexical.boosts(F.col("h"), F.col("b"), [t.casefold() for f in forms for t in f.tokens])
    c = lexical.boosts(F.col("h"), F.col("b"), content_terms(compiled.tokens))
    ident, head, inside = (F.when(is_relaxed, y).otherwise(x) for x, y in zip(a, c, strict=True))
    partial = F.when(is_relaxed, F.format_string("partial match (%d/%d terms)", "matched", "of_terms"))
    reason = lexical.reason(_is_global(index), partial, ident, head, inside)
    scored = exact.select(*SECTION, F.col("fts_score").alias("lexical_score"), (-F.col("fts_score") + ident + head).alias("score"), reason.alias("reason"), "weight").toArrow()
    stale = _stale(index, scored)
    # strict hits by score (with variants by BM25 alone), then the relaxed ones by weight, then score
    kept = [r for r in scored.to_pylist() if r["path"] not in stale]
    kept.sort(key=lambda r: (r["weight"] is not None, r["lexical_score"] if expanded and r["weight"] is None else -r["score"] if r["weight"] is None else -r["weight"], -r["score"] if r["weight"] is not None else 0.0, r["section_id"]))
    kept = [{**r, "lexical_rank": n} for n, r in enumerate(kept[:bound], 1)]
    kind = scored.schema.append(pa.field("lexical_rank", pa.int32()))
    return Lane(pa.Table.from_pylist(kept, schema=kind), stale)


def _stale(index: Index, rows: pa.Table) -> set[str]:
    """Paths of rows (path, content_hash) whose file is gone or has changed."""
    if index.live is None or not rows.num_rows:
        return set()
    pairs = set(zip(rows.column("path").to_pylist(), rows.column("content_hash").to_pylist(), strict=True))
    now = index.live({p for p, _ in pairs})
    return {p for p, h in pairs if now.get(p) != h}


def search(index: Index, query: str, project: str | None = None, root_id: str | None = None, all_projects: bool = False, limit: int = 20, query_vector: list[float] | None = None, policies: Policies | None = None, refresh: set[str] | None = None) -> DataFrame:
    """The ranked sections for a query (columns of RESULT); with a query vector and an index of vectors, fused.

    If a hit's source is not as it was indexed, or a vector in scope is not valid, the
    result is lexical, and the paths to refresh are added to `refresh`. The postings of
    a query's words stay cached until `index.release()`.
    """
    policies, bound = policies or Policies(), candidate_bound(limit)
    scope = index.scope(project, root_id, all_projects)
    lane = lexical_lane(index, query, scope, bound, policies)
    hits = lane.hits if lane else None
    stale = set(lane.stale) if lane else set()
    if query_vector is None or index.vectors is None or scope.empty:
        _add(refresh, stale)
        return _lexical_result(index, hits, limit)
    seen = index.vectors.filter(lexical.scope_condition(scope))
    # the best vectors, and a few that are not valid: one pass
    good = is_valid(F.col("vector"), len(query_vector))
    best = cosine(seen.filter(good), query_vector, limit=bound).withColumn("broken", F.lit(False))
    broken = seen.filter(~good).select("section_id", F.lit(None).cast("double").alias("vector_score"), F.lit(True).alias("broken")).limit(bound)
    few = best.unionByName(broken).toArrow()
    near = index.sections.select(*SECTION).join(F.broadcast(_local(index, few)), "section_id").toArrow()
    marks = near.column("broken").to_pylist()
    stale |= {p for p, m in zip(near.column("path").to_pylist(), marks, strict=True) if m} | _stale(index, near)
    _add(refresh, stale)
    if stale:
        return _lexical_result(index, hits, limit)
    order = sorted(near.to_pylist(), key=lambda r: (-r["vector_score"], r["section_id"]))
    kind = near.schema.append(pa.field("vector_rank", pa.int32()))
    ranked = _local(index, pa.Table.from_pylist([{**r, "vector_rank": n} for n, r in enumerate(order, 1)], schema=kind))
    lex = _local(index, hits) if hits is not None else _no_hits(index)
    atoms = guard_atoms(query)
    own = [a for a in atoms if re.fullmatch(r"[a-z][a-z0-9]*-\d+", a)]
    if policies.ticket_id_cross_reference_filter and own:
        ranked = same_ticket(ranked, own, fold_udf(F.concat_ws("\n", F.array_join("heading_path", "\n"), "text")))
    ranked = relative_floor(ranked, lex, policies.semantic_score_floor, policies.relative_semantic_score_floor)
    one = lambda d: d.withColumn("query_id", F.lit(1))
    protected = None
    if atoms and hits is not None:
        compiled = compile_query(fold_text(query))
        view = index.view([compiled], atoms)
        found = lexical.atom_matches(view, atoms, scope)
        protected = one(found.join(lexical.primary_ranks(view, compiled, scope, bound), "section_id"))
    out = fuse(one(lex), one(ranked), bound, limit, bool(atoms), policies.balanced_admission, protected, policies.semantic_score_floor).toArrow()
    known = {r["section_id"]: r for t in ([near, hits] if hits is not None else [near]) for r in t.to_pylist()}
    rows = []
    for r in out.to_pylist():  # `limit` rows
        lexical_hit = r["lexical_rank"] is not None
        section = known[r["section_id"]]
        reason = section["reason"] if lexical_hit else "global-note inclusion, semantic match" if section["path"] in index.global_paths else "semantic match"
        rows.append({**{c: section[c] for c in SECTION}, **r, "score": r["fused_score"], "lexical_score": section["lexical_score"] if lexical_hit else None, "reason": f"{reason}, {r['lane']} lane, fused score"})
    return _result(index, rows)


def _add(refresh: set[str] | None, paths: set[str]) -> None:
    if refresh is not None:
        refresh.update(paths)


def _is_global(index: Index):
    return F.col("path").isin(index.global_paths) if index.global_paths else F.lit(False)


def _no_hits(index: Index) -> DataFrame:
    return index.sections.sparkSession.createDataFrame([], "section_id string, lexical_rank int, lexical_score double")


_FOUND = {**SECTION, **SCORES, "rank": "int", "score": "double", "reason": "string", "lane": "string", "guard_reason": "string"}


def _result(index: Index, rows: list[dict]) -> DataFrame:
    """At most `limit` rows as the result's table, by rank."""
    kind = ", ".join(f"{c} {k}" for c, k in _FOUND.items())
    rows = sorted(([r.get(c) for c in _FOUND] for r in rows), key=lambda r: r[list(_FOUND).index("rank")])
    names = [x for r in index.roots for x in (F.lit(r.id), F.lit(r.project))]
    project = F.create_map(*names)[F.col("root_id")] if names else F.lit(None).cast("string")
    table = index.sections.sparkSession.createDataFrame(rows, kind)
    return table.withColumns({"project": project, "excerpt": excerpt(F.col("text"))}).select(*RESULT).orderBy("rank")


def _lexical_result(index: Index, hits: pa.Table | None, limit: int) -> DataFrame:
    rows = hits.to_pylist()[:limit] if hits is not None else []
    return _result(index, [{**r, "rank": r["lexical_rank"], "lane": "lexical"} for r in rows])


def semantic_with(index: Index, encoder: Callable[[list[str]], list[list[float]]] | object, query: str, **options) -> DataFrame:
    """Search with an encoder (a callable, or an object with `encode`); any failure of it gives the lexical result."""
    try:
        vector = getattr(encoder, "encode", encoder)([query])[0]
    except Exception:  # an encoder is foreign code
        vector = None
    return search(index, query, query_vector=vector, **options)


def read_section(index: Index, path: str, heading: str | None = None, limit: int = 20000) -> str:
    """The text of a note's sections, or of those under a heading (by title or by its path joined with ` > `)."""
    if limit < 1:
        raise ValueError("the limit must be positive")
    rows = index.sections.filter(F.col("path") == path)
    if heading is not None:
        rows = rows.filter((F.col("heading") == heading) | (F.array_join("heading_path", " > ") == heading))
    parts = rows.orderBy("line_start").select("text").collect()  # one note
    if not parts:
        raise ValueError(f"no such note or heading: {path} {heading or ''}".rstrip())
    return cut_bytes("\n\n".join(r["text"] for r in parts), limit)


def isolated_search(docs: DataFrame, queries: DataFrame, k: int, group: str = "conv_id") -> DataFrame:
    """query_id, doc_id, score, rank: the best k documents with any term of each query, by BM25 within the query's group.

    docs: group, doc_id, words (array); queries: query_id, group, terms (array, distinct).
    Each group is an index of its own: a query sees its group's documents, and rows, mean
    length and frequencies are those of the group. One join, on group and term; terms that
    no query of the group asks for never leave their task.
    """
    size = docs.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("words")).alias("mean"))
    asked = queries.select("query_id", group, F.explode("terms").alias("term"))
    wanted = asked.groupBy(group).agg(F.collect_set("term").alias("wanted"))  # a group's questions are few
    some = docs.join(wanted, group).select(group, "doc_id", F.size("words").alias("length"), F.explode(F.filter("words", lambda w: F.array_contains("wanted", w))).alias("term"))
    tf = some.groupBy(group, "doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))
    df = tf.groupBy(group, "term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(lexical.LEAST_IDF))
    part = F.lit(lexical.K1) * (F.lit(1 - lexical.B) + F.lit(lexical.B) * F.col("length") / F.col("mean"))
    rows = tf.join(df, [group, "term"]).join(size, group).withColumn("part", idf * F.col("tf") * F.lit(lexical.K1 + 1) / (F.col("tf") + part))
    scored = asked.join(rows, [group, "term"]).groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def batch_all_terms(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score, rank: the best k documents that hold all terms of each query, by BM25.

    docs: doc_id, words (array); queries: query_id, terms (array, distinct). A query is
    looked up by its rarest term only, so a word that half of the documents hold joins
    nothing; the candidates then have all their terms checked and counted on their own
    words. Frequencies are those of the whole table, of the queries' terms only.
    """
    asked = queries.select(F.explode("terms").alias("term")).distinct()
    postings = docs.select("doc_id", F.explode(F.array_distinct("words")).alias("term")).join(asked, "term")
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("words")).alias("mean")).first()
    known = queries.select("query_id", F.explode("terms").alias("term")).join(df, "term", "left")
    idf = F.greatest(F.ln((F.lit(size["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(lexical.LEAST_IDF))
    plan = known.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", idf.alias("idf")))).alias("parts"), F.min_by("term", F.struct("df", "term")).alias("rarest"), F.count_if(F.col("df").isNull()).alias("unknown"))
    plan = plan.filter("unknown = 0")
    pairs = plan.join(postings, plan["rarest"] == postings["term"]).select("query_id", "parts", "doc_id")
    rows = pairs.join(docs, "doc_id").filter(F.size(F.array_except(F.transform("parts", lambda p: p["term"]), F.col("words"))) == 0)
    length = F.lit(lexical.K1) * (F.lit(1 - lexical.B) + F.lit(lexical.B) * F.size("words") / F.lit(float(size["mean"] or 1.0)))

    def part(p):
        tf = F.size(F.filter("words", lambda w: w == p["term"]))
        return p["idf"] * (tf * F.lit(lexical.K1 + 1)) / (tf + length)

    score = F.round(F.aggregate(F.transform("parts", part), F.lit(0.0), lambda a, x: a + x), 6)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return rows.select("query_id", "doc_id", score.alias("score")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
