"""Exact BM25 full-text retrieval over sections, as DataFrame plans.

Sections have `section_id, heading, heading_path (array), text` and scope columns; `index`
adds the index words of heading and text and the row's length. A lane is a phrase match in
all fields or in one; its hits carry the occurrences of each phrase, from which one small
aggregate (the statistics, over the whole index, never the scope) gives document
frequencies and the mean length, and so the scores.

BM25 is that of the SQLite full-text engine: k1 = 1.2, b = 0.75, idf = ln((N - n + 0.5) /
(n + 0.5)), at least 1e-6; n counts rows with the phrase in the lane's fields, lengths count
all fields. Scores are negative: smaller is better.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BOOSTED_IDENTIFIER, index_form_udf, index_tokens, query_tokens
from ..plans.query import MAX_RELAXED, Compiled, Scope, content_terms, index_words, required_terms

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
FIELDS = ("heading", "text")
WEIGHTS = {"heading": 2.0, "heading_path": 1.5, "text": 1.0}
COVERAGE_IDF = 0.45

Phrase = tuple[str, ...]


def index(sections: DataFrame, normalise=index_form_udf) -> DataFrame:
    """sections with heading_words, text_words and n_words."""
    words = {f"{f}_words": index_tokens(normalise(F.coalesce(F.col(f), F.lit("")))) for f in FIELDS}
    return sections.withColumns(words).withColumn("n_words", F.size("heading_words") + F.size("text_words"))


def occurrences(words: Column, phrase: Phrase) -> Column:
    """Times the phrase's words stand next to each other.

    The words are bound to a lambda's variable: they are computed once, even where
    Catalyst puts the tokenizer in the place of the column.
    """
    return F.element_at(F.transform(F.array(words), lambda w: _times(w, phrase)), 1)


def _times(words: Column, phrase: Phrase) -> Column:
    if len(phrase) == 1:
        return F.size(F.filter(words, lambda x: x == phrase[0]))
    whole = F.array(*[F.lit(w) for w in phrase])
    places = F.filter(F.transform(words, lambda x, i: F.when(x == phrase[0], i + 1)), lambda i: i.isNotNull())
    return F.size(F.filter(places, lambda i: F.slice(words, i, len(phrase)) == whole))


def _placed(field: str, phrase: Phrase) -> Column:
    """The same from the places of each word (a map, see `postings.matches`)."""
    none = F.array().cast("array<int>")
    starts = [F.coalesce(F.element_at("places", F.lit(f"{field}:{w}")), none) for w in phrase]

    def moved(c: Column, k: int) -> Column:
        return F.transform(c, lambda i: i - F.lit(k)) if k else c

    return F.size(reduce(F.array_intersect, [moved(c, k) for k, c in enumerate(starts)]))


def phrase_counts(indexed: DataFrame, phrases: list[Phrase], fields: tuple[str, ...] = FIELDS) -> list[Column]:
    """Occurrences of each phrase in the fields; of an index with words, or of the matches of a query."""
    one = _placed if "places" in indexed.columns else lambda f, p: occurrences(F.col(f"{f}_words"), p)
    return [reduce(lambda a, b: a + b, [one(f, p) for f in fields]) for p in phrases]


@dataclass(frozen=True)
class Statistics:
    rows: int
    mean_length: float
    frequencies: tuple[int, ...]

    def idf(self, k: int) -> float:
        n = self.frequencies[k]
        return max(math.log((self.rows - n + 0.5) / (n + 0.5)), LEAST_IDF) if self.rows > n - 0.5 else LEAST_IDF


def gather(indexed: DataFrame, asked: list[tuple[list[Phrase], tuple[str, ...]]], *marks: Column) -> tuple[list[Statistics], list[int]]:
    """One pass, one row: N, mean length, for each (phrases, fields) the rows that hold each phrase in them, and the rows with each mark.

    Matches of a query carry N and the mean length of the index that they come from.
    """
    size = [F.max("corpus_rows"), F.max("corpus_mean")] if "places" in indexed.columns else [F.count(F.lit(1)), F.avg("n_words")]
    counts = [c for phrases, fields in asked for c in phrase_counts(indexed, phrases, fields)]
    n, mean, *found = indexed.agg(*size, *[F.count_if(c > 0) for c in counts], *[F.count_if(m) for m in marks]).first()
    found, out = [f or 0 for f in found], []
    for phrases, _ in asked:
        out.append(Statistics(n or 0, float(mean or 0.0), tuple(found[: len(phrases)])))
        found = found[len(phrases) :]
    return out, found


def statistics(indexed: DataFrame, phrases: list[Phrase], *field_sets: tuple[str, ...]) -> list[Statistics]:
    return gather(indexed, [(phrases, f) for f in field_sets])[0]


def bm25(counts: list[Column], stats: Statistics, length: Column) -> Column:
    part = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / F.lit(stats.mean_length or 1.0))
    terms = [F.lit(stats.idf(k)) * (c * F.lit(K1 + 1)) / (c + part) for k, c in enumerate(counts)]
    return -reduce(lambda a, b: a + b, terms, F.lit(0.0))


def lane(indexed: DataFrame, phrases: list[Phrase], fields: tuple[str, ...] = FIELDS, every: bool = True, where: Column | None = None, limit: int | None = None, stats: Statistics | None = None) -> DataFrame:
    """section_id, fts_score of the rows that hold every (or any) phrase, best first up to `limit`.

    The scope filters rows before the limit; the statistics are those of the whole index.
    """
    stats = stats or statistics(indexed, phrases, fields)[0]
    names = [f"f{k}" for k in range(len(phrases))]
    rows = indexed if where is None else indexed.filter(where)
    hits = rows.select("section_id", "n_words", *[c.alias(n) for c, n in zip(phrase_counts(indexed, phrases, fields), names, strict=True)])
    test = reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), [F.col(n) > 0 for n in names])
    scored = hits.filter(test).select("section_id", bm25([F.col(n) for n in names], stats, F.col("n_words")).alias("fts_score"))
    return scored.orderBy("fts_score", "section_id").limit(limit) if limit else scored


def scope_condition(scope: Scope) -> Column:
    if scope.empty:
        return F.lit(False)
    tests = [F.col("root_id").isin(list(scope.roots))] if scope.roots else []
    tests += [F.col("path").isin(list(scope.globals))] if scope.globals else []
    return reduce(lambda a, b: a | b, tests)


LANES = (FIELDS, ("heading",), ("text",))


def lanes(indexed: DataFrame, compiled: Compiled, scope: Scope, bound: int, variant: int = 0, stats: list[Statistics] | None = None) -> DataFrame:
    """section_id, fts_score, step of all fields, heading and text (LANES), each for the scope and for its global notes."""
    parts = []
    phrases = list(compiled.clauses)
    for n, (fields, stats) in enumerate(zip(LANES, stats or statistics(indexed, phrases, *LANES), strict=True)):
        wheres = [scope_condition(scope)] + ([F.col("path").isin(list(scope.globals))] if scope.globals else [])
        for k, where in enumerate(wheres):
            got = lane(indexed, phrases, fields, where=where, limit=bound, stats=stats)
            parts.append(got.withColumn("step", F.lit(100 * variant + 2 * n + k)))
    return reduce(DataFrame.unionByName, parts)


def merge_lanes(parts: DataFrame, expanded: bool) -> DataFrame:
    """One row for each section: the score of its last lane, or with synonym variants its best."""
    score = F.min("fts_score") if expanded else F.max_by("fts_score", "step")
    return parts.groupBy("section_id").agg(score.alias("fts_score"))


def primary_ranks(indexed: DataFrame, compiled: Compiled, scope: Scope, bound: int) -> DataFrame:
    got = lane(indexed, list(compiled.clauses), where=scope_condition(scope), limit=bound)
    return got.select("section_id", F.row_number().over(Window.orderBy("fts_score", "section_id")).alias("primary_rank"))


def boosts(heading_tokens: Column, body_tokens: Column, tokens: list[str]) -> tuple[Column, Column, Column]:
    """(identifier boost, heading boost, body matches) of the matched tokens."""
    wanted = F.array(*[F.lit(t) for t in dict.fromkeys(tokens)]).cast("array<string>")
    ids = F.filter(wanted, lambda t: t.rlike(f"^{BOOSTED_IDENTIFIER}$"))
    identifier = 2.0 * F.size(F.array_intersect(ids, F.array_union(heading_tokens, body_tokens)))
    return identifier, 0.75 * F.size(F.array_intersect(wanted, heading_tokens)), F.arrays_overlap(wanted, body_tokens)


def reason(is_global: Column, partial: Column, identifier: Column, heading: Column, body: Column) -> Column:
    parts = F.array(F.when(is_global, F.lit("global-note inclusion")), partial, F.when(identifier > 0, F.lit("identifier match")), F.when(heading > 0, F.lit("heading match")), F.when(body, F.lit("body match")))
    joined = F.concat_ws(", ", F.array_compact(parts))
    return F.when(joined == "", "text match").otherwise(joined)


@dataclass(frozen=True)
class Relaxation:
    """The content terms of a query, their phrases, and how many of them a section must cover."""

    terms: tuple[str, ...]
    phrases: tuple[Phrase, ...]
    needed: int


def relaxation(tokens: tuple[str, ...], quoted: bool) -> Relaxation | None:
    """None where the query allows no relaxation."""
    terms = [] if quoted else content_terms(tokens)
    needed = required_terms(len(terms))
    if len(terms) < 2 or needed >= len({t.casefold() for t in tokens}):
        return None
    known = {t: p for t in terms if (p := index_words(t))}
    return Relaxation(tuple(known), tuple(known.values()), needed) if known else None


def relaxed_bound(bound: int) -> int:
    return min(MAX_RELAXED, 4 * bound)


def relaxed_lane(indexed: DataFrame, plan: Relaxation, scope: Scope, bound: int, stats: Statistics, **carry: Column) -> DataFrame:
    """section_id, fts_score, heads, bodies (occurrences of each phrase in heading and text) of the best sections with any phrase."""
    hits = indexed.filter(scope_condition(scope)).select("section_id", "n_words", *[F.array(*phrase_counts(indexed, list(plan.phrases), (f,))).alias(n) for f, n in zip(FIELDS, ("heads", "bodies"), strict=True)], *[c.alias(n) for n, c in carry.items()])
    counts = [F.col("heads")[k] + F.col("bodies")[k] for k in range(len(plan.phrases))]
    some = hits.filter(reduce(lambda a, b: a | b, [c > 0 for c in counts]))
    return some.withColumn("fts_score", bm25(counts, stats, F.col("n_words"))).orderBy("fts_score", "section_id").limit(relaxed_bound(bound))


def covered(rows: DataFrame, plan: Relaxation, stats: Statistics, any_strict: bool, path_tokens: Column) -> DataFrame:
    """Rows of `relaxed_lane` that cover enough terms, with matched, of_terms and weight; beside strict hits they must cover all, one in the heading."""
    idf = [math.log((stats.rows - n + 0.5) / (n + 0.5) + 1.0) for n in stats.frequencies]
    inside = [(F.col("heads")[k] > 0, F.array_contains(path_tokens, t), F.col("bodies")[k] > 0) for k, t in enumerate(plan.terms)]
    weight = [F.when(h, WEIGHTS["heading"]).when(a, WEIGHTS["heading_path"]).when(b, WEIGHTS["text"]).otherwise(0.0) for h, a, b in inside]
    total = lambda cs: reduce(lambda a, b: a + b, cs)
    rows = rows.withColumns({
        "matched": total([(w > 0).cast("int") for w in weight]),
        "of_terms": F.lit(len(plan.terms)),
        "weight": total([w * i for w, i in zip(weight, idf, strict=True)]),
        "matched_idf": total([F.when(w > 0, i).otherwise(0.0) for w, i in zip(weight, idf, strict=True)]),
    })
    ok = (F.col("matched") >= plan.needed) & (F.col("matched_idf") >= COVERAGE_IDF * sum(idf))
    if any_strict:
        ok &= (F.col("matched") == len(plan.terms)) & reduce(lambda a, b: a | b, [h for h, _, _ in inside])
    return rows.filter(ok).drop("matched_idf")


def relaxed(indexed: DataFrame, compiled: Compiled, quoted: bool, scope: Scope, bound: int, fold_tokens=None) -> DataFrame | None:
    """section_id, fts_score, matched, weight of sections that cover enough content terms; None where the query allows no relaxation.

    Two passes over an index with heading_path: one for all statistics, one for the rows.
    Sections in scope with all clauses of the query are its strict hits.
    """
    plan = relaxation(compiled.tokens, quoted)
    if plan is None:
        return None
    strict = reduce(lambda a, b: a & b, [c > 0 for c in phrase_counts(indexed, list(compiled.clauses))])
    (stats,), (n_strict,) = gather(indexed, [(list(plan.phrases), FIELDS)], strict & scope_condition(scope))
    rows = relaxed_lane(indexed, plan, scope, bound, stats, heading_path=F.col("heading_path"), strict=strict).filter(~F.col("strict"))
    path = (fold_tokens or (lambda c: F.transform(query_tokens(c), F.lower)))(F.array_join("heading_path", "\n"))
    return covered(rows, plan, stats, n_strict > 0, path).select("section_id", "fts_score", "matched", "of_terms", "weight")


def atom_matches(indexed: DataFrame, atoms: list[str], scope: Scope) -> DataFrame:
    """section_id, atom: the first (1-based) guard atom whose words the section has next to each other in a field."""
    phrases = [(n, p) for n, a in enumerate(atoms, 1) if (p := index_words(a))]
    if not phrases:
        return indexed.select("section_id", F.lit(0).alias("atom")).filter(F.lit(False))
    counts = phrase_counts(indexed, [p for _, p in phrases])
    first = F.coalesce(*[F.when(c > 0, n) for (n, _), c in zip(phrases, counts, strict=True)])
    return indexed.filter(scope_condition(scope)).select("section_id", first.alias("atom")).filter("atom IS NOT NULL")
