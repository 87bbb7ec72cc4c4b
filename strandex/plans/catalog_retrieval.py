"""Queries for lexical, vector and fused retrieval.

The product path folds text in Python; these queries use `lower`, which DuckDB has too,
so that the same rows can be had from SQL.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import index_tokens, query_tokens
from ..functions.vectors import is_valid
from ..operators import lexical, vector
from ..operators.fusion import fuse
from ..operators.search import batch_all_terms, isolated_search
from ..sources.conversations import path_of
from .query import Root, Synonyms, compile_query, guard_atoms, query_variants, resolve_scope
from .registry import query, table

ROLES = [Root("user", "talk"), Root("assistant", "talk"), Root("system", "setup")]
ONE, TWO = "nicht", "auch"
WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


def doc_index(spark, sf_dir):
    """documents as an index without headings."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("section_id"), F.lit("").alias("heading"), F.array().cast("array<string>").alias("heading_path"), "text", F.col("source").alias("root_id"), F.concat(F.lit("doc/"), "doc_id").alias("path"))
    return lexical.index(d, F.lower)


def turn_index(spark, sf_dir):
    """Turns of conversations; the heading is the role and the turn's first two words."""
    c = table(spark, sf_dir, "conversations")
    w = index_tokens(F.lower("text"))
    heading = F.concat_ws(" ", "role", F.array_join(F.slice(w, 1, 2), " "))
    d = c.select(F.concat_ws("-", "conv_id", "turn").alias("section_id"), heading.alias("heading"), F.array(F.concat(F.lit("Conversation "), "conv_id"), heading).alias("heading_path"), "text", F.col("role").alias("root_id"), path_of(F.col("conv_id")).alias("path"))
    return lexical.index(d, F.lower)


DOCS = f"idx AS (SELECT doc_id::VARCHAR AS section_id, source AS root_id, 'doc/' || doc_id AS path, [] AS hw, {WORDS.format('text')} AS tw FROM documents)"
TURNS = f"""idx0 AS (SELECT conv_id || '-' || turn AS section_id, conv_id, role, role AS root_id, printf('conv/%08d.md', conv_id) AS path, {WORDS.format("text")} AS tw FROM conversations),
idx AS (SELECT section_id, conv_id, root_id, path, tw, list_concat([role], tw[1:2]) AS hw FROM idx0)"""


def _times(words: str, phrase: tuple[str, ...]) -> str:
    if len(phrase) == 1:
        return f"len(list_filter({words}, lambda x: x = '{phrase[0]}'))"
    tests = " AND ".join(f"{words}[i + {k}] = '{w}'" for k, w in enumerate(phrase))
    return f"len(list_filter(range(1, len({words}) + 1), lambda i: coalesce({tests}, false)))"


def _score(n: int, prefix: str = "f") -> str:
    idf = [f"CASE WHEN ln((c - n{k} + 5e-1) / (n{k} + 5e-1)) > 0 THEN ln((c - n{k} + 5e-1) / (n{k} + 5e-1)) ELSE 1e-6 END" for k in range(n)]
    return "-(" + " + ".join(f"({idf[k]}) * ({prefix}{k} * 2.2e0) / ({prefix}{k} + 1.2e0 * (25e-2 + 75e-2 * len_ / m))" for k in range(n)) + ")"


def bm25_sql(name: str, phrases: list[tuple[str, ...]], fields: tuple[str, ...] = ("hw", "tw"), every: bool = True, where: str = "true", limit: int | None = None) -> str:
    """CTEs; the last, `name`, has section_id, fts_score."""
    counts = ", ".join(" + ".join(_times(f, p) for f in fields) + f" AS f{k}" for k, p in enumerate(phrases))
    stats = ", ".join(f"count_if(f{k} > 0) AS n{k}" for k in range(len(phrases)))
    test = (" AND " if every else " OR ").join(f"f{k} > 0" for k in range(len(phrases)))
    end = f" ORDER BY fts_score, section_id LIMIT {limit}" if limit else ""
    return f"""{name}_h AS (SELECT section_id, root_id, path, len(hw) + len(tw) AS len_, {counts} FROM idx),
{name}_s AS (SELECT count(*) AS c, avg(len_) AS m, {stats} FROM {name}_h),
{name} AS (SELECT section_id, {_score(len(phrases))} AS fts_score FROM {name}_h, {name}_s WHERE ({test}) AND ({where}){end})"""


ROUNDED = "section_id, round(fts_score, 6) AS fts_score"


def rounded(df):
    return df.select("section_id", F.round("fts_score", 6).alias("fts_score"))


@query(f"WITH {DOCS}, {bm25_sql('r', [(ONE,)])} SELECT {ROUNDED} FROM r")
def bm25_single_term(spark, sf_dir):
    return rounded(lexical.lane(doc_index(spark, sf_dir), [(ONE,)]))


@query(f"WITH {DOCS}, {bm25_sql('r', [(ONE,), (TWO,)], limit=20)} SELECT {ROUNDED} FROM r")
def bm25_strict_and(spark, sf_dir):
    """The best 20 documents with both words."""
    compiled = compile_query(f"{ONE} {TWO}")
    return rounded(lexical.lane(doc_index(spark, sf_dir), list(compiled.clauses), limit=20))


@query(f"WITH {DOCS}, {bm25_sql('r', [(ONE,), ('avec',), ('para',)], every=False, limit=50)} SELECT {ROUNDED} FROM r")
def bm25_or_topk(spark, sf_dir):
    return rounded(lexical.lane(doc_index(spark, sf_dir), [(ONE,), ("avec",), ("para",)], every=False, limit=50))


@query(f"WITH {TURNS}, {bm25_sql('r', [('the',)], ('hw',))} SELECT {ROUNDED} FROM r")
def bm25_heading_lane(spark, sf_dir):
    return rounded(lexical.lane(turn_index(spark, sf_dir), [("the",)], ("heading",)))


@query(f"WITH {TURNS}, {bm25_sql('r', [('the',), ('of',)], ('tw',))} SELECT {ROUNDED} FROM r")
def bm25_text_lane(spark, sf_dir):
    return rounded(lexical.lane(turn_index(spark, sf_dir), [("the",), ("of",)], ("text",)))


GLOBAL = "conv/00000003.md"
SCOPE = f"(root_id IN ('user', 'assistant') OR path IN ('{GLOBAL}'))"


def _lanes_sql(phrases: list[tuple[str, ...]], bound: int, tag: str = "") -> tuple[str, str]:
    parts, union = [], []
    for n, fields in enumerate((("hw", "tw"), ("hw",), ("tw",))):
        for k, where in enumerate((SCOPE, f"path IN ('{GLOBAL}')")):
            name = f"l{tag}{n}{k}"
            parts.append(bm25_sql(name, phrases, fields, where=where, limit=bound))
            union.append(f"SELECT section_id, fts_score, {2 * n + k} AS step FROM {name}")
    return ", ".join(parts), " UNION ALL ".join(union)


def _scope():
    return resolve_scope(ROLES, [GLOBAL], project="talk")


_L = _lanes_sql([("the",), ("of",)], 50)


@query(f"WITH {TURNS}, {_L[0]}, u AS ({_L[1]}) SELECT section_id, round(arg_max(fts_score, step), 6) AS fts_score FROM u GROUP BY section_id")
def lane_union_last_wins(spark, sf_dir):
    parts = lexical.lanes(turn_index(spark, sf_dir), compile_query("the of"), _scope(), 50)
    return rounded(lexical.merge_lanes(parts, expanded=False))


SYNONYMS = Synonyms.from_terms(1, {"the": ["of", "and"]})
_S = [_lanes_sql([("the",), ("with",)], 50, "a"), _lanes_sql([("and",), ("with",)], 50, "b"), _lanes_sql([("of",), ("with",)], 50, "c")]


@query(f"WITH {TURNS}, {', '.join(s[0] for s in _S)}, u AS ({' UNION ALL '.join(s[1] for s in _S)}) SELECT section_id, round(min(fts_score), 6) AS fts_score FROM u GROUP BY section_id")
def synonym_expanded_search(spark, sf_dir):
    idx, forms = turn_index(spark, sf_dir), ["the with", *query_variants("the with", SYNONYMS)]
    parts = lexical.lanes(idx, compile_query(forms[0]), _scope(), 50)
    for n, f in enumerate(forms[1:], 1):
        parts = parts.unionByName(lexical.lanes(idx, compile_query(f), _scope(), 50, n))
    return rounded(lexical.merge_lanes(parts, expanded=True))


@query(f"WITH {DOCS}, f AS (SELECT section_id, {_times('tw', ('of', 'the'))} AS times FROM idx) SELECT section_id, times::BIGINT AS times FROM f WHERE times > 0")
def phrase_match(spark, sf_dir):
    idx = doc_index(spark, sf_dir)
    return idx.select("section_id", lexical.occurrences(F.col("text_words"), ("of", "the")).cast("long").alias("times")).filter("times > 0")


@query(f"""WITH {TURNS}, m AS (SELECT section_id, {_times("hw", ("of", "the"))} + {_times("tw", ("of", "the"))} AS a, {_times("hw", ("and", "1"))} + {_times("tw", ("and", "1"))} AS b FROM idx WHERE {SCOPE})
SELECT section_id, (CASE WHEN a > 0 THEN 1 ELSE 2 END)::BIGINT AS atom FROM m WHERE a > 0 OR b > 0""")
def guard_atom_matches(spark, sf_dir):
    atoms = guard_atoms('why "of  THE" and-1 now')
    return lexical.atom_matches(turn_index(spark, sf_dir), atoms, _scope()).select("section_id", F.col("atom").cast("long").alias("atom"))


_idf = lambda k: f"ln((c - n{k} + 5e-1) / (n{k} + 5e-1) + 1e0)"


def _relaxed_sql(terms: list[str], where: str, strict_hits: str, path: str) -> str:
    """Rows of the OR lane that cover enough terms; `x` is its bound."""
    n = len(terms)
    inside = [f"CASE WHEN {_times('hw', (t,))} > 0 THEN 2e0 WHEN list_contains({path}, '{t}') THEN 15e-1 WHEN {_times('tw', (t,))} > 0 THEN 1e0 ELSE 0e0 END" for t in terms]
    weights = ", ".join(f"{w} AS w{k}" for k, w in enumerate(inside))
    heads = " OR ".join(f"{_times('hw', (t,))} > 0" for t in terms)
    need = n if n <= 2 else max(2, -(-n // 2))
    matched, midf = " + ".join(f"(w{k} > 0)::INT" for k in range(n)), " + ".join(f"CASE WHEN w{k} > 0 THEN {_idf(k)} ELSE 0e0 END" for k in range(n))
    return f"""{bm25_sql("o", [(t,) for t in terms], every=False, where=where, limit=200)},
w AS (SELECT i.section_id, {weights}, ({heads}) AS anchored FROM idx i JOIN o USING (section_id)),
v AS (SELECT o.section_id, o.fts_score, {matched} AS matched, {midf} AS midf, {" + ".join(_idf(k) for k in range(n))} AS total, {" + ".join(f"w{k} * {_idf(k)}" for k in range(n))} AS weight, anchored
  FROM o JOIN w USING (section_id), o_s WHERE o.section_id NOT IN (SELECT section_id FROM strict))
SELECT section_id, round(fts_score, 6) AS fts_score, matched::BIGINT AS matched, round(weight, 6) AS weight FROM v WHERE matched >= {need} AND midf >= 45e-2 * total AND ({strict_hits})"""


def _relaxed_rows(df):
    return df.select("section_id", F.round("fts_score", 6).alias("fts_score"), F.col("matched").cast("long").alias("matched"), F.round("weight", 6).alias("weight"))


@query(f"WITH {DOCS}, strict AS (SELECT '' AS section_id WHERE false), {_relaxed_sql(['nicht', 'auch', 'eine', 'dem'], 'true', 'true', '[]')}")
def relaxed_match(spark, sf_dir):
    """A question whose words no document holds together: documents with enough of its content words."""
    idx = doc_index(spark, sf_dir)
    scope = resolve_scope([Root(f"src{n}", "all") for n in range(20)], [], all_projects=True)
    compiled = compile_query("what is nicht auch eine dem doing")
    return _relaxed_rows(lexical.relaxed(idx, compiled, False, scope, 50, lambda c: query_tokens(F.lower(c))))


@query(f"WITH {TURNS}, {bm25_sql('strict', [('was',), ('die',), ('und',)], where=SCOPE)}, {_relaxed_sql(['die', 'und'], SCOPE, '(SELECT count(*) FROM strict) = 0 OR (matched = 2 AND anchored)', 'list_distinct(list_concat([' + chr(39) + 'conversation' + chr(39) + ', conv_id::VARCHAR], hw))')}")
def relaxed_after_strict(spark, sf_dir):
    idx, scope = turn_index(spark, sf_dir), _scope()
    compiled = compile_query("was die und")
    return _relaxed_rows(lexical.relaxed(idx, compiled, False, scope, 50, lambda c: query_tokens(F.lower(c))))


_B = bm25_sql("r", [("the",), ("user",)])


_R = _lanes_sql([("the",), ("user",)], 50, "r")


@query(f"""WITH {TURNS}, {_R[0]}, u AS ({_R[1]}), r AS (SELECT section_id, arg_max(fts_score, step) AS fts_score FROM u GROUP BY section_id),
x AS (SELECT section_id, fts_score, CASE WHEN list_contains(hw, 'the') THEN 75e-2 ELSE 0e0 END + CASE WHEN list_contains(hw, 'user') THEN 75e-2 ELSE 0e0 END AS hb,
    list_contains(tw, 'the') OR list_contains(tw, 'user') AS inside, path = '{GLOBAL}' AS g FROM r JOIN idx USING (section_id)),
y AS (SELECT section_id, -fts_score + hb AS score, concat_ws(', ', CASE WHEN g THEN 'global-note inclusion' END, CASE WHEN hb > 0 THEN 'heading match' END, CASE WHEN inside THEN 'body match' END) AS reason FROM x)
SELECT section_id, round(score, 6) AS score, CASE WHEN reason = '' THEN 'text match' ELSE reason END AS reason, row_number() OVER (ORDER BY round(score, 9) DESC, section_id) AS lexical_rank FROM y QUALIFY lexical_rank <= 50""")
def lexical_ranked(spark, sf_dir):
    """The whole lexical operator for one query: lanes with their bound, last lane wins, boosts, reasons, order."""
    idx = turn_index(spark, sf_dir)
    parts = lexical.lanes(idx, compile_query("the user"), _scope(), 50)
    rows = lexical.merge_lanes(parts, expanded=False).join(idx, "section_id")
    ident, head, inside = lexical.boosts(F.col("heading_words"), F.col("text_words"), ["the", "user"])
    rows = rows.select("section_id", (-F.col("fts_score") + ident + head).alias("score"), lexical.reason(F.col("path") == GLOBAL, F.lit(None).cast("string"), ident, head, inside).alias("reason"))
    best = rows.orderBy(F.desc(F.round("score", 9)), "section_id").limit(50)
    return best.select("section_id", F.round("score", 6).alias("score"), "reason", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "section_id")).cast("long").alias("lexical_rank"))


@query(f"""WITH {TURNS}, {_B}, x AS (SELECT section_id, fts_score, CASE WHEN list_contains(hw, 'the') THEN 75e-2 ELSE 0e0 END + CASE WHEN list_contains(hw, 'user') THEN 75e-2 ELSE 0e0 END AS hb,
    list_contains(tw, 'the') OR list_contains(tw, 'user') AS inside, path = '{GLOBAL}' AS g FROM r JOIN idx USING (section_id)),
y AS (SELECT section_id, round(-fts_score + hb, 6) AS score, concat_ws(', ', CASE WHEN g THEN 'global-note inclusion' END, CASE WHEN hb > 0 THEN 'heading match' END, CASE WHEN inside THEN 'body match' END) AS reason FROM x)
SELECT section_id, score, CASE WHEN reason = '' THEN 'text match' ELSE reason END AS reason, row_number() OVER (ORDER BY score DESC, section_id) AS lexical_rank FROM y QUALIFY lexical_rank <= 200""")
def boosts_and_reasons(spark, sf_dir):
    """The lexical order of a query's best 200 sections, with boosts and reasons."""
    idx = turn_index(spark, sf_dir)
    rows = lexical.lane(idx, [("the",), ("user",)]).join(idx, "section_id")
    ident, head, inside = lexical.boosts(F.col("heading_words"), F.col("text_words"), ["the", "user"])
    rows = rows.select("section_id", F.round(-F.col("fts_score") + ident + head, 6).alias("score"), lexical.reason(F.col("path") == GLOBAL, F.lit(None).cast("string"), ident, head, inside).alias("reason"))
    best = rows.orderBy(F.desc("score"), "section_id").limit(200)
    return best.withColumn("lexical_rank", F.row_number().over(Window.orderBy(F.desc("score"), "section_id")).cast("long"))


# --- vectors


def vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("section_id"), F.col("embedding").alias("vector"), "label", "vec_id")


def query_vector(spark, sf_dir, vec_id: int) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"])


def _dot(a: str, b: str) -> str:
    return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"


Q0 = "q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), qn AS (SELECT list_transform(q::DOUBLE[], lambda x: x / sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[]))) AS q FROM q)"


@query(f"WITH {Q0} SELECT vec_id::VARCHAR AS section_id, round({_dot('embedding', 'q')}, 6) AS vector_score FROM embeddings, qn ORDER BY vector_score DESC, section_id LIMIT 50")
def cosine_topk(spark, sf_dir):
    return vector.cosine(vectors(spark, sf_dir), query_vector(spark, sf_dir, 0), limit=50, digits=6)


@query(f"WITH {Q0} SELECT vec_id::VARCHAR AS section_id, round({_dot('embedding', 'q')}, 6) AS vector_score FROM embeddings, qn WHERE label IN (2, 5) ORDER BY vector_score DESC, section_id LIMIT 50")
def cosine_topk_scoped(spark, sf_dir):
    return vector.cosine(vectors(spark, sf_dir), query_vector(spark, sf_dir, 0), F.col("label").isin(2, 5), 50, 6)


@query(f"""WITH q AS (SELECT vec_id AS query_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt({_dot("embedding", "embedding")})) AS q FROM embeddings WHERE vec_id % 100 = 0)
SELECT query_id, vec_id::VARCHAR AS section_id, round({_dot("embedding", "q")}, 6) AS vector_score, row_number() OVER (PARTITION BY query_id ORDER BY round({_dot("embedding", "q")}, 6) DESC, vec_id::VARCHAR) AS vector_rank
FROM embeddings, q QUALIFY vector_rank <= 20""")
def cosine_batch(spark, sf_dir):
    """The stated query set, every vector whose id 100 divides, against all vectors: the best 20 of each."""
    rows = vectors(spark, sf_dir)
    queries = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    return vector.cosine_batch(rows, queries, 20).withColumn("vector_rank", F.col("vector_rank").cast("long"))


@query("SELECT label, count(*) AS n, count_if(vec_id % 7 <> 0 AND vec_id % 11 <> 0)::BIGINT AS valid FROM embeddings GROUP BY label")
def vector_validity(spark, sf_dir):
    v = F.when(F.col("vec_id") % 7 == 0, F.slice("vector", 1, 63)).when(F.col("vec_id") % 11 == 0, F.transform("vector", lambda x: x * F.lit(float("nan")).cast("float"))).otherwise(F.col("vector"))
    return vectors(spark, sf_dir).select("label", is_valid(v, 64).alias("ok")).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("valid"))


@query(f"""WITH {Q0}, s AS (SELECT vec_id, label, round({_dot("embedding", "q")}, 6) AS v FROM embeddings, qn), b AS (SELECT max(v) AS b FROM s WHERE label = 4)
SELECT vec_id::VARCHAR AS section_id, v AS vector_score FROM s, b WHERE v >= 5e-2 AND (label = 4 OR v >= greatest(5e-2, 7e-1 * b))""")
def semantic_floors(spark, sf_dir):
    scored = vector.cosine(vectors(spark, sf_dir), query_vector(spark, sf_dir, 0), digits=6)
    kept = vector.relative_floor(scored, vectors(spark, sf_dir).filter("label = 4"), 0.05, 0.7)
    return kept.filter("vector_score >= 0.05").select("section_id", "vector_score")


@query("SELECT event_id FROM events WHERE NOT (event_type <> 'click' AND user_id % 3 = 1)")
def ticket_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    note = F.concat_ws(" ", F.lit("seen in CLICK-1"), F.when((F.col("event_type") != "click") & (F.col("user_id") % 3 == 1), F.concat(F.upper("event_type"), F.lit("-"), "user_id")))
    return vector.same_ticket(e.withColumn("note", note), ["click-1"], F.col("note")).select("event_id")


# --- fusion: a lexical lane of documents and a semantic lane of vectors with the same ids


def two_lanes(spark, sf_dir):
    lex = lexical.lane(doc_index(spark, sf_dir), [("the",), ("with",)], every=False, limit=60)
    lex = lex.select(F.lit(1).alias("query_id"), "section_id", F.row_number().over(Window.orderBy("fts_score", "section_id")).alias("lexical_rank"))
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("section_id"))
    near = vector.cosine(vectors(spark, sf_dir).join(ids, "section_id", "left_semi"), query_vector(spark, sf_dir, 0), limit=60, digits=6)
    sem = near.select(F.lit(1).alias("query_id"), "section_id", F.row_number().over(Window.orderBy(F.desc("vector_score"), "section_id")).alias("vector_rank"), "vector_score")
    return lex, sem


def _fuse_sql(interleave: bool, order: str, protected: bool = False) -> str:
    key = "ordinal, lane" if interleave else "lane, ordinal"
    prot = "LEFT JOIN (SELECT section_id, 1 AS atom FROM lex WHERE r % 9 = 4) p USING (section_id)" if protected else "LEFT JOIN (SELECT '' AS section_id, NULL::INT AS atom WHERE false) p USING (section_id)"
    return f"""WITH {DOCS}, {bm25_sql("o", [("the",), ("with",)], every=False, limit=60)}, {Q0},
lex AS (SELECT section_id, row_number() OVER (ORDER BY fts_score, section_id) AS r FROM o),
near AS (SELECT vec_id::VARCHAR AS section_id, round({_dot("embedding", "q")}, 6) AS v FROM embeddings, qn WHERE vec_id IN (SELECT doc_id FROM documents) ORDER BY v DESC, section_id LIMIT 60),
sem AS (SELECT section_id, v, row_number() OVER (ORDER BY v DESC, section_id) AS r FROM near),
rows_ AS (SELECT section_id, 0 AS lane, r AS ordinal, NULL::DOUBLE AS v FROM lex UNION ALL SELECT section_id, 1, r, v FROM sem),
pos AS (SELECT *, row_number() OVER (ORDER BY {key}) AS pos FROM rows_),
fst AS (SELECT *, min(pos) OVER (PARTITION BY section_id) AS first FROM pos),
run AS (SELECT *, sum((pos = first)::INT) OVER (ORDER BY pos) AS d FROM fst),
lim AS (SELECT coalesce(min(pos), 1000000) AS stop FROM run WHERE pos = first AND d > 80),
adm AS (SELECT section_id, min(CASE WHEN pos = first THEN lane END) AS l0, max(CASE WHEN lane = 0 THEN ordinal END) AS lr, max(CASE WHEN lane = 1 THEN ordinal END) AS vr FROM run, lim WHERE pos < stop GROUP BY section_id),
crd AS (SELECT section_id, CASE WHEN l0 = 0 THEN lr END AS lexical_rank, vr AS vector_rank FROM adm),
sco AS (SELECT c.section_id, lexical_rank, vector_rank, coalesce(1e0 / (60 + lexical_rank), 0e0) + coalesce(1e0 / (60 + vector_rank), 0e0) AS s, CASE WHEN lexical_rank IS NOT NULL THEN atom END AS atom FROM crd c {prot})
SELECT section_id, row_number() OVER (ORDER BY atom IS NULL, CASE WHEN atom IS NOT NULL THEN lexical_rank END, {order}, coalesce(lexical_rank, 201), coalesce(vector_rank, 201), section_id) AS rank, round(s, 9) AS fused_score,
  CASE WHEN lexical_rank IS NOT NULL AND vector_rank IS NOT NULL THEN 'lexical+semantic' WHEN lexical_rank IS NOT NULL THEN 'lexical' ELSE 'semantic' END AS lane FROM sco QUALIFY rank <= 50"""


def _fused(df):
    return df.select("section_id", F.col("rank").cast("long").alias("rank"), F.round("fused_score", 9).alias("fused_score"), "lane")


@query(_fuse_sql(True, "s DESC"))
def rrf_fuse_unguarded(spark, sf_dir):
    lex, sem = two_lanes(spark, sf_dir)
    return _fused(fuse(lex, sem, 80, 50))


@query(_fuse_sql(False, "lexical_rank IS NULL"))
def rrf_fuse_guarded(spark, sf_dir):
    lex, sem = two_lanes(spark, sf_dir)
    return _fused(fuse(lex, sem, 80, 50, guarded=True))


@query(_fuse_sql(False, "lexical_rank IS NULL", protected=True))
def protected_first(spark, sf_dir):
    lex, sem = two_lanes(spark, sf_dir)
    marks = lex.filter("lexical_rank % 9 = 4").select("query_id", "section_id", F.lit(1).alias("atom"), F.col("lexical_rank").alias("primary_rank"))
    return _fused(fuse(lex, sem, 80, 50, guarded=True, protected=marks))


# --- batches


@query(r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
q AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')[1:64]) AS t FROM benchmark),
s AS (SELECT count(*) AS n, avg(len(w)) AS m FROM d),
asked AS (SELECT DISTINCT unnest(t) AS term FROM q), df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(w) AS term FROM d) JOIN asked USING (term) GROUP BY term),
c AS (SELECT query_id, doc_id, t, w FROM q, d WHERE list_has_all(w, t)),
p AS (SELECT query_id, doc_id, len(w) AS len_, unnest(t) AS term, w FROM c),
f AS (SELECT query_id, doc_id, term, len_, len(list_filter(w, lambda x: x = term)) AS tf FROM p),
r AS (SELECT query_id, doc_id, round(sum(greatest(ln((n - df + 5e-1) / (df + 5e-1)), 1e-6) * (tf * 2.2e0) / (tf + 1.2e0 * (25e-2 + 75e-2 * len_ / m)) ORDER BY term), 6) AS score FROM f JOIN df USING (term), s GROUP BY query_id, doc_id)
SELECT query_id, count(*) AS n_hits, round(max(score), 3) AS best FROM r GROUP BY query_id""")
def batch_search(spark, sf_dir):
    """Every benchmark item as a query of its words (at most 64, as any query) against all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", index_tokens(F.lower("text")).alias("words"))
    terms = F.array_distinct(F.slice(index_tokens(F.lower("text")), 1, 64))
    rows = batch_all_terms(docs, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), terms.alias("terms")), k=1 << 30)
    return rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"), F.round(F.max("score"), 3).alias("best"))


@query(r"""WITH d AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM conversations),
q AS (SELECT conv_id AS query_id, conv_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS t FROM conversations WHERE turn = 1),
s AS (SELECT conv_id, count(*) AS n, avg(len(w)) AS m FROM d GROUP BY conv_id),
p AS (SELECT query_id, d.conv_id, turn, len(w) AS len_, unnest(t) AS term, w FROM d JOIN q USING (conv_id)),
f AS (SELECT query_id, conv_id, turn, len_, term, len(list_filter(w, lambda x: x = term)) AS tf FROM p),
g AS (SELECT *, count(*) OVER (PARTITION BY query_id, term) AS df FROM f WHERE tf > 0),
r AS (SELECT query_id, turn, round(sum(greatest(ln((n - df + 5e-1) / (df + 5e-1)), 1e-6) * (tf * 2.2e0) / (tf + 1.2e0 * (25e-2 + 75e-2 * len_ / m))), 6) AS score FROM g JOIN s USING (conv_id) GROUP BY query_id, turn)
SELECT query_id, turn, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, turn) AS rank FROM r QUALIFY rank <= 3""")
def conversation_search(spark, sf_dir):
    """The second turn of each conversation as a query within that conversation alone: its best three turns."""
    c = table(spark, sf_dir, "conversations").withColumn("words", index_tokens(F.lower("text")))
    asked = c.filter("turn = 1").select(F.col("conv_id").alias("query_id"), "conv_id", F.array_distinct("words").alias("terms"))
    rows = isolated_search(c.select("conv_id", F.col("turn").alias("doc_id"), "words"), asked, 3)
    return rows.select("query_id", F.col("doc_id").alias("turn"), F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))
