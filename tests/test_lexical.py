"""BM25 lanes against SQLite's full-text engine, postings, relaxed matching."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from strandex.functions.text import query_tokens
from strandex.operators import lexical, postings
from strandex.plans.query import Root, compile_query, guard_atoms, resolve_scope

ROOTS = [Root("a", "p"), Root("b", "q")]
SCHEMA = "section_id string, root_id string, path string, heading string, heading_path array<string>, text string"


def corpus(n=120):
    rnd = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "Straße", "café", "x-12", "a_b", "rare", "omega"]
    rows = []
    for k in range(n):
        text = " ".join(rnd.choice(words[: 4 + k % 7]) for _ in range(rnd.randint(0, 30)))
        heading = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 3)))
        rows.append((f"s{k:03}", "ab"[k % 2], f"n{k % 40}.md", heading, ["Top", heading], text))
    return rows


@pytest.fixture(scope="module")
def indexed(spark):
    return lexical.index(spark.createDataFrame(corpus(), SCHEMA)).cache()


@pytest.fixture(scope="module")
def views(indexed):
    """The index itself, and the matches of a query in its postings."""
    table = postings.postings(indexed).cache()
    n, mean = indexed.agg(F.count(F.lit(1)), F.avg("n_words")).first()
    return lambda words: (indexed, postings.matches(table, words, n, mean))


@pytest.fixture(scope="module")
def fts():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(section_id UNINDEXED, heading, text)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(r[0], r[3], r[5]) for r in corpus()])
    return lambda q: dict(con.execute("SELECT section_id, bm25(t) FROM t WHERE t MATCH ?", (q,)).fetchall())


CASES = [
    ([("alpha",)], lexical.FIELDS, True, "alpha"),
    ([("alpha",), ("gamma",)], lexical.FIELDS, True, "alpha AND gamma"),
    ([("alpha", "beta")], lexical.FIELDS, True, '"alpha beta"'),
    ([("beta",), ("beta",)], lexical.FIELDS, True, "beta AND beta"),
    ([("rare",), ("cafe",)], lexical.FIELDS, False, "rare OR cafe"),
    ([("x", "12")], lexical.FIELDS, True, '"x-12"'),
    ([("a", "b"), ("omega",)], lexical.FIELDS, True, '"a_b" AND omega'),
    ([("alpha",), ("beta",)], ("heading",), True, "heading : (alpha AND beta)"),
    ([("alpha", "alpha")], ("text",), True, 'text : "alpha alpha"'),
    ([("nowhere",)], lexical.FIELDS, True, "nowhere"),
]


@pytest.mark.parametrize("phrases, fields, every, match", CASES)
def test_bm25_is_that_of_sqlite(views, fts, phrases, fields, every, match):
    want = fts(match)
    for view in views({w for p in phrases for w in p}):
        got = {r.section_id: r.fts_score for r in lexical.lane(view, phrases, fields, every).collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_limits_come_after_the_scope(views):
    scope = resolve_scope(ROOTS, ["n1.md"], project="p")
    for view in views({"alpha"}):
        rows = lexical.lane(view, [("alpha",)], where=lexical.scope_condition(scope), limit=7).join(view.select("section_id", "root_id", "path"), "section_id").collect()
        assert len(rows) == 7 and all(r.root_id == "a" or r.path == "n1.md" for r in rows)


def test_postings_on_disk(spark, indexed, tmp_path):
    rows = postings.postings(indexed)
    postings.write(rows, f"{tmp_path}/p", 8, parts=2)
    table = spark.read.parquet(f"{tmp_path}/p")
    assert table.count() == rows.count() and postings.postings_size(rows)["words"] == indexed.agg(F.sum("n_words")).first()[0]
    some = postings.matches(table, ["alpha", "rare"], 120, 9.0, 8)
    scan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in scan or "PartitionFilters: [bucket" in scan
    assert "PushedFilters: [In(term" in scan
    assert some.count() == indexed.filter("array_contains(heading_words, 'alpha') OR array_contains(text_words, 'alpha') OR array_contains(heading_words, 'rare') OR array_contains(text_words, 'rare')").count()
    assert postings.matches(table, [], 120, 9.0).count() == 0
    assert [postings.buckets_for(n) for n in (0, 10**7, 10**12)] == [4, 4, 4096]


def test_empty_index(spark):
    empty = lexical.index(spark.createDataFrame([], SCHEMA))
    assert lexical.lane(empty, [("alpha",)]).count() == 0 and postings.postings(empty).count() == 0


def relaxed(spark, rows, query):
    view = lexical.index(spark.createDataFrame([(i, "a", f"{i}.md", h, p, t) for i, h, p, t in rows], SCHEMA))
    scope = resolve_scope(ROOTS, [], project="p")
    compiled = compile_query(query)
    got = lexical.relaxed(view, compiled, '"' in query, scope, 50, lambda c: query_tokens(F.lower(c)))
    return None if got is None else {r.section_id: (r.matched, r.of_terms) for r in got.collect()}


FILL = [(f"f{n}", "other", ["other"], f"filler text number {n}") for n in range(12)]


def test_relaxed_matching(spark):
    target = ("t", "Frontmatter", ["Vault Conventions", "Frontmatter"], "keys of a note")
    assert relaxed(spark, [*FILL, target], "what are the vault conventions for frontmatter") == {"t": (3, 3)}
    # a near miss without the rare term, a lone word, a quoted query
    near = ("n", "mail", ["mail"], "the email provider is set here")
    some = [(f"e{n}", "mail", ["mail"], "email provider notes") for n in range(8)]
    assert relaxed(spark, [*FILL, near, *some, ("r", "x", ["x"], "postmark")], "which postmark email provider") == {}
    assert relaxed(spark, [*FILL, target], "what about that frontmatter") is None
    assert relaxed(spark, [*FILL, target], 'what are "vault conventions" for frontmatter') is None
    assert relaxed(spark, [*FILL, target], "vault conventions") is None


def test_relaxed_beside_strict_hits(spark):
    strict = ("s", "plan", ["plan"], "what is the cache budget")
    body = ("b", "other", ["other"], "cache and budget here")
    anchored = ("h", "cache", ["cache"], "on budget")
    assert relaxed(spark, [*FILL, strict, body, anchored], "what is the cache budget") == {"h": (2, 2)}


def test_last_lane_wins_without_variants(spark):
    view = lexical.index(spark.createDataFrame([(i, "a", f"{i}.md", h, p, t) for i, h, p, t in [*FILL, ("x", "alpha", ["alpha"], "alpha beta"), ("y", "alpha", ["alpha"], "none")]], SCHEMA))
    parts = lexical.lanes(view, compile_query("alpha"), resolve_scope(ROOTS, [], project="p"), 50)
    got = {r.section_id: r.fts_score for r in lexical.merge_lanes(parts, False).collect()}
    lane = lambda f: {r.section_id: r.fts_score for r in lexical.lane(view, [("alpha",)], f).collect()}
    assert got["x"] == lane(("text",))["x"] and got["y"] == lane(("heading",))["y"]
    best = {r.section_id: r.fts_score for r in lexical.merge_lanes(parts, True).collect()}
    assert best["x"] == min(lane(f)["x"] for f in (lexical.FIELDS, ("heading",), ("text",)))


def test_guard_atoms_match_as_phrases(views):
    atoms = guard_atoms('"alpha beta" x-12')
    scope = resolve_scope(ROOTS, [], all_projects=True)
    both = [{(r.section_id, r.atom) for r in lexical.atom_matches(v, atoms, scope).collect()} for v in views({"alpha", "beta", "x", "12"})]
    assert both[0] == both[1] and {a for _, a in both[0]} == {1, 2}
