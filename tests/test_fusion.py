"""Fusion against the stated rules as a loop, and its policies by hand."""

import random

import pytest

from pyspark.sql import functions as F

from strandex.operators.fusion import fuse
from strandex.operators.vector import cosine, cosine_batch, normalise_vectors, relative_floor, same_ticket


def lanes(spark, lex, sem):
    a = spark.createDataFrame([(1, s, n) for n, s in enumerate(lex, 1)], "query_id int, section_id string, lexical_rank int")
    b = spark.createDataFrame([(1, s, n, v) for n, (s, v) in enumerate(sem, 1)], "query_id int, section_id string, vector_rank int, vector_score double")
    return a, b


def by_loop(lex, sem, bound, limit, guarded):
    a, b = [(s, n, None) for n, s in enumerate(lex, 1)], [(s, None, n) for n, (s, _) in enumerate(sem, 1)]
    order = a + b if guarded else [x for i in range(max(len(a), len(b))) for x in (a[i : i + 1] + b[i : i + 1])]
    got = {}
    for s, l, v in order:
        if s in got:
            if v is not None:
                got[s] = (got[s][0], v)
        elif len(got) >= bound:
            break
        else:
            got[s] = (l, v)
    score = lambda r: sum(1 / (60 + x) for x in r if x is not None)
    last = lambda x: 201 if x is None else x
    key = (lambda s: (got[s][0] is None, last(got[s][0]), last(got[s][1]), s)) if guarded else (lambda s: (-score(got[s]), last(got[s][0]), last(got[s][1]), s))
    return [(s, *got[s]) for s in sorted(got, key=key)[:limit]]


@pytest.mark.parametrize("guarded", [False, True])
def test_same_as_the_loop(spark, guarded):
    rnd = random.Random(8)
    for n in range(6):
        ids = [f"s{k:02}" for k in range(30)]
        lex, sem = rnd.sample(ids, rnd.randint(0, 20)), [(s, 0.9) for s in rnd.sample(ids, rnd.randint(0, 20))]
        bound = rnd.choice([5, 12, 40])
        a, b = lanes(spark, lex, sem)
        got = [(r.section_id, r.lexical_rank, r.vector_rank) for r in fuse(a, b, bound, 10, guarded).orderBy("rank").collect()]
        assert got == by_loop(lex, sem, bound, 10, guarded), n


def test_semantic_first_gains_no_lexical_credit(spark):
    a, b = lanes(spark, ["p", "q", "r", "s", "x"], [("x", 0.9)])
    row = next(r for r in fuse(a, b, 50, 10).collect() if r.section_id == "x")
    assert (row.lane, row.lexical_rank, row.vector_rank, row.guard_reason) == ("semantic", None, 1, "not-applicable:candidate")
    row = next(r for r in fuse(*lanes(spark, ["x"], [("x", 0.9)]), 50, 10).collect())
    assert (row.lane, row.fused_score) == ("lexical+semantic", pytest.approx(2 / 61))


def test_low_semantic_rows_take_no_part(spark):
    a, b = lanes(spark, ["p", "q", "x"], [("x", 0.1)])
    row = next(r for r in fuse(a, b, 50, 10, floor=0.3).collect() if r.section_id == "x")
    assert (row.lane, row.lexical_rank) == ("lexical", 3)


def test_balanced_admission(spark):
    a, b = lanes(spark, [f"l{n:02}" for n in range(50)], [("v", 0.9)])
    names = lambda **k: {r.section_id for r in fuse(a, b, 50, 50, **k).collect()}
    assert "v" in names() and "v" not in names(balanced=False)


def test_protected_rows_come_first(spark):
    a, b = lanes(spark, ["c", "a", "b", "d"], [("b", 0.9), ("c", 0.8), ("a", 0.7), ("d", 0.6)])
    marks = spark.createDataFrame([(1, s, 1, n) for s, n in (("d", 1), ("b", 2))] + [(1, "z", 1, 3), (1, "a", 2, None)], "query_id int, section_id string, atom int, primary_rank int")
    got = [(r.section_id, r.guard_reason) for r in fuse(a, b, 50, 10, True, protected=marks).orderBy("rank").collect()]
    assert got == [("b", "protected:atom-1"), ("d", "protected:atom-1"), ("c", "not-protected:guard-active"), ("a", "not-protected:guard-active")]
    none = [r.guard_reason for r in fuse(a, b, 50, 10, True).collect()]
    assert set(none) == {"bypassed:no-protected-hit:candidate"}


def test_relative_floor(spark):
    sem = spark.createDataFrame([("a", 0.69), ("b", 0.70), ("l", 0.99)], "section_id string, vector_score double")
    lex = spark.createDataFrame([("l",)], "section_id string")
    names = lambda *k: {r.section_id for r in relative_floor(sem, lex, *k).collect()}
    assert names(None, 0.7) == {"b", "l"} and names(None, None) == {"a", "b", "l"}
    assert {r.section_id for r in relative_floor(sem, lex.filter("false"), 0.3, 0.7).collect()} == {"a", "b", "l"}


def test_tickets(spark):
    rows = spark.createDataFrame([("a", "on PAUS-4"), ("b", "see PHO-123"), ("c", "plain")], "section_id string, t string")
    assert {r.section_id for r in same_ticket(rows, ["paus-4"], rows.t).collect()} == {"a", "c"}
    assert same_ticket(rows, [], rows.t).count() == 3


def test_cosine_in_blocks(spark):
    rnd = random.Random(1)
    data = [(f"v{n:03}", [rnd.gauss(0, 1) for _ in range(8)]) for n in range(90)] + [("bad", [1.0]), ("nan", [float("nan")] * 8), ("null", None), ("w", [1.0] * 8), ("x", [2.0] * 8)]
    vectors = spark.createDataFrame(data, "section_id string, vector array<double>")
    good = F.coalesce((F.size("vector") == 8) & ~F.isnan(F.element_at("vector", 1)), F.lit(False))
    unit = normalise_vectors(vectors.filter(good))
    vectors = unit.unionByName(vectors.filter(~good).withColumn("vector", F.col("vector").cast("array<float>")))
    queries = spark.createDataFrame([(n, data[n][1]) for n in range(7)] + [(7, [1.0] * 8)], "query_id long, vector array<double>")
    got = cosine_batch(vectors, queries, 5, block=3).collect()
    assert len(got) == 40
    for n in (0, 7):
        want = [r.section_id for r in cosine(unit, data[n][1] if n < 7 else [1.0] * 8, limit=5, digits=6).collect()]
        assert [r.section_id for r in sorted((r for r in got if r.query_id == n), key=lambda r: r.vector_rank)] == want
    assert cosine_batch(vectors, queries.filter("false"), 5).collect() == []
