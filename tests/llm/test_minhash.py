import random
import re
import tracemalloc
from pathlib import Path

import numpy as np
import pytest

from strandex.llm import minhash
from strandex.llm.flat import U8, mix, span_hash
from strandex.llm.minhash import components, near_duplicates
from strandex.llm.storage import scratch

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(texts, size, percent):
    """{key: (n, component)} by comparing all pairs."""
    sets = {}
    for key, t in texts.items():
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[key] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    up = {k: k for k in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((top(a), top(b)))
                up[q] = p
    return {k: (len(sets[k]), top(k)) for k in keys}


def corpus(seed):
    """Copies, a large group of near copies around the threshold, a common passage, short texts."""
    rnd = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    base = [rnd.choice(words) for _ in range(120)]
    passage = [rnd.choice(words) for _ in range(40)]
    texts = []
    for _ in range(160):
        w = base[:]
        for _ in range(rnd.choice([3, 5, 7, 9])):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        texts.append(" ".join(w))
    for _ in range(80):
        texts.append(" ".join(passage + [rnd.choice(words) for _ in range(rnd.choice([10, 40, 80]))]))
    texts += [" ".join(base)] * 20 + [texts[3].upper()] * 5 + ["", None, "one", "One", "one two", "  ", "\n"]
    rnd.shuffle(texts)
    return {i * 3 + 7: t for i, t in enumerate(texts)}


@pytest.mark.parametrize(("size", "percent", "block"), [(2, 80, 1024), (2, 80, 16), (5, 80, 16)])
def test_components_equal_those_of_all_pairs(spark, monkeypatch, size, percent, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = corpus(size)
    df = spark.createDataFrame([(k, t, 1.0) for k, t in texts.items()], "doc_id long, text string, rep double").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, size, percent).collect()}
    assert got == brute(texts, size, percent)


def test_null_keys_repeated_rows_and_empty_tables(spark):
    schema = "doc_id long, text string"
    rows = near_duplicates(spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (9, "A b C")], schema), 2, 80).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in rows) == [(0, 0, True), (4, 4, True), (4, 4, True), (9, 4, False)]
    assert near_duplicates(spark.createDataFrame([], schema), 2, 80).collect() == []


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 160)] + [(7, 7)]
    with scratch(spark, "test") as tables:
        got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), tables).collect()}
    assert all(got.get(i, 1) == 1 for i in range(2, 41)) and all(got[x] == 100 for x in range(101, 160))


def test_large_group_around_the_threshold(spark):
    """2,000 texts in the same buckets, most of them on the edge of the threshold, in many components."""
    rnd = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    texts = {}
    for key in range(2000):
        w = base[:]
        for at in rnd.sample(range(60), rnd.choice([2, 4, 5])):
            w[at] = f"x{rnd.randrange(10**6)}"
        texts[key] = " ".join(w)
    sets = [{tuple(w[i : i + 2]) for i in range(59)} for w in (t.split() for t in texts.values())]
    column = {x: i for i, x in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((2000, len(column)), np.float32)
    for row, s in enumerate(sets):
        m[row, [column[x] for x in s]] = 1
    shared, n = m @ m.T, m.sum(1)
    near = 100 * shared >= 80 * (n[:, None] + n[None] - shared)
    label = np.arange(2000)
    while True:
        low = np.where(near, label[None], 2000).min(1)
        if (low == label).all():
            break
        label = low
    rows = near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), 2, 80).collect()
    assert 100 < len(set(label.tolist())) < 2000
    assert {r.doc_id: r.component_id for r in rows} == dict(enumerate(label.tolist()))


def test_shared_sizes_are_exact():
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 9000, k)).astype(np.uint64) for k in (1, 5000, 7000, 200, 6000)]
    left, right = np.array([0, 1]), np.array([2, 3, 4])
    want = [[len(np.intersect1d(sets[a], sets[b])) for b in right] for a in left]
    assert minhash.shared_sizes(sets, left, right).tolist() == want


def test_work_tables_are_removed(spark):
    from strandex.llm.storage import shared_dir

    at = Path(re.sub("^file:/+", "/", shared_dir(spark)))
    before = set(at.iterdir())
    near_duplicates(spark.createDataFrame([(1, "a b c"), (2, "a b c d")], "doc_id long, text string"), 2, 80)
    assert [p.name.split("-")[:2] for p in set(at.iterdir()) - before] == [["near", "duplicates"]]


def _signed_classes(spark, n):
    sig = np.random.default_rng(5).integers(0, 3, (n, minhash.COORDS)).astype(np.uint16)  # few values, so buckets of every size
    return sig, spark.createDataFrame([(i * 7 % n, s.tobytes()) for i, s in enumerate(sig)], "rep long, sig binary").repartition(3)


@pytest.mark.parametrize(("part", "held"), [(1 << 18, 1 << 19), (1 << 9, 1 << 10), (1 << 18, 100)])
def test_shared_buckets_by_brute_force(spark, monkeypatch, part, held):
    monkeypatch.setattr(minhash, "PART", part)
    monkeypatch.setattr(minhash, "HELD", held)
    sig, reps = _signed_classes(spark, 300)
    by = {}
    for i, row in enumerate(sig):
        for b in range(minhash.BANDS):
            by.setdefault((b, row[b * minhash.ROWS : (b + 1) * minhash.ROWS].tobytes()), set()).add(i * 7 % 300)
    rows = minhash._shared_buckets(reps).collect()
    got = {}
    for r in rows:
        got.setdefault(r.bucket, {})[r.rep] = r.a
    assert len(rows) == sum(map(len, got.values()))  # each member once
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in by.values() if len(x) > 1)
    for lead in got.values():
        assert lead[min(lead)] == min(lead) and all(a in lead and a < x for x, a in lead.items() if x != min(lead))
        if held > 100 * minhash.BANDS:
            assert set(lead.values()) == {min(lead)}


def test_bands_of_classes_are_no_rows_of_a_shuffle(spark):
    _, reps = _signed_classes(spark, 300)
    assert minhash._dealt(reps, 4).count() <= 12 + 4


def test_span_hash_of_any_value_and_length_needs_little_memory():
    def plain(span):
        x = mix((span.astype(U8) + U8(1)) * U8(0x165667B19E3779F9) + np.arange(len(span), dtype=U8) * U8(0xC2B2AE3D27D4EB4F))
        return int(mix(x.sum(dtype=U8, keepdims=True) + U8(len(span)))[0])

    rnd = np.random.default_rng(3)
    for kind, top, longest in ((np.uint8, 256, 9), (np.uint32, 300, 90), (np.uint32, 0x110000, 2000)):
        counts = rnd.integers(1, longest, 50)
        starts = np.cumsum(counts) - counts
        values = rnd.integers(0, top, counts.sum()).astype(kind)
        assert span_hash(values, starts, counts).tolist() == [plain(values[s : s + n]) for s, n in zip(starts, counts, strict=True)]
    counts = np.full(100_000, 5)
    tracemalloc.start()
    span_hash(np.zeros(500_000, np.uint8), np.cumsum(counts) - counts, counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 31 * 500_000
