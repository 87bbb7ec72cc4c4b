"""Quality rules with risk-controlled cutoffs.

Each rule is a score that grows with junk. Labelled rows (quality 1: good, 0: bad) are
the holdout; copies of a text in a stratum are one row of it, bad if one of them is. A fixed
fifth of a stratum's good rows (by a hash of the text) and its bad rows lay down a path: rule by rule, the one with the largest gain first (bad rows rejected that
no earlier rule rejects, less PRICE times the good ones), each from its loosest cutoff to
that of its gain. The other good rows test the path's rule sets in this order, each with
the exact binomial test of "more than `risk` of the good rows are rejected by the rules
together", until one test fails (a fixed sequence, which needs no correction within itself
and no division of the risk); over strata the level is divided by their number. So with
probability 1 - `level`, no stratum loses more than `risk` of its good rows to the rules.
Of the sets that pass, the one with the largest gain is taken, the loosest of equals, and
none where no gain is positive.

Strata with too few labels for a test of their own are tested together, as one more stratum,
for which the bound then holds as a whole. Its cutoffs go to those of them that have good
rows and lose no more than `risk` of the tested ones. A pool that is short of labels takes
in the next larger stratum; if all strata together are short of them, there are no cutoffs.

Null text has no words; it fails the base rule. A null stratum is a stratum. Several
labels of a document count as bad if one is; labels of other values are left out.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import U8, map_texts, mix, offsets, raw_words, span_hash, spread, sums, word_hashes
from .storage import written

RULES = ("symbols", "capitals", "repeats", "dup_lines", "short_words", "long_words")
STEPS, PRICE = 100, 20
GUIDE = 5  # one good row in GUIDE lays down the path, the others test it
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))


def text_features(texts: list[str]) -> dict[str, np.ndarray]:
    b, off, starts, lengths, docs = raw_words(texts)
    n_words = np.diff(docs)
    chars = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
    out = {"n_words": n_words, "word_chars": sums(chars[starts + lengths] - chars[starts], docs), "n_symbols": sums(_SYMBOLS[b], off)}
    upper, lower = (b >= 65) & (b <= 90), (b >= 97) & (b <= 122)
    out["n_upper"], out["n_letters"] = sums(upper, off), sums(upper | lower, off)
    out["n_repeat_words"] = _repeats(word_hashes(b, starts, lengths), docs, n_words)
    out["n_lines"], out["n_dup_lines"] = _lines(b, off, starts, lengths)
    return out


def _repeats(h: np.ndarray, docs: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    if len(h) < 3:
        return np.zeros(len(n_words), np.int64)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    at = np.flatnonzero(doc[:-2] == doc[2:])
    w = mix(h[at] * U8(3) + mix(h[at + 1] * U8(5) + mix(h[at + 2] + doc[at].astype(U8) * U8(0x9E3779B97F4A7C15))))
    order = np.argsort(w)
    s = w[order]
    same = s[1:] == s[:-1]
    again = np.zeros(len(s), bool)
    again[1:] |= same
    again[:-1] |= same
    hit = at[order[again]]
    inside = np.zeros(len(h), bool)
    for k in range(3):
        inside[hit + k] = True
    return sums(inside, docs)


def _lines(b, off, starts, lengths) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them that equal an earlier line, by text."""
    n = len(off) - 1
    if not len(starts):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    ends = np.flatnonzero(b == 10)
    begin = np.unique(np.concatenate([off[:-1][off[:-1] < off[1:]], ends[ends + 1 < len(b)] + 1]))
    stop = np.append(begin[1:], len(b))
    stop = stop - (b[stop - 1] == 10)  # the line feed is no part of the line
    used = np.unique(np.searchsorted(begin, starts, side="right") - 1)
    begin, size = begin[used], (stop - begin)[used]
    h = span_hash(b[spread(begin, size)], offsets(size)[:-1], size)
    doc = np.searchsorted(off, begin, side="right") - 1
    # texts of no bytes share an offset: the last of them is the one with bytes
    _, first = np.unique(mix(h + doc.astype(U8) * U8(0x9E3779B97F4A7C15)), return_index=True)
    lines = np.bincount(doc, minlength=n)
    return lines, lines - np.bincount(doc[first], minlength=n)


def features(df: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """key, stratum, digest of the text and the counts of every text."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters"]

    def run(keys, texts):
        got = text_features([t or "" for t in texts])
        strata = [None if s is None else str(s) for s in keys[stratum]]
        return {"key": keys[key], "stratum": strata, "digest": keys["_digest"]} | {n: got[n].tolist() for n in names}

    named = df.withColumn("_digest", F.xxhash64(F.col(f"`{text}`").cast("string")))
    return map_texts(named, [key, stratum, "_digest"], text, run, "key long, stratum string, digest long, " + ", ".join(f"{n} long" for n in names))


def scores() -> dict:
    """Whole numbers 0..STEPS for each rule."""

    def part(a, b):
        return F.when(F.col(b) > 0, F.least(F.floor(F.lit(STEPS) * F.col(a) / F.col(b)), F.lit(STEPS))).otherwise(0).cast("int")

    mean = F.when(F.col("n_words") > 0, F.col("word_chars") / F.col("n_words"))
    size = F.coalesce(F.least(F.floor(5 * mean), F.lit(STEPS)), F.lit(STEPS // 4)).cast("int")
    return {"symbols": part("n_symbols", "word_chars"), "capitals": part("n_upper", "n_letters"), "repeats": part("n_repeat_words", "n_words"), "dup_lines": part("n_dup_lines", "n_lines"), "short_words": F.lit(STEPS) - size, "long_words": size}


def binomial_tail(x: int, n: int, p: float) -> float:
    """P(X <= x) for X of n trials with probability p, exactly."""
    if x >= n:
        return 1.0
    if p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    lp, lq, ln = math.log(p), math.log1p(-p), math.lgamma(n + 1)
    terms = [ln - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * lp + (n - k) * lq for k in range(x + 1)]
    top = max(terms)
    return min(1.0, math.exp(top) * math.fsum(math.exp(t - top) for t in terms))


def upper_bound(x: int, n: int, level: float) -> float:
    """The exact (Clopper-Pearson) upper bound of a proportion."""
    lo, hi = x / n if n else 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if binomial_tail(x, n, mid) > level else (lo, mid)
    return hi


def best_cutoff(good: np.ndarray, bad: np.ndarray) -> tuple[int, int]:
    """good, bad: rows by score. (gain, cutoff c) of the rule "score > c" with the largest gain, the loosest of equals."""
    lost, caught = (np.cumsum(x[::-1])[::-1][1:] for x in (good, bad))
    gain = (caught - PRICE * GUIDE * lost)[::-1]
    at = int(gain.argmax())
    return int(gain[at]), STEPS - 1 - at


def choose(good: np.ndarray, bad: np.ndarray, risk: float, level: float) -> int | None:
    """good, bad: rows by the step of the path that rejects them first, the kept ones last. The last step to be taken, or None."""
    n = int(good.sum())
    lost, caught, tested, best = 0, 0, None, (0, None)
    for step in range(len(good) - 1):
        lost, caught = lost + int(good[step]), caught + int(bad[step])
        if lost != tested and (lost > risk * n or binomial_tail(lost, n, risk) > level):
            break
        tested = lost
        if (gain := caught - PRICE * lost) > best[0]:
            best = (gain, step)
    return best[1]


def cutoffs(feats: DataFrame, labels: DataFrame, risk: float, level: float, key: str = "doc_id", label: str = "quality") -> list[tuple[str | None, dict[str, int]]]:
    """The cutoff of each rule for each stratum that has labels enough, by itself or in the pool."""
    spark = feats.sparkSession
    own = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("good")).filter("good IN (0, 1)").groupBy("key").agg(F.min("good").alias("good"))
    held = feats.join(own, "key").filter("n_words >= 50 AND 2 * n_repeat_words <= n_words")  # what the base rule keeps
    held = held.select("stratum", "digest", "good", *[s.alias(r) for r, s in scores().items()])
    held = held.groupBy("stratum", "digest").agg(F.min("good").alias("good"), *[F.first(r).alias(r) for r in RULES])  # copies have equal scores
    held = written(held.withColumn("guide", (F.col("good") == 1) & (F.pmod(F.xxhash64("digest"), F.lit(GUIDE)) == 0)), "quality-holdout")

    def least(tests: int) -> float:  # with fewer rows, no test passes
        return math.log(level / tests) / math.log1p(-risk)

    # a row for each stratum with labels
    sizes = held.groupBy("stratum").agg(F.sum(F.when(~F.col("guide"), F.col("good")).otherwise(0)).alias("n"), F.sum("good").alias("good")).collect()
    sizes.sort(key=lambda r: (-r["n"], r["stratum"] is not None, r["stratum"] or ""))
    alone = 0
    while alone < len(sizes) and sizes[alone]["n"] >= least(alone + 1 + (alone + 1 < len(sizes))):
        alone += 1
    while alone and 0 < sum(r["n"] for r in sizes[alone:]) < least(alone + 1):
        alone -= 1  # a pool short of labels takes in the next larger stratum
    pool = sizes[alone:]
    tests = alone + (sum(r["n"] for r in pool) > 0)
    of = {r["stratum"]: min(i, alone) for i, r in enumerate(sizes)}
    groups = F.broadcast(spark.createDataFrame([(s, g) for s, g in of.items()], "own_stratum string, group int"))
    held = held.join(groups, F.col("stratum").eqNullSafe(F.col("own_stratum"))).drop("own_stratum")

    def first_step(paths: dict[int, list[tuple[str, int]]]):
        """The step of its group's path that rejects a row first; the length of the path if none does."""
        out = F.lit(0)
        for g, path in paths.items():
            at, steps = 0, []
            for rule, cut in path:
                steps.append(F.when(F.col(rule) > cut, at + F.greatest(F.lit(STEPS - 1) - F.col(rule) + 1, F.lit(0))))
                at += STEPS - cut
            out = F.when(F.col("group") == g, F.coalesce(*steps, F.lit(at))).otherwise(out)
        return out

    paths: dict[int, list[tuple[str, int]]] = {}
    guides = held.filter("guide OR good = 0")
    open_groups = list(range(alone + bool(pool)))
    for _ in RULES:
        left = guides.filter(F.col("group").isin(open_groups))
        for g, path in paths.items():
            left = left.filter((F.col("group") != g) | ~F.greatest(F.lit(0), *[(F.col(r) > c).cast("int") for r, c in path]).cast("boolean"))
        stacked = left.select("group", "good", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("score")) for r in RULES])).alias("x"))
        # at most STEPS + 1 rows for each rule of a group
        table: dict = {}
        for r in stacked.groupBy("group", "x.rule", "x.score").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")).collect():
            table.setdefault(r["group"], {}).setdefault(r["rule"], np.zeros((2, STEPS + 1), np.int64))[:, r["score"]] += r["good"], r["bad"]
        open_groups = []
        for g, rules in table.items():
            used = {r for r, _ in paths.get(g, ())}
            found = [(*best_cutoff(*rules[r]), r) for r in RULES if r in rules and r not in used]
            gain, cut, rule = max(found, key=lambda x: x[0], default=(0, 0, ""))
            if gain > 0:
                paths.setdefault(g, []).append((rule, cut))
                open_groups.append(g)
        if not open_groups:
            break
    if not paths:
        return []

    # at most as many rows for a stratum as its path has steps
    tested = held.filter("NOT guide").withColumn("step", first_step(paths)).filter(F.col("group").isin(list(paths)))
    counts = tested.groupBy("group", "stratum", "step").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")).collect()
    got = []
    for g, path in paths.items():
        size = sum(STEPS - c for _, c in path) + 1
        by = {r["stratum"]: np.zeros((2, size), np.int64) for r in counts if r["group"] == g}
        for r in counts:
            if r["group"] == g:
                by[r["stratum"]][:, r["step"]] += r["good"], r["bad"]
        last = choose(*sum(by.values()), risk, level / tests) if tests and by else None
        if last is None:
            continue
        cuts, at = {}, 0
        for rule, cut in path:
            if last >= at:
                cuts[rule] = max(cut, STEPS - 1 - (last - at))
            at += STEPS - cut
        for stratum, (good, _) in by.items():
            if g < alone or 0 < good.sum() and good[: last + 1].sum() <= risk * good.sum():
                got.append((stratum, cuts))
    return sorted(got, key=lambda x: (x[0] is not None, x[0] or ""))


def judge(feats: DataFrame, cuts: list[tuple[str | None, dict[str, int]]]) -> DataFrame:
    """feats with base_failed, rejected_by (the first rule that rejects what the base rule keeps, or null) and kept."""
    spark = feats.sparkSession
    kinds = "cut_stratum string, " + ", ".join(f"cut_{r} int" for r in RULES)
    table = F.broadcast(spark.createDataFrame([(s, *[c.get(r) for r in RULES]) for s, c in cuts], kinds))  # a row for each stratum
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    why = F.coalesce(*[F.when(s > F.col(f"cut_{r}"), F.lit(r)) for r, s in scores().items()])
    joined = feats.join(table, F.col("stratum").eqNullSafe(F.col("cut_stratum")), "left")
    return joined.withColumn("base_failed", base).withColumn("rejected_by", F.when(~F.col("base_failed"), why)).withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull()).drop("cut_stratum", "digest", *[f"cut_{r}" for r in RULES])


def quality_verdicts(docs: DataFrame, labels: DataFrame, risk: float = 0.02, level: float = 0.05, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """key, the counts, base_failed, rejected_by, kept for every row of docs."""
    feats = written(features(docs, key, text, stratum), "quality-features")
    return judge(feats, cutoffs(feats, labels, risk, level, key)).withColumnRenamed("key", key)
