"""Near-duplicate detection: circulant MinHash, banding, exact Jaccard on full sets.

A shingle's place under the first permutation is a mixed hash, taken modulo the length
of the second permutation, a table; coordinate k of the signature is the smallest table
entry k places on, so one contiguous row of the table serves all coordinates of a
shingle. A coordinate is kept as its low 16 bits. Bands of ROWS coordinates give the
buckets.

Texts with equal sets are one class, represented by its smallest key. Links between
classes are found in passes that need no pairs of all members of a bucket:
  1. each class is checked against one leader of its buckets, the one its signature
     is nearest to, and what is linked becomes components;
  2. in each bucket with several components left, the members outside its largest one are
     compared with each other and with that component, in blocks of bounded size:
     signatures first tell who has a near member in another component, then the exact
     sizes of all intersections in a block come from a product of incidence matrices.
Every link counts only after the Jaccard index of the full sets of 64-bit shingle hashes.
Nothing but banding and the signature check of step 2 drops a pair, and no bucket or
group has a cap. Were the coordinates independent, a pair at the threshold would share no
bucket with probability 1e-7 and miss the signature check with 3e-7; circulant ones are
not, so the README gives the measured recall.

Words are runs of anything but space and \\t..\\r, with A-Z lower-cased. A text with fewer
words than a shingle has one shingle of all its words; one without words, or null, has
none and links with nothing. Rows with equal keys are one document. Rows with a null key
link with nothing: their component is null and they are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import U8, KeyFilter, map_texts, mix, raw_words, spread, word_hashes
from .storage import Scratch, scratch, written

ROWS, BANDS = 5, 40
COORDS = ROWS * BANDS
PLACES = 1 << 20
#: Pairs of a bucket and a class that make a part, about; those that are sorted at once; classes whose buckets are computed at once.
PART, HELD, _CLASSES = 1 << 18, 1 << 19, 2048
#: Members and shingles of a bucket that one block holds, about.
BLOCK, BLOCK_SHINGLES = 512, 1 << 19
#: Pairs of signatures in one comparison, and shingles in one step of a matrix product.
_PAIRS, _COLUMNS = 1 << 14, 2048
_SEED = 20240611


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    """[place, coordinate] view of the circulant table."""
    pi = np.random.default_rng(_SEED).permutation(PLACES).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:COORDS]]), COORDS)


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    b, _, starts, lengths, docs = raw_words(texts, lower=True)
    h = word_hashes(b, starts, lengths)
    n = np.diff(docs)
    s = h.copy()
    live = len(h)
    for k in range(1, size):
        live = max(len(h) - k, 0)
        s = mix(s[:live] * U8(3) + h[k : k + live])
    out = []
    for lo, m in zip(docs[:-1].tolist(), n.tolist(), strict=True):
        if m >= size:
            own = np.sort(s[lo : lo + m - size + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif m:
            x = h[lo : lo + 1]
            for k in range(1, m):
                x = mix(x * U8(3) + h[lo + k : lo + k + 1])
            out.append(mix(x + U8(m)))  # no shingle of full length has this form
        else:
            out.append(h[:0])
    return out


def signature(own: np.ndarray) -> np.ndarray:
    """COORDS minima of a non-empty set, the low 16 bits of each."""
    table, place = _table(), (mix(own ^ U8(_SEED)) >> U8(44)).astype(np.int64)
    best = table[place[:1024]].min(0)
    for lo in range(1024, len(place), 1024):
        np.minimum(best, table[place[lo : lo + 1024]].min(0), out=best)
    return best.astype(np.uint16)


def _digest(own: np.ndarray) -> tuple[int, int]:
    a = mix(own + U8(1)).sum(dtype=U8) + U8(len(own))
    c = mix(own ^ U8(0x5DEECE66D)).sum(dtype=U8)
    return int(a.astype(np.int64)), int(c.astype(np.int64))


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.sort(np.concatenate([a, b]))
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _near(percent: int) -> int:
    """Equal coordinates that a pair at the threshold has but for 5 standard deviations."""
    j = percent / 100
    return max(1, int(COORDS * j - 5 * (COORDS * j * (1 - j)) ** 0.5))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def signatures(df: DataFrame, size: int, key: str, text: str) -> DataFrame:
    def run(keys, texts):
        out = {"key": keys[key], "n": [], "fa": [], "fb": [], "sig": []}
        for own in shingle_sets([t or "" for t in texts], size):
            fa, fb = _digest(own) if len(own) else (None, None)
            for c, v in zip(("n", "fa", "fb", "sig"), (len(own), fa, fb, signature(own).tobytes() if len(own) else None), strict=True):
                out[c].append(v)
        return out

    return map_texts(df, [key], text, run, "key long, n long, fa long, fb long, sig binary")


def _sets(df: DataFrame, size: int, key: str, text: str, only: KeyFilter) -> DataFrame:
    def run(keys, texts):
        sets = shingle_sets([t or "" for t in texts], size)
        return {"key": keys[key], "set": [s.tobytes() for s in sets]}

    return map_texts(df, [key], text, run, "key long, set binary", only=only)


def _map(df: DataFrame, fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """fn on the columns of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict(fn({n: b.column(n) for n in b.schema.names}))

    return df.mapInArrow(run, schema)


def _signature_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, COORDS)


def _band_hashes(sig: np.ndarray) -> np.ndarray:
    """[class, band]: the bucket of each band."""
    sig = sig.astype(U8).reshape(-1, BANDS, ROWS)
    h = np.broadcast_to(np.arange(BANDS, dtype=U8) + U8(1), sig.shape[:2])
    for k in range(ROWS):
        h = mix(h * U8(3) + sig[:, :, k])
    return h


def _dealt(reps: DataFrame, parts: int) -> DataFrame:
    """part, pairs: the (bucket, rep) of each band of each class, 16 bytes each, in parts of whole buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush():
            pairs = np.concatenate(held)
            held.clear()
            part = ((pairs[:, 0].view(U8) >> U8(32)) % U8(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            names, first = np.unique(part[order], return_index=True)
            rows = [x.tobytes() for x in np.split(pairs[order], first[1:])]
            return pa.RecordBatch.from_pydict({"part": pa.array(names), "pairs": pa.array(rows, pa.binary())})

        for b in batches:
            for lo in range(0, b.num_rows, _CLASSES):
                own = b.slice(lo, _CLASSES)
                bucket = _signed(np.ascontiguousarray(_band_hashes(_signature_rows(own.column("sig"))))).ravel()
                held.append(np.stack([bucket, np.repeat(own.column("rep").to_numpy(), BANDS)], 1))
                if sum(map(len, held)) >= PART:
                    yield flush()
        if held:
            yield flush()

    return reps.select("rep", "sig").mapInArrow(run, "part long, pairs binary")


class _Leaders:
    """Members of shared buckets with their leaders: each bucket's smallest member so far, from some pairs at a time.

    What is held between calls is a row for each bucket, however many members one has.
    """

    def __init__(self):
        self.first, self.shared = np.zeros((0, 2), np.int64), np.zeros(0, bool)

    def add(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, rep, leader) of those members that are no longer, or were never, the smallest of their buckets."""
        pairs, shared = np.concatenate([self.first, pairs]), np.concatenate([self.shared, np.zeros(len(pairs), bool)])
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        pairs, shared = pairs[order], shared[order]
        new = np.ones(len(pairs), bool)
        new[1:] = pairs[1:, 0] != pairs[:-1, 0]
        at = np.flatnonzero(new)
        many = np.diff(np.append(at, len(pairs)))
        self.first = pairs[at]
        self.shared = (many > 1) | np.logical_or.reduceat(shared, at) if len(at) else shared
        return pairs[~new, 0], pairs[~new, 1], np.repeat(self.first[:, 1], many)[~new]

    def end(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, rep, leader) of the leaders, and of no bucket any more."""
        own = self.first[self.shared]
        self.first, self.shared = self.first[:0], self.shared[:0]
        return own[:, 0], own[:, 1], own[:, 1]


def _shared_buckets(reps: DataFrame) -> DataFrame:
    """bucket, rep, a: a row for each class in a bucket that several are in, and the leader it is checked against, a smaller class of the bucket or itself.

    The leader is the smallest class, or the smallest among some, with that one led by a smaller one, where a part has more than HELD pairs.
    Pairs travel as bytes, some thousands in a row, so a band of a class is no row of Spark's.
    """
    parts = max(1, -(-reps.count() * BANDS // PART))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaders, held, part = _Leaders(), [], None

        def rows(found):
            return pa.RecordBatch.from_pydict({c: pa.array(np.ascontiguousarray(x)) for c, x in zip(("bucket", "rep", "a"), found, strict=True)})

        def take():
            found = leaders.add(np.concatenate(held))
            held.clear()
            return rows(found)

        for b in batches:
            for own, raw in zip(b.column("part").to_pylist(), b.column("pairs"), strict=True):
                if own != part:
                    if held:
                        yield take()
                    yield rows(leaders.end())
                    part = own
                held.append(np.frombuffer(raw.as_py(), np.int64).reshape(-1, 2))
                if sum(map(len, held)) >= HELD:
                    yield take()
        if held:
            yield take()
        yield rows(leaders.end())

    return _dealt(reps, parts).repartition("part").sortWithinPartitions("part").mapInArrow(run, "bucket long, rep long, a long")


def _estimated(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """a, b, equal of the pairs whose sizes and signatures allow a link."""
    x = reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    y = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    both = pairs.join(y, "b").join(x, "a").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def run(c):
        equal = (_signature_rows(c["sa"]) == _signature_rows(c["sb"])).sum(1) if len(c["a"]) else np.zeros(0)
        keep = pa.array(np.flatnonzero(equal >= _near(percent)))
        return {"a": c["a"].take(keep), "b": c["b"].take(keep), "equal": pa.array(equal[equal >= _near(percent)].astype(np.int64))}

    return _map(both.select("a", "b", "sa", "sb"), run, "a long, b long, equal long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    x, y = sets.select(F.col("key").alias("a"), F.col("set").alias("sa")), sets.select(F.col("key").alias("b"), F.col("set").alias("sb"))

    def run(c):
        keep = [jaccard_at_least(np.frombuffer(p, U8), np.frombuffer(q, U8), percent) for p, q in zip(c["sa"].to_pylist(), c["sb"].to_pylist(), strict=True)]
        keep = pa.array(keep, pa.bool_())
        return {"a": c["a"].filter(keep), "b": c["b"].filter(keep)}

    return _map(pairs.join(y, "b").join(x, "a").select("a", "b", "sa", "sb"), run, "a long, b long")


def components(links: DataFrame, tables: Scratch) -> DataFrame:
    """node, root (the smallest node of its component) of every node of the links (a, b), by alternating stars.

    Each step is an aggregation and a join on nodes, so a node with very many links is
    dealt with like any skewed key. Steps end in a written table.
    """
    edges = tables.written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        edges = tables.written(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _leader_links(led: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """led: rep, a: a row for each member and leader -> a, b: the link of each class with the leader nearest to it, if it is one."""
    stars = led.filter("a < rep").select("a", F.col("rep").alias("b")).distinct()
    nearest = _estimated(stars, reps, percent).groupBy("b").agg(F.max_by("a", F.struct("equal", -F.col("a"))).alias("a"))
    return _confirmed(nearest, sets, percent)


def _blocks(named: DataFrame) -> DataFrame:
    """bucket, i, j, rep, root, mine: members (bucket, rep, root, n), once for each pair of blocks i <= j to be compared.

    Blocks below `rest` hold the members outside the largest component of the bucket, the
    others that component, whose members are not compared with each other.
    """
    own = named.groupBy("bucket", "root").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    whole = own.groupBy("bucket").agg(F.max_by(F.struct("root", "c", "s"), F.struct("c", "root")).alias("most"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.count("*").alias("roots")).filter("roots > 1")

    def blocks(c, s):
        return F.greatest(F.ceil(c / BLOCK), F.ceil(s / BLOCK_SHINGLES), F.lit(1)).cast("int")

    plan = whole.select("bucket", F.col("most.root").alias("largest"), blocks(F.col("c") - F.col("most.c"), F.col("s") - F.col("most.s")).alias("rest"), blocks(F.col("most.c"), F.col("most.s")).alias("large"))
    h = F.xxhash64("rep")
    inside = F.col("root") == F.col("largest")
    mine = F.when(inside, F.col("rest") + F.pmod(h, F.col("large"))).otherwise(F.pmod(h, F.col("rest"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(inside, F.col("rest")).otherwise(F.col("rest") + F.col("large")) - 1))
    dealt = named.join(plan, "bucket").withColumn("mine", mine).select("bucket", "rep", "root", "mine", other.alias("with"))
    return dealt.select("bucket", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), "rep", "root", "mine")


def _starts(t: pa.Table) -> np.ndarray:
    """First rows of the groups (bucket, i, j) of a sorted table, and its length."""
    key = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("bucket", "i", "j")], 1)
    return np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)]])


def _with_near_member(t: pa.Table, percent: int) -> np.ndarray:
    """Has the row a member of its group in another component that may be linked with it, with this bucket as their first in common?

    t: whole groups, sorted by bucket, i, j, mine; so the partners of a row follow each other.
    """
    sig = _signature_rows(t.column("sig"))
    bucket, root, n, mine, i, j = (t.column(c).to_numpy() for c in ("bucket", "root", "n", "mine", "i", "j"))
    starts = _starts(t)
    group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    row, cross = np.arange(len(sig)), i != j
    split = starts[:-1] + np.bincount(group, mine == i, len(starts) - 1).astype(np.int64)  # the first row of the right block
    first = np.where(cross, split[group], row + 1)
    many = np.where(cross & (mine == j), 0, starts[1:][group] - first)
    hit, least = np.zeros(len(sig), bool), _near(percent)
    total = np.cumsum(many)
    lo = 0
    while lo < len(sig):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + _PAIRS, side="right")))
        x, y = np.repeat(row[lo:hi], many[lo:hi]), spread(first[lo:hi], many[lo:hi])
        ok = (root[x] != root[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
        x, y = x[ok], y[ok]
        equal = sig[x] == sig[y]
        near = np.flatnonzero(np.count_nonzero(equal, axis=1) >= least)
        band = equal[near].reshape(-1, BANDS, ROWS).all(2).argmax(1)
        near = near[_bucket_of(sig[x[near]], band) == bucket[x[near]]]
        hit[x[near]] = hit[y[near]] = True
        lo = hi
    return hit


def shared_sizes(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets `left` with other sets, `right`, exactly: a product of incidence matrices, some shingles at a time."""
    row = np.repeat(np.arange(len(sets)), np.fromiter(map(len, sets), np.int64))
    _, col, c = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = c > 1  # in a single set, a shingle is in no intersection of two
    row, col = row[common[col]], (np.cumsum(common) - 1)[col[common[col]]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(left), len(right)))
    for lo in range(0, int(common.sum()), _COLUMNS):
        part = slice(*np.searchsorted(col, [lo, lo + _COLUMNS]))
        m = np.zeros((len(sets), _COLUMNS), np.float32)
        m[row[part], col[part] - lo] = 1
        out += m[left] @ m[right].T
    return out.astype(np.int64)


def _joining_links(sets: list[np.ndarray], root: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows linked with each other: for each two components that links of left with right join, directly or not, a chain of links."""
    n = np.fromiter(map(len, sets), np.int64)
    shared = shared_sizes(sets, left, right)
    x, y = np.nonzero((root[left][:, None] != root[right][None]) & (100 * shared >= percent * (n[left][:, None] + n[right][None] - shared)))
    x, y = left[x], right[y]
    label, a, b = root.copy(), [], []
    while len(x):
        # each component takes its first link; of links in a ring all are good, so they do no harm
        p = np.concatenate([label[x], label[y]])
        first = np.unique(np.unique(p, return_index=True)[1] % len(x))
        a.append(x[first])
        b.append(y[first])
        names = np.unique(p)
        up = np.arange(len(names))
        for u, v in zip(np.searchsorted(names, label[x[first]]).tolist(), np.searchsorted(names, label[y[first]]).tolist(), strict=True):
            while up[u] != u:
                u = up[u]
            while up[v] != v:
                v = up[v]
            up[max(u, v)] = min(u, v)
        for _ in range(len(names).bit_length()):
            up = up[up]
        at = np.searchsorted(names, label)
        known = (at < len(names)) & (names[np.minimum(at, len(names) - 1)] == label)
        label[known] = names[up[at[known]]]
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _bucket_of(sig: np.ndarray, band: np.ndarray) -> np.ndarray:
    rows = sig.astype(U8).reshape(-1, BANDS, ROWS)[np.arange(len(sig)), band]
    h = band.astype(U8) + U8(1)
    for k in range(ROWS):
        h = mix(h * U8(3) + rows[:, k])
    return _signed(h)


def _by_group(df: DataFrame, fn: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """fn on tables of whole groups (bucket, i, j), which are of bounded size, sorted by mine."""

    def run(batches):
        held: list[pa.RecordBatch] = []  # rows of the last, unfinished group
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([*held, batch]).combine_chunks()
            cut = int(_starts(t)[-2])
            if cut:
                yield fn(t.slice(0, cut))
            held = t.slice(cut).to_batches()
        if held:
            yield fn(pa.Table.from_batches(held).combine_chunks())

    return df.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "mine").mapInArrow(run, schema)


def _crossing_links(named: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, tables: Scratch) -> DataFrame:
    """a, b: links that join the components of each bucket (named: bucket, rep, root, n), confirmed on full sets."""
    dealt = _blocks(named).join(reps.select("rep", "n", "sig"), "rep")

    def involved(t):
        rows = t.filter(pa.array(_with_near_member(t, percent))).combine_chunks()
        return pa.RecordBatch.from_pydict({c: rows.column(c).combine_chunks() for c in ("bucket", "i", "j", "rep", "root", "mine")})

    some = tables.written(_by_group(dealt.select("bucket", "i", "j", "rep", "root", "mine", "n", "sig"), involved, "bucket long, i int, j int, rep long, root long, mine int"), "crossing-members")
    whole = some.join(sets.withColumnRenamed("key", "rep"), "rep")

    def links(t):
        raw, a, b = t.column("set"), [], []
        rep, root, mine, i, j = (t.column(c).to_numpy() for c in ("rep", "root", "mine", "i", "j"))
        starts = _starts(t)
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            own = [np.frombuffer(x.as_buffer(), U8) for x in raw.slice(lo, hi - lo)]
            left, right = np.flatnonzero(mine[lo:hi] == i[lo]), np.flatnonzero(mine[lo:hi] == j[lo])
            x, y = _joining_links(own, root[lo:hi], left, right, percent)
            a.append(rep[lo:hi][x])
            b.append(rep[lo:hi][y])
        none = np.zeros(0, np.int64)
        return pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate([none, *a])), "b": pa.array(np.concatenate([none, *b]))})

    return _by_group(whole.select("bucket", "i", "j", "rep", "root", "mine", "set"), links, "a long, b long")


def near_duplicates(df: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id, kept (key = component_id) of every row."""
    with scratch(df.sparkSession, "near-duplicates-work") as tables:
        return written(_near_duplicates(df, size, percent, key, text, tables), "near-duplicates")


def _near_duplicates(df: DataFrame, size: int, percent: int, key: str, text: str, tables: Scratch) -> DataFrame:
    sigs = tables.written(signatures(df, size, key, text), "signatures")
    linked = sigs.filter("key IS NOT NULL AND n > 0")
    first = F.min_by(F.struct("key", "n", "sig"), "key").alias("first")
    reps = tables.written(linked.groupBy("fa", "fb").agg(first).select("fa", "fb", F.col("first.key").alias("rep"), "first.n", "first.sig"), "classes")
    classes = reps.select("fa", "fb", "rep")
    # candidates are few where few texts have near copies: what is in no shared bucket stays out of the joins
    shared = tables.written(_shared_buckets(reps), "shared-buckets")
    candidates = KeyFilter(shared, "rep")
    members = tables.written(candidates.rows(reps.select("rep", "n", "sig"), "rep"), "members")
    sets = tables.written(_sets(df, size, key, text, candidates), "shingle-sets")
    # a key with several sets is one document: their classes belong together
    own = linked.select("key", "fa", "fb").join(classes, ["fa", "fb"]).groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("top"), F.collect_set("rep").alias("reps")).filter("a < top")
    links = tables.written(_leader_links(shared, members, sets, percent).union(own.select("a", F.explode("reps").alias("b"))), "leader-links")
    root = components(links, tables)
    named = shared.select("bucket", "rep").join(root, F.col("rep") == F.col("node"), "left").select("bucket", "rep", F.coalesce("root", "rep").alias("root"))
    named = tables.written(named.join(members.select("rep", "n"), "rep"), "bucket-components")
    last = tables.written(_crossing_links(named, members, sets, percent, tables), "crossing-links")
    root = components(links.union(last), tables)
    member = sigs.select("key", "n", "fa", "fb").join(classes, ["fa", "fb"], "left").join(root, F.col("rep") == F.col("node"), "left")
    component = F.coalesce("root", "rep", "key")
    return member.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("key").isNotNull(), component).alias("component_id"), (F.col("key").isNull() | (F.col("key") == component)).alias("kept"))
