"""Personal data: patterns, then information-theoretic sanitisation of the terms that disclose it.

Base spans are emails, IP addresses, card numbers (Luhn) and phone numbers. Each is a
protected entity. A term (a word of three bytes or more, outside the base spans) reveals
entity c as far as the corpus lets one infer c from it: disclosure = PMI(c; t) / IC(c),
with PMI = ln(share * N / docs(c)) and IC = ln(N / docs(c)). N, docs(t) and docs(c) count
documents of the whole corpus, joint those with both. share is not joint / docs(t) itself
but its lower confidence bound (level LEVEL, Chernoff), with as much evidence as there are
different texts with both: one text and its copies are one observation, and every pair is
rated, those seen once too. A term that occurs only with c comes the closer to 1 the more
often it does so, and the larger the corpus is. Terms from REMOVE on are removed, those
from GENERALISE on are generalised to their form (all capitals, capitalised or small), which
most words of a corpus share, wherever they occur in the corpus.

A term in more documents than rare_enough allows cannot reach GENERALISE with any entity of
a text, so only the other terms are paired with the text's entities; no pair with an action
is lost. The counts thus take a row for each word of the texts with entities, and pairs of
their rare terms only. Occurrences are found by a filter of fixed size, then exactly.

Spans are code points, end exclusive; base spans are never changed by terms. Null text
counts as empty. Repeated rows count as documents of their own and get the same spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import slices, span_hash, spread
from .storage import written

KINDS = ("email", "ip", "card", "phone")
REMOVED, GENERALISED = "removed", "generalised"
LEVEL, GENERALISE, REMOVE = 0.2, 0.75, 0.9
_HELD = 1 << 20  # terms counted in a task before they are given away
_SLOTS = 1 << 24  # of the filter for terms to be found: its size does not depend on the corpus

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards: a long run without @ costs nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        if lo < at and (m := _DOMAIN.match(text, at + 1)):
            yield lo, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end), sorted."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = re.sub("[ -]", "", m.group())
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _hash(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def entity(kind: int, value: str) -> int:
    norm = value.lower() if kind == 0 else value if kind == 1 else re.sub("[^0-9]", "", value)
    return _hash(f"{KINDS[kind]}:{norm}".encode())


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _outside(text: str, spans: list[tuple[int, int, int]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Do the words (code points) overlap no base span?"""
    if not spans:
        return np.ones(len(starts), bool)
    edge = np.zeros(len(text) + 2, np.int64)
    for a, _, b in spans:
        edge[a] += 1
        edge[b] -= 1
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge) > 0)])
    return covered[ends] == covered[starts]


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each lower-cased word, its text, and its start and end in code points of that text."""
    enc = [t.encode() + b"\n" for t in texts]
    size = np.fromiter(map(len, enc), np.int64, len(enc))
    b = np.frombuffer(b"".join(enc), np.uint8)
    first = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
    b = b + (((b >= 65) & (b <= 90)).astype(np.uint8) << 5)
    word = ((b >= 97) & (b <= 122)) | (b >= 0x80)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], word.view(np.int8), [0]])))
    starts, n = edge[::2], edge[1::2] - edge[::2]
    long = n > 2
    starts, n = starts[long], n[long]
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4
    h = _signed(span_hash(b[spread(starts, n)], np.cumsum(n) - n, n))
    doc = np.searchsorted(np.cumsum(size), starts, side="right")
    origin = first[np.cumsum(size) - size][doc]
    return h, doc, first[starts] - origin, first[starts + n] - origin


def base_table(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, digest (of the text), counts and spans of every row; of those with spans the distinct entities and terms."""
    schema = "key long, digest long, n_email long, n_ip long, n_card long, n_phone long, base string, entities array<long>, terms array<long>"

    def run(batches):
        for batch in batches:
            keys, texts = batch.column("k"), [t or "" for t in batch.column("t").to_pylist()]
            for lo, hi in slices(texts):
                part = texts[lo:hi]
                spans = [base_spans(t) for t in part]
                who = [i for i, s in enumerate(spans) if s]
                h, doc, starts, ends = _words([part[i] for i in who])
                at = np.searchsorted(doc, np.arange(len(who) + 1))
                entities, terms = [None] * len(part), [None] * len(part)
                for j, i in enumerate(who):
                    w = slice(at[j], at[j + 1])
                    terms[i] = np.unique(h[w][_outside(part[i], spans[i], starts[w], ends[w])])
                    entities[i] = sorted({entity(k, part[i][a:b]) for a, k, b in spans[i]})
                cols = {f"n_{k}": pa.array([sum(x == n for _, x, _ in s) for s in spans], pa.int64()) for n, k in enumerate(KINDS)}
                own = pa.array([_hash(t.encode()) for t in part], pa.int64())
                lists = {"entities": pa.array(entities, pa.list_(pa.int64())), "terms": pa.array(terms, pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_pydict({"key": keys.slice(lo, hi - lo), "digest": own} | cols | {"base": pa.array(map(_joined, spans), pa.string())} | lists)

    src = df.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    return src.mapInArrow(run, schema)


def _term_documents(df: DataFrame, text: str) -> DataFrame:
    """term, docs: the documents of the whole corpus that hold each term."""

    def run(batches):
        held, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column("t").to_pylist()]
            for lo, hi in slices(texts):
                h, doc, _, _ = _words(texts[lo:hi])
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                u, n = np.unique(h[new], return_counts=True)
                held, back = np.unique(np.concatenate([held, u]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, n]), len(held)).astype(np.int64)
                if len(held) > _HELD:
                    yield pa.RecordBatch.from_pydict({"term": pa.array(held), "n": pa.array(counts)})
                    held, counts = held[:0], counts[:0]
        yield pa.RecordBatch.from_pydict({"term": pa.array(held), "n": pa.array(counts)})

    return df.select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("docs"))


def share_bound(share: np.ndarray, trials: np.ndarray) -> np.ndarray:
    """The least q with trials * KL(share || q) <= ln(1 / LEVEL): a lower confidence bound of a share."""

    def divergence(q):
        with np.errstate(divide="ignore", invalid="ignore"):
            rest = np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - q)), 0)
            return share * np.log(share / q) + rest

    lo, hi = np.zeros(len(share)), share.astype(float)
    for _ in range(50):
        mid = (lo + hi) / 2
        far = trials * divergence(mid) > np.log(1 / LEVEL)
        lo, hi = np.where(far, mid, lo), np.where(far, hi, mid)
    return hi


def rare_enough(entity_docs, all_docs):
    """The documents that a term can be in at most if it is to reach GENERALISE: share is no more than entity_docs / docs."""
    return F.pow(entity_docs, F.lit(GENERALISE)) * F.pow(all_docs, F.lit(1 - GENERALISE)) + F.lit(0.001)


def disclosing_terms(df: DataFrame, base: DataFrame, text: str = "text") -> DataFrame:
    """entity, term, disclosure, action of the terms that reveal an entity."""
    everything = F.lit(base.count())
    # a row for each text with entities, and how often the corpus has it
    texts = base.filter("entities IS NOT NULL").groupBy("digest").agg(F.first("entities").alias("entities"), F.first("terms").alias("terms"), F.count("*").alias("copies"))
    texts = written(texts, "private-texts")
    own = texts.select("digest", "copies", F.explode("entities").alias("entity"))
    entities = written(own.groupBy("entity").agg(F.sum("copies").alias("entity_docs")), "entities")
    most = own.join(entities, "entity").groupBy("digest").agg(F.max(rare_enough(F.col("entity_docs"), everything)).alias("most"))
    docs = _term_documents(df, text)
    rare = texts.join(most, "digest").select("digest", "most", F.explode("terms").alias("term")).join(docs, "term").filter("docs <= most")
    pairs = rare.join(own, "digest").groupBy("entity", "term").agg(F.sum("copies").alias("joint"), F.count("*").alias("support"), F.first("docs").alias("docs"))
    return _rated(pairs.join(entities, "entity").withColumn("all_docs", everything))


def _rated(pairs: DataFrame) -> DataFrame:
    """entity, term, disclosure, action of the pairs with an action, from joint, support, docs, entity_docs, all_docs."""

    @F.pandas_udf("double")
    def bound(joint, support, docs):
        share = np.minimum(joint.to_numpy() / docs.to_numpy(), 1.0)
        # evidence in different texts: copies scale the counts, not the trials
        return pd.Series(share_bound(share, np.minimum(support.to_numpy(), joint.to_numpy()) / share))

    ic = F.ln(F.col("all_docs") / F.col("entity_docs"))
    pmi = F.ln(bound("joint", "support", "docs")) + ic
    action = F.when(F.col("disclosure") >= REMOVE, REMOVED).when(F.col("disclosure") >= GENERALISE, GENERALISED)
    return pairs.withColumn("disclosure", F.when(ic > 0, pmi / ic)).select("entity", "term", "disclosure", action.alias("action")).filter("action IS NOT NULL")


def _slots_of(term) -> list:
    return [F.pmod(term, F.lit(_SLOTS)), F.pmod(F.shiftrightunsigned(term, 32), F.lit(_SLOTS))]


def _occurrences(df: DataFrame, terms: DataFrame, text: str) -> DataFrame:
    """digest, terms (start, end, action): the places of the terms in every text that holds one."""
    slot = terms.select(F.explode(F.array(*_slots_of(F.col("term")))).alias("slot"))
    held = slot.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(slot & 63))")).alias("bits"))
    table = np.zeros(_SLOTS // 64, np.int64)
    rows = held.toPandas()  # at most _SLOTS / 64 rows
    table[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    shared = df.sparkSession.sparkContext.broadcast(table)

    def has(slot):
        return (shared.value[slot >> 6] >> (slot & 63)) & 1 == 1

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("t").to_pylist()]
            for lo, hi in slices(texts):
                h, doc, starts, ends = _words(texts[lo:hi])
                hit = has(h % _SLOTS) & has((h.view(np.uint64) >> np.uint64(32)).astype(np.int64) % _SLOTS)
                h, doc, starts, ends = h[hit], doc[hit], starts[hit], ends[hit]
                digest, free = np.zeros(len(h), np.int64), np.ones(len(h), bool)
                for i in np.unique(doc).tolist():
                    w, t = slice(*np.searchsorted(doc, [i, i + 1])), texts[lo + i]
                    digest[w], free[w] = _hash(t.encode()), _outside(t, base_spans(t), starts[w], ends[w])
                yield pa.RecordBatch.from_pydict({"digest": digest[free], "term": h[free], "start": starts[free], "end": ends[free]})

    found = df.select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(run, "digest long, term long, start long, end long").distinct()
    return found.join(terms, "term").groupBy("digest").agg(F.collect_list(F.struct("start", "end", "action")).alias("terms"))


def find_personal_data(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, digest, counts, base_sha256, spans (kind:start:end by start, then kind; terms last) of every row."""
    base = written(base_table(df, key, text), "pii-base")
    # of several entities that a term reveals, the stricter action holds: removed > generalised
    terms = written(disclosing_terms(df, base, text).groupBy("term").agg(F.max("action").alias("action")), "disclosing-terms")

    def assemble(batches):
        for batch in batches:
            out, sha = [], []
            for b, ts in zip(batch.column("base").to_pylist(), batch.column("terms").to_pylist(), strict=True):
                sha.append(hashlib.sha256(b.encode()).hexdigest())
                if ts:
                    spans = [(int(s), KINDS.index(k), int(e), k) for k, s, e in (x.split(":") for x in b.split(",") if x)]
                    spans += [(t["start"], 4 + (t["action"] == REMOVED), t["end"], t["action"]) for t in ts]
                    b = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))
                out.append(b)
            cols = {c: batch.column(c) for c in ("key", "digest", "n_email", "n_ip", "n_card", "n_phone")}
            yield pa.RecordBatch.from_pydict(cols | {"base_sha256": pa.array(sha, pa.string()), "spans": pa.array(out, pa.string())})

    whole = base.drop("entities", "terms").join(_occurrences(df, terms, text), "digest", "left")
    return whole.mapInArrow(assemble, "key long, digest long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string").withColumnRenamed("key", key)


def general_form(term: str) -> str:
    return "[NAME]" if term.isupper() else "[Name]" if term[:1].isupper() else "[word]"


def sanitise(text: str, spans: str) -> str:
    """The text with spans replaced: [kind] for base spans, their form for generalised terms, nothing for removed ones."""
    out, at = [], 0
    for kind, a, b in sorted((x.split(":") for x in spans.split(",")), key=lambda x: int(x[1])):
        lo, hi = int(a), int(b)
        if hi <= at:
            continue
        out.append(text[at : max(lo, at)])
        out.append("" if kind == REMOVED else general_form(text[lo:hi]) if kind == GENERALISED else f"[{kind}]")
        at = hi
    return "".join(out) + text[at:]


def sanitise_documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with its columns, the text sanitised. Rows without spans stay as they are."""
    spans = find_personal_data(df, key, text).filter("spans <> ''").select(F.col(key).alias("_pii_key"), F.col("digest").alias("_pii_digest"), F.col("spans").alias("_pii_spans")).dropDuplicates(["_pii_key", "_pii_digest"])
    own = F.col(f"`{text}`").cast("string")

    @F.pandas_udf("long")
    def digest(s):
        return s.map(lambda t: _hash((t or "").encode()))

    @F.pandas_udf("string")
    def clean(t, s):
        return t.combine(s, lambda x, y: x if y is None or x is None else sanitise(x, y))

    joined = df.withColumn("_pii_own", digest(own)).join(spans, F.col(f"`{key}`").eqNullSafe(F.col("_pii_key")) & (F.col("_pii_own") == F.col("_pii_digest")), "left")
    return joined.withColumn(text, F.when(F.col("_pii_spans").isNull(), own).otherwise(clean(own, F.col("_pii_spans")))).select(*[F.col(f"`{c}`") for c in df.columns])

