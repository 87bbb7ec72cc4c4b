"""Language identification with a bit-sliced Bloom filter.

Each slot of the filter is a mask with one bit for each language, so the AND of an
n-gram's slots tells at once which languages contain it. A text has one gram for
each letter: the letter with its neighbours, lower-cased, where anything but a
letter counts as a boundary. The language with most grams decides, after each count
is corrected for the false positives that the fill of its bits leads to.

Learning counts the grams of all given rows and learns every language among them, however
rare. A gram of it needs RATE of the language's letters (so there are at most 1 / RATE
grams each) and RELATIVE of its highest rate in any language, which keeps passages in
foreign languages out. For that highest rate SMALL letters are added to each language's,
so that a few letters of a rare language push no gram out of the others. The driver thus
gathers 1 / RATE grams of 8 bytes for each language at most (0.8 MB), language by language,
and broadcasts 2 MB of filter for each; neither grows with the corpus.

Null text, or one without a letter: `und`, score 0. Ties go to the first name. With no
labelled rows everything is `und`.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import LETTER, _classes
from .flat import U8, codepoints, map_texts, mix, offsets, slices, sums
from .storage import written

RATE, RELATIVE, SMALL, HASHES = 1e-5, 0.2, 10_000, 4
UNKNOWN = "und"
_HELD = 1_000_000  # distinct grams that a learning task holds before it emits them


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    out = np.zeros(0x110000, np.uint32)
    kinds = _classes()
    for c in np.flatnonzero(kinds[:0x110000] == LETTER).tolist():
        low = chr(c).lower()
        out[c] = ord(low[0]) if unicodedata.category(low[0])[0] == "L" else c
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed grams of all texts, and the offsets of the texts in them."""
    cps = codepoints("".join([t + "\n" for t in texts]))
    off = offsets(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    low = _lower()[cps].astype(np.int64)
    g = low << 21
    g[1:] |= low[:-1] << 42
    g[:-1] |= low[1:]
    own = np.flatnonzero(low)
    return g[own], np.searchsorted(own, off)


def _slots(g: np.ndarray, size: int) -> list[np.ndarray]:
    h = mix(g.astype(U8))
    step = (h >> U8(32)) | U8(1)
    return [((h + U8(k) * step) & U8(size - 1)).astype(np.int64) for k in range(HASHES)]


class LanguageFilter:
    def __init__(self, grams_of: dict[str, np.ndarray]):
        self.languages = sorted(grams_of)
        most = max((len(g) for g in grams_of.values()), default=1)
        self.size = 1 << max(10, int(np.ceil(np.log2(8 * max(most, 1)))))
        self.lanes = -(-max(len(self.languages), 1) // 64)
        self.table = np.zeros((self.lanes, self.size), U8)
        for i, name in enumerate(self.languages):
            for s in _slots(grams_of[name], self.size):
                self.table[i // 64][s] |= U8(1 << (i % 64))
        self.false = np.array([np.mean((self.table[i // 64] >> U8(i % 64)) & U8(1)) ** HASHES for i in range(len(self.languages))])

    def languages_of(self, g: np.ndarray) -> np.ndarray:
        """Masks [lane, gram] of the languages that contain each gram."""
        slots = _slots(g, self.size)
        out = self.table[:, slots[0]]
        for s in slots[1:]:
            out &= self.table[:, s]
        return out

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected counts [text, language], and the grams of each text."""
        g, off = grams(texts)
        masks, n = self.languages_of(g), np.diff(off)
        hits = np.stack([sums((masks[i // 64] >> U8(i % 64)) & U8(1), off) for i in range(len(self.languages))], 1)
        return np.clip((hits - n[:, None] * self.false) / (1 - np.minimum(self.false, 0.999)), 0, None), n

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        got, n = self.counts(texts)
        best = got.argmax(1)
        score = np.minimum(got[np.arange(len(texts)), best] / np.maximum(n, 1), 1.0)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), n.tolist(), strict=True)], np.where(n > 0, score, 0.0).tolist()


def learn(rows: DataFrame, text: str = "text", lang: str = "lang") -> LanguageFilter:
    """The filter of the rows whose text and language are not null."""
    src = rows.select(F.col(f"`{text}`").cast("string").alias("t"), F.col(f"`{lang}`").cast("string").alias("l")).filter("t IS NOT NULL AND l IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def flush():
            for name, (g, c) in held.items():
                yield pa.RecordBatch.from_pydict({"lang": [name] * len(g), "gram": pa.array(g, pa.int64()), "n": pa.array(c, pa.int64())})
            held.clear()

        for batch in batches:
            texts, langs = batch.column("t").to_pylist(), np.array(batch.column("l").to_pylist(), object)
            for lo, hi in slices(texts):
                g, off = grams(texts[lo:hi])
                names, which = np.unique(langs[lo:hi].astype(str), return_inverse=True)
                owner = np.repeat(which, np.diff(off))
                for i, name in enumerate(names.tolist()):
                    u, c = np.unique(g[owner == i], return_counts=True)
                    if name in held:
                        a, b = held[name]
                        u, back = np.unique(np.concatenate([a, u]), return_inverse=True)
                        c = np.bincount(back, np.concatenate([b, c])).astype(np.int64)
                    held[name] = [u, c]
                if sum(len(x[0]) for x in held.values()) > _HELD:
                    yield from flush()
        yield from flush()

    counts = src.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = written(counts, "language-grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))  # a row for each language
    top = rated.filter(F.col("rate") >= RATE).groupBy("gram").agg(F.max(F.col("n") / (F.col("total") + SMALL)).alias("top"))
    kept = rated.filter(F.col("rate") >= RATE).join(top, "gram").filter(F.col("rate") >= RELATIVE * F.col("top")).groupBy("lang").agg(F.collect_list("gram").alias("grams"))
    # a row of at most 1 / RATE grams for each language
    return LanguageFilter({r["lang"]: np.unique(np.array(r["grams"], np.int64)) for r in kept.toLocalIterator()})


def predict(df: DataFrame, model: LanguageFilter, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(keys, texts):
        names, score = shared.value.predict([t or "" for t in texts])
        return {"key": keys[key], "lang_pred": names, "score": score}

    return map_texts(df, [key], text, run, "key long, lang_pred string, score double").withColumnRenamed("key", key)


def held_out(key: str = "doc_id"):
    """Is the row kept out of learning? crc32 of the key as text, mod 3, is 1; never for a null key."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % 3 == 1, F.lit(False))
