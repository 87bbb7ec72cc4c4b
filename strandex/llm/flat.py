"""Flat numpy views of text batches, shared by the operators of this subpackage.

An Arrow batch is cut into slices of bounded size; a slice is one array of code
points (or bytes) plus document offsets, so the work per document is array work.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U8 = np.uint64
_M1, _M2, _K = U8(0x9E3779B97F4A7C15), U8(0xC2B2AE3D27D4EB4F), U8(0x165667B19E3779F9)
#: Characters (for `map_texts` bytes) that one slice holds at most, unless a single text is longer.
SLICE = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = x * _M1
    x ^= x >> U8(32)
    x *= _M2
    x ^= x >> U8(29)
    x *= _M1
    x ^= x >> U8(32)
    return x


def offsets(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices first[i], first[i]+1, ... counts[i] of them, for every i."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(first - (np.cumsum(counts) - counts), counts)
    return shift + np.arange(total)


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of values[off[i]:off[i+1]] for every i; empty ranges give 0."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


#: Values and places in a span that `_mixed` has.
_VALUES, _PLACES = 256, 32


@lru_cache(maxsize=1)
def _mixed() -> np.ndarray:
    """The mixed hash of each small value at each of the first places of a span, by place: 64 KB."""
    place, value = np.divmod(np.arange(_VALUES * _PLACES, dtype=U8), U8(_VALUES))
    return mix((value + U8(1)) * _K + place * _M2)


def span_hash(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64-bit hashes of consecutive, non-empty spans that cover `values` from starts[0] on."""
    if not len(starts):
        return np.zeros(0, U8)
    place = np.arange(len(values), dtype=np.int32)
    place -= np.repeat(starts.astype(np.int32), counts)
    small = place < _PLACES
    if values.dtype != np.uint8:
        small &= values < _VALUES
    at = place * np.int32(_VALUES)
    at += values.astype(np.int32)
    x = _mixed().take(at, mode="clip")
    if len(rest := np.flatnonzero(~small)):  # long spans and large values
        x[rest] = mix((values[rest].astype(U8) + U8(1)) * _K + place[rest].astype(U8) * _M2)
    return mix(np.add.reduceat(x, starts - starts[0]) + counts.astype(U8))


def slices(texts: list, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `limit` characters together, or a single text."""
    return ranges(map(len, texts), limit)


def ranges(sizes, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of sizes with a sum of at most `limit`, or of a single one."""
    lo = held = end = 0
    for i, n in enumerate(sizes):
        end = i + 1
        if i > lo and held + n > limit:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < end:
        yield lo, end


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def raw_words(texts: list[str], lower: bool = False):
    """Bytes and words `[^\\x20\\x09-\\x0D]+` of texts: (bytes, document offsets, word starts, word lengths, word offsets by document)."""
    enc = [t.encode() for t in texts]
    off = offsets(np.fromiter(map(len, enc), np.int64, len(enc)))
    b = np.frombuffer(b"".join(enc), np.uint8)
    if lower:
        b = b + (((b >= 65) & (b <= 90)).astype(np.uint8) << 5)
    word = ~((b == 32) | ((b >= 9) & (b <= 13)))
    first = word.copy()
    first[1:] &= ~word[:-1]
    cut = off[(off > 0) & (off < len(b))]
    first[cut] = word[cut]
    starts = np.flatnonzero(first)
    last = word.copy()
    if len(b):
        last[:-1] &= ~word[1:] | first[1:]
    lengths = np.flatnonzero(last) + 1 - starts
    return b, off, starts, lengths, np.searchsorted(starts, off)


def word_hashes(b: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, U8)
    return span_hash(b[spread(starts, lengths)], offsets(lengths)[:-1], lengths)


@lru_cache(maxsize=1)
def _malloc_trim() -> Callable:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


def release() -> None:
    """Gives memory that is free back to the system, which the allocator would keep for a worker's life, through all later stages."""
    pa.default_memory_pool().release_unused()
    _malloc_trim()(0)


def map_texts(df: DataFrame, keys: list[str], text: str, fn: Callable, schema: str, kind: str = "string", only: KeyFilter | None = None) -> DataFrame:
    """Run fn(keys: dict of lists, texts: list of str or None) -> dict of columns over slices of each batch.

    Only `keys` and `text` are read, under positional names, so other columns and their names play no part.
    only: rows whose first key the filter does not have are passed over.
    """
    names = [f"k{i}" for i in range(len(keys))]
    src = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)], F.col(f"`{text}`").cast(kind).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = only.of(batch, "k0") if only else batch
            texts = batch.column("t")
            # a slice at a time becomes Python strings
            for lo, hi in ranges(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
                own = {k: batch.column(n).slice(lo, hi - lo).to_pylist() for k, n in zip(keys, names, strict=True)}
                out = fn(own, texts.slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v, type=_arrow(kinds[k])) for k, v in out.items()})
            release()

    kinds = {name: kind for name, kind in (x.strip().split(" ", 1) for x in schema.split(","))}
    return src.mapInArrow(run, schema)


class KeyFilter:
    """A broadcast bitmap of 2 MB, whatever their number, of the longs in a column: `has` may say yes to one that is not there, never no to one that is.

    It keeps rows out of a shuffle. Where the longs are so many that it is full, it keeps none out, and nothing else changes.
    """

    SLOTS = 1 << 24

    def __init__(self, rows: DataFrame, column: str):
        found = rows.select(F.col(column).alias("key")).mapInArrow(self._slots_of, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
        held = found.toPandas()  # at most SLOTS / 64 rows
        table = np.zeros(self.SLOTS // 64, np.int64)
        table[held["at"].to_numpy(np.int64)] = held["bits"].to_numpy(np.int64)
        self.shared = rows.sparkSession.sparkContext.broadcast(table)

    @classmethod
    def _slots(cls, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys.astype(np.int64).view(U8))
        return tuple(((h >> U8(k)) & U8(cls.SLOTS - 1)).astype(np.int64) for k in (0, 32))

    @classmethod
    def _slots_of(cls, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = np.unique(np.concatenate(cls._slots(batch.column("key").drop_null().to_numpy())))
            word, first = np.unique(slot >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(np.int64(1) << (slot & 63), first) if len(slot) else slot
            yield pa.RecordBatch.from_pydict({"at": pa.array(word), "bits": pa.array(bits)})

    def has(self, keys: np.ndarray) -> np.ndarray:
        table = self.shared.value
        a, b = self._slots(keys)
        return ((table[a >> 6] >> (a & 63)) & (table[b >> 6] >> (b & 63)) & 1) == 1

    def of(self, batch: pa.RecordBatch, column: str) -> pa.RecordBatch:
        """Rows of a batch whose long is among them, and a few others; not those with a null."""
        key = batch.column(column)
        return batch.filter(pa.array(self.has(key.fill_null(0).to_numpy()) & key.is_valid().to_numpy(zero_copy_only=False)))

    def rows(self, df: DataFrame, column: str) -> DataFrame:
        of = self.of
        return df.mapInArrow(lambda batches: (of(b, column) for b in batches), df.schema)


def _arrow(kind: str) -> pa.DataType:
    plain = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}
    return plain[kind] if kind in plain else pa.list_(plain[kind[6:-1]])
