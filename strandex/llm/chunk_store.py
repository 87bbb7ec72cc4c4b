"""Content-addressed store of token ids.

A rolling hash over 16 ids cuts each document's id stream into chunks; a chunk is
named by the BLAKE2 digest of its ids and stored once. A recipe per document lists
its chunks in order, and has its place in the sequence of all ids in ascending key
order. Merkle roots (of the chunks of each document, and of each file of chunks)
let a reader verify what it reads. The tables are Parquet, in a folder that driver
and executors share:

  format    width (bytes of an id: 2 or 4, as the tokenizer's largest id needs)
  chunks    name, ids (little-endian unsigned, `width` bytes each), file, place
  recipes   key, n_tokens, names, root, part, place, before (ids before it in its part)
  manifest  file, n_chunks, root (of the chunk names of that file, in order)
  totals    part, start (ids before the part)

Null text counts as empty; with an end id such a document has one token. Rows with
equal keys follow each other in the order of their roots. Rows with a null key come
first. Cuts depend on the ids alone, so equal passages share chunks wherever they are.
A chunk that many documents share is sent once for each batch of rows when it is stored;
documents with equal roots take part in the join with their chunks once. What is left of
a chunk in very many different recipes is a skewed key of narrow rows, which adaptive
execution splits. No task holds more than a batch, a document or a tree's edge.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe
from .flat import U8, map_texts, mix
from .storage import new_path, remove

WINDOW, SHORTEST, LONGEST, MASK = 16, 64, 1024, U8(0xFF)


def _gear() -> np.ndarray:
    return mix(np.arange(1 << 16, dtype=U8) + U8(0x51ED270B))


@lru_cache(maxsize=1)
def _gear_table() -> np.ndarray:
    return _gear()


def cut_points(ids: np.ndarray) -> np.ndarray:
    """Where the rolling hash of the last 16 ids allows a cut (ends of chunks), for a flat array."""
    h = _gear_table()[ids & 0xFFFF] ^ (ids >> 16).astype(U8)
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << U8(k))
    return np.flatnonzero((h >> U8(24)) & MASK == 0) + 1


def chunk_ends(n: int, cuts: list[int]) -> list[int]:
    """Ends of the chunks of n ids with allowed cuts (ascending): at the first cut from SHORTEST on, or at LONGEST."""
    ends, at = [], 0
    for c in cuts:
        while c - at > LONGEST:
            at += LONGEST
            ends.append(at)
        if c - at >= SHORTEST and c < n:
            at = c
            ends.append(at)
    while n - at > LONGEST:
        at += LONGEST
        ends.append(at)
    if n > at:
        ends.append(n)
    return ends


class Tree:
    """A binary Merkle tree that takes its leaves one by one; an odd node moves up unchanged. No leaf: the digest of nothing."""

    def __init__(self):
        self.edge: list[tuple[int, bytes]] = []  # (height, digest) of whole subtrees, falling

    def add(self, leaf: bytes) -> None:
        at, x = 0, hashlib.blake2b(b"\0" + leaf, digest_size=16).digest()
        while self.edge and self.edge[-1][0] == at:
            at, x = at + 1, self._both(self.edge.pop()[1], x)
        self.edge.append((at, x))

    @staticmethod
    def _both(a: bytes, b: bytes) -> bytes:
        return hashlib.blake2b(b"\1" + a + b, digest_size=16).digest()

    def root(self) -> bytes:
        if not self.edge:
            return hashlib.blake2b(digest_size=16).digest()
        x = self.edge[-1][1]
        for _, left in self.edge[-2::-1]:
            x = self._both(left, x)
        return x


def merkle(leaves: list[bytes]) -> bytes:
    tree = Tree()
    for x in leaves:
        tree.add(x)
    return tree.root()


def name_of(ids: bytes) -> bytes:
    return hashlib.blake2b(ids, digest_size=16).digest()


def _encoded(df: DataFrame, path: str, end_id: int | None, width: int, key: str, text: str) -> DataFrame:
    kind = np.dtype(f"<u{width}")

    def run(keys, texts):
        ids, off = bytebpe.model(path).encode([t or "" for t in texts])
        if end_id is not None:
            ids = np.insert(ids, off[1:], end_id)
            off = off + np.arange(len(off))
        cuts = cut_points(ids)
        at = np.searchsorted(cuts, off, side="right")
        raw = ids.astype(kind).tobytes()
        out = {"key": keys[key], "n_tokens": np.diff(off).tolist(), "ids": [], "ends": [], "names": [], "root": []}
        for d, (lo, hi) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
            own = cuts[at[d] : at[d + 1]] - lo
            ends = chunk_ends(hi - lo, own[own >= WINDOW].tolist())
            doc = raw[lo * width : hi * width]
            names = [name_of(doc[a * width : b * width]) for a, b in zip([0, *ends], ends, strict=False)]
            for c, v in zip(("ids", "ends", "names", "root"), (doc, ends, names, merkle(names)), strict=True):
                out[c].append(v)
        return out

    return map_texts(df, [key], text, run, "key long, n_tokens long, ids binary, ends array<int>, names array<binary>, root binary")


def write_store(df: DataFrame, path: str, end_id: int | None = None, key: str = "doc_id", text: str = "text") -> str:
    """Encode every text with the tokenizers file at `path` and write the store; returns its folder."""
    spark = df.sparkSession
    largest = max(bytebpe.model(path).largest_id, end_id or 0)
    width = 2 if largest < 1 << 16 else 4
    at = new_path(spark, "chunk-store")
    stage = f"{at}/stage"
    spark.createDataFrame([(width,)], "width int").coalesce(1).write.parquet(f"{at}/format")
    _encoded(df, path, end_id, width, key, text).write.option("compression", "zstd").parquet(stage)
    staged = spark.read.parquet(stage)

    def pieces(batches):
        for batch in batches:
            found: dict[bytes, bytes] = {}
            for ids, ends, own in zip(*(batch.column(c).to_pylist() for c in ("ids", "ends", "names")), strict=True):
                for a, b, name in zip([0, *ends], ends, own, strict=False):
                    if name not in found:
                        found[name] = ids[a * width : b * width]
            yield pa.RecordBatch.from_pydict({"name": pa.array(found.keys(), pa.binary()), "ids": pa.array(found.values(), pa.binary())})

    def once(batches):
        file, place, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            new = []
            for i, name in enumerate(batch.column("name").to_pylist()):
                if name != last:
                    new.append(i)
                last = name
            kept = batch.take(pa.array(new, pa.int64()))
            yield pa.RecordBatch.from_pydict({"name": kept.column("name"), "ids": kept.column("ids"), "file": pa.array([file] * len(new), pa.int64()), "place": pa.array(range(place, place + len(new)), pa.int64())})
            place += len(new)

    unique = staged.select("ids", "ends", "names").mapInArrow(pieces, "name binary, ids binary").repartition("name").sortWithinPartitions("name").mapInArrow(once, "name binary, ids binary, file long, place long")
    unique.write.option("compression", "zstd").parquet(f"{at}/chunks")

    def placed(batches):
        part, place, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            ends = before + np.cumsum(n)
            out = {c: batch.column(c) for c in ("key", "n_tokens", "names", "root")}
            yield pa.RecordBatch.from_pydict(out | {"part": pa.array(np.full(len(n), part, np.int64)), "place": pa.array(np.arange(place, place + len(n))), "before": pa.array(ends - n)})
            place, before = place + len(n), int(ends[-1]) if len(n) else before

    order = staged.select("key", "n_tokens", "names", "root").repartitionByRange("key").sortWithinPartitions("key", "root")
    order.mapInArrow(placed, "key long, n_tokens long, names array<binary>, root binary, part long, place long, before long").write.parquet(f"{at}/recipes")
    remove(spark, stage)
    _file_roots(spark, at).write.parquet(f"{at}/manifest")
    # one row for each part of the recipes: as many as there are partitions
    sizes = spark.read.parquet(f"{at}/recipes").groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    start, rows = 0, []
    for r in sorted(sizes, key=lambda r: r["part"]):
        rows.append((r["part"], start))
        start += r["n"]
    spark.createDataFrame(rows, "part long, start long").coalesce(1).write.parquet(f"{at}/totals")
    return at


def _file_roots(spark: SparkSession, at: str) -> DataFrame:
    """file, n_chunks, root of every file of chunks, as it is now."""

    def roots(batches):
        file, n, tree = None, 0, Tree()

        def row():
            return pa.RecordBatch.from_pydict({"file": pa.array([file], pa.int64()), "n_chunks": pa.array([n], pa.int64()), "root": pa.array([tree.root()], pa.binary())})

        for batch in batches:
            for f, name in zip(batch.column("file").to_pylist(), batch.column("name").to_pylist(), strict=True):
                if f != file:
                    if n:
                        yield row()
                    file, n, tree = f, 0, Tree()
                tree.add(name)
                n += 1
        if n:
            yield row()

    names = spark.read.parquet(f"{at}/chunks").select("file", "place", "name")
    return names.repartition("file").sortWithinPartitions("file", "place").select("file", "name").mapInArrow(roots, "file long, n_chunks long, root binary")


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """[n, byte of the register, its value]: the CRC register after 4n more zero bytes, for combining CRCs."""
    byte = np.arange(256, dtype=np.uint32)
    table = byte.copy()
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    out = np.zeros((LONGEST + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = byte << np.uint32(8 * k)
    for n in range(1, LONGEST + 1):
        x = out[n - 1]
        for _ in range(4):
            x = (x >> np.uint32(8)) ^ table[x & np.uint32(0xFF)]
        out[n] = x
    return out


def crc_join(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of the concatenation of chunks given as (CRC-32, number of 4-byte ids)."""
    t, crc = _shifts(), 0
    for c, n in parts:
        s = t[n]
        crc = int(s[0, crc & 255] ^ s[1, crc >> 8 & 255] ^ s[2, crc >> 16 & 255] ^ s[3, crc >> 24]) ^ c
    return crc


def _chunks_read(spark: SparkSession, at: str, width: int) -> DataFrame:
    """name, n, crc of each stored chunk, computed from its bytes; a chunk that is not what its name says is an error."""

    def read(batches):
        for batch in batches:
            names, ids = batch.column("name").to_pylist(), batch.column("ids").to_pylist()
            if any(name_of(i) != n for n, i in zip(names, ids, strict=True)):
                raise ValueError("a chunk differs from its name")
            crc = [zlib.crc32(np.frombuffer(i, f"<u{width}").astype("<u4").tobytes()) for i in ids]
            yield pa.RecordBatch.from_pydict({"name": batch.column("name"), "n": pa.array([len(i) // width for i in ids], pa.int64()), "crc": pa.array(crc, pa.int64())})

    return spark.read.parquet(f"{at}/chunks").select("name", "ids").mapInArrow(read, "name binary, n long, crc long")


def _recipe_chunks(spark: SparkSession, at: str) -> DataFrame:
    """root, i, name: the chunks of each distinct recipe."""
    recipes = spark.read.parquet(f"{at}/recipes").groupBy("root").agg(F.first("names").alias("names"))
    return recipes.select("root", F.posexplode("names").alias("i", "name"))


def _width(spark: SparkSession, at: str) -> int:
    return spark.read.parquet(f"{at}/format").first()["width"]


def store_digests(spark: SparkSession, at: str, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens, ids_crc32 of each document, from the files of the store.

    The manifest is verified first. The bytes of each unique chunk are read and hashed
    once; a document's CRC is put together from those of its chunks, after its Merkle root
    has been verified. What is missing, or not as long as its recipe says, is an error.
    """
    if not verify_manifest(spark, at).isEmpty():
        raise ValueError("files of chunks differ from the manifest")

    def join(batches):
        for batch in batches:
            crc, n = [], []
            for root, chunks in zip(batch.column("root").to_pylist(), batch.column("chunks").to_pylist(), strict=True):
                own = sorted(chunks, key=lambda c: c["i"])
                if merkle([c["name"] for c in own]) != root:
                    raise ValueError("a recipe's chunks do not give its root")
                crc.append(crc_join([(c["crc"], c["n"]) for c in own]))
                n.append(sum(c["n"] for c in own))
            yield pa.RecordBatch.from_pydict({"root": batch.column("root"), "n": pa.array(n, pa.int64()), "crc": pa.array(crc, pa.int64())})

    parts = _recipe_chunks(spark, at).join(_chunks_read(spark, at, _width(spark, at)), "name")
    docs = parts.groupBy("root").agg(F.collect_list(F.struct("i", "name", "n", "crc")).alias("chunks")).mapInArrow(join, "root binary, n long, crc long")
    recipes = spark.read.parquet(f"{at}/recipes").select("key", "part", "root", "before", "n_tokens")
    starts = F.broadcast(spark.read.parquet(f"{at}/totals"))  # a row for each partition of the recipes
    out = recipes.join(docs, "root", "left").join(starts, "part").withColumn("n", F.coalesce("n", F.lit(0)))
    whole = F.when(F.col("n") == F.col("n_tokens"), F.col("n")).otherwise(F.raise_error("a document's chunks are missing").cast("long"))
    return out.select(F.col("key").alias(key), (F.col("start") + F.col("before")).alias("start"), whole.alias("n_tokens"), F.coalesce("crc", F.lit(0)).alias("ids_crc32"))


def store_documents(spark: SparkSession, at: str, key: str = "doc_id") -> DataFrame:
    """key, ids array<int>: the documents put together from their chunks."""
    width = _width(spark, at)

    def join(batches):
        for batch in batches:
            ids = [np.frombuffer(b"".join(c["ids"] for c in sorted(chunks, key=lambda c: c["i"])), f"<u{width}").astype(np.int32) for chunks in batch.column("chunks").to_pylist()]
            yield pa.RecordBatch.from_pydict({"root": batch.column("root"), "ids": pa.array(ids, pa.list_(pa.int32()))})

    chunks = spark.read.parquet(f"{at}/chunks").select("name", "ids")
    parts = _recipe_chunks(spark, at).join(chunks, "name").groupBy("root").agg(F.collect_list(F.struct("i", "ids")).alias("chunks"))
    recipes = spark.read.parquet(f"{at}/recipes").select("key", "root")
    whole = recipes.join(parts.mapInArrow(join, "root binary, ids array<int>"), "root", "left")
    return whole.select(F.col("key").alias(key), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def verify_manifest(spark: SparkSession, at: str) -> DataFrame:
    """Files of chunks whose number or Merkle root is not that of the manifest; empty for a sound store."""
    now = _file_roots(spark, at).withColumnsRenamed({"n_chunks": "n_now", "root": "root_now"})
    return spark.read.parquet(f"{at}/manifest").join(now, "file", "full").filter("NOT (root <=> root_now AND n_chunks <=> n_now)")


__all__ = ["Tree", "chunk_ends", "crc_join", "cut_points", "merkle", "store_digests", "store_documents", "verify_manifest", "write_store"]
