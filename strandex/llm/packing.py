"""Conflict-constrained best-fit packing of documents into bins of a token capacity.

No bin holds two documents of one source or of one duplicate cluster. Bins are kept in
the order of their residual space and carry a bitmap of sources and one of clusters;
for each document, from the longest to the shortest, the search begins at the smallest
residual that fits and goes to the successor until a bin is compatible, so it ends at
the tightest compatible bin of its shard, or with a new bin.

A duplicate cluster is a component of near_duplicates (its defaults: five words, Jaccard
index 0.8), with each distinct text as a node, named by its digest: so near copies are
in one cluster, and rows with a null or repeated key take part as well.

Documents are dealt into shards of about SHARD pieces by a hash, so a shard fits a task
whatever the corpus' size, and sources and clusters of any frequency are spread over all
shards; each shard is packed by itself. The price is one set of last bins for a shard.

A text longer than the capacity is cut into pieces of full capacity, each with a bin of
its own, and a last piece, which is packed like any other. Null and empty texts have no
tokens: one piece of size 0. A null source, and a null or empty text's cluster, conflict
with nothing. Repeated rows and rows with a null key are packed like any other.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytebpe
from .flat import map_texts
from .minhash import near_duplicates
from .storage import written

SHARD = 4096


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, place of the first token in it) of each item, for items in the order given; the order should be by falling size."""
    bit: dict = {}
    bins: list[tuple[int, int]] = []  # (residual, bin), ascending
    maps: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        own = 0
        for name in (("s", source), ("c", cluster)):
            if name[1] is not None:
                own |= 1 << bit.setdefault(name, len(bit))
        at = bisect_left(bins, (size, -1))
        while at < len(bins) and maps[bins[at][1]] & own:
            at += 1
        if at < len(bins):
            left, b = bins.pop(at)
            maps[b] |= own
        else:
            left, b = capacity, len(maps)
            maps.append(own)
        insort(bins, (left - size, b))
        out.append((b, capacity - left))
    return out


def text_digest(text: str = "text"):
    """64 bits that name a text; null for a null or empty one."""
    own = F.col(f"`{text}`").cast("string")
    return F.when(F.length(own) > 0, F.xxhash64(own))


def token_items(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, n_tokens, source, cluster (of near copies) of every row."""

    def run(keys, texts):
        strings = [None if s is None else str(s) for s in keys[source]]
        return {"key": keys[key], "n_tokens": bytebpe.model(path).count([t or "" for t in texts]).tolist(), "source": strings, "digest": keys["_digest"]}

    named = df.withColumn("_digest", text_digest(text))
    items = written(map_texts(named, [key, source, "_digest"], text, run, "key long, n_tokens long, source string, digest long"), "token-items")
    copies = near_duplicates(named, key="_digest", text=text).filter("_digest <> component_id").groupBy("_digest").agg(F.min("component_id").alias("component_id"))
    return items.join(copies, F.col("digest") == F.col("_digest"), "left").select("key", "n_tokens", "source", F.coalesce("component_id", "digest").alias("cluster"))


def pack(items: DataFrame, capacity: int, key: str = "key") -> DataFrame:
    """items: key, n_tokens, source, cluster -> key, piece, n_tokens, bin_id, bin_start: a row for each piece."""
    pieces = F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1)).cast("long")
    cut = items.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    size = F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).cast("long")
    cut = written(cut.select(F.col(key).alias("key"), F.col("piece").cast("long"), size.alias("size"), F.when(F.col("n_tokens") > 0, F.col("cluster")).alias("cluster"), F.col("source").cast("string").alias("source")), "pieces")
    shards = max(1, -(-cut.count() // SHARD))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("key", "piece", "size", "cluster"), F.lit(shards)))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("size", "descending"), ("key", "ascending"), ("piece", "ascending"), ("cluster", "ascending"), ("source", "ascending")])
        placed = best_fit(*(t.column(c).to_pylist() for c in ("size", "source", "cluster")), capacity)
        base = t.column("shard")[0].as_py() << 32
        cols = {"key": t.column("key"), "piece": t.column("piece"), "n_tokens": t.column("size")}
        return pa.table(cols | {"bin_id": pa.array([base + b for b, _ in placed], pa.int64()), "bin_start": pa.array([s for _, s in placed], pa.int64())})

    return dealt.groupBy("shard").applyInArrow(run, "key long, piece long, n_tokens long, bin_id long, bin_start long").withColumnRenamed("key", key)


def pack_documents(df: DataFrame, path: str, capacity: int, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return pack(token_items(df, path, key, text, source), capacity).withColumnRenamed("key", key)
