"""The index on disk: a folder for each generation, and a pointer that names the current one.

A refresh without a change reads the sources and writes nothing. With one, it writes a
whole new generation beside the current one, compares the sources once more, and moves the
pointer by a rename; readers resolve the pointer once, so they see one generation.
Unchanged files keep their rows (sections, postings, vectors), so only new and changed
content is split, tokenised and encoded. Builders claim their generation's folder by a file
that only one can make, and publish only if the pointer is still the one they started from.

The pointer carries what a query needs of the whole index (rows, mean length), the state
of the vectors and why they are not ready: a fixed, small document.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encoder import DISABLED, MANIFEST_CHANGED, READY, REFRESH_FAILED, STALE, VECTOR_TABLE_CORRUPT
from ..functions.vectors import is_valid
from ..operators import lexical, postings
from ..operators.freshness import delete_by, diff, needs_embedding, same_sources
from ..operators.search import Index
from . import files, markdown
from .config import Config, canonical_json

SCHEMA_VERSION = 3
POINTER = "current.json"
#: Known schemas: opening a table runs no job.
SCHEMAS = {
    "files": "path string, root_id string, content_hash string",
    "new": markdown.SECTION_SCHEMA,
    "sections": markdown.SECTION_SCHEMA,
    "postings": postings.SCHEMA + ", bucket int",
    "vectors": "section_id string, path string, root_id string, content_hash string, encoder string, vector array<float>",
}


class StoreError(RuntimeError):
    pass


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def pointer(self) -> dict | None:
        text = files.read_text(self.spark, f"{self.path}/{POINTER}")
        if text is None:
            return None
        got = json.loads(text)
        if got.get("schema") != SCHEMA_VERSION:
            raise StoreError(f"schema {got.get('schema')} instead of {SCHEMA_VERSION}: rebuild the index")
        return got

    def folder(self, name: str, generation: int) -> str:
        return f"{self.path}/g{generation:08d}/{name}"

    def table(self, name: str, generation: int | None = None) -> DataFrame:
        if generation is None:
            at = self.pointer()
            if at is None:
                raise StoreError("no index")
            generation = at["generation"]
        return self.spark.read.schema(SCHEMAS[name]).parquet(self.folder(name, generation))

    def write(self, df: DataFrame, name: str, generation: int) -> None:
        df.write.mode("overwrite").parquet(self.folder(name, generation))

    def last_generation(self) -> int:
        return max([int(n[1:]) for n in files.names(self.spark, self.path) if n[:1] == "g" and n[1:].isdigit()], default=0)

    def prune(self, keep: int = 2) -> None:
        """Remove generations older than the current one and its predecessors, `keep` in all."""
        at = self.pointer()
        for n in files.names(self.spark, self.path):
            if at and n[:1] == "g" and n[1:].isdigit() and int(n[1:]) <= at["generation"] - keep:
                files.remove(self.spark, f"{self.path}/{n}")


    def claim(self) -> int:
        """A generation of one's own."""
        generation = self.last_generation() + 1
        while not files.create_new(self.spark, self.folder("_claim", generation)):
            generation += 1
        return generation

    def current(self) -> int:
        """The generation that is published; 0 before the first, or under another schema."""
        try:
            return (self.pointer() or {"generation": 0})["generation"]
        except StoreError:
            return 0

    def publish(self, pointer: dict, base: int) -> None:
        """Make the generation current, if `base` still is."""
        with files.lock(self.spark, f"{self.path}/publish.lock"):
            if self.current() != base:
                raise StoreError("another build was published meanwhile")
            files.replace_text(self.spark, f"{self.path}/{POINTER}", canonical_json(pointer) + "\n")


def build(spark: SparkSession, config: Config, rebuild: bool = False, encoder: Callable[[DataFrame], DataFrame] | None = None, encoder_version: str = "none") -> dict:
    """Bring the index up to date; returns the pointer.

    encoder: (section_id, text) rows -> section_id, vector. If it fails, the text index
    is published all the same, without the vectors of new content, in state stale. If the
    sources change while the generation is written, the old one stays current.
    """
    store = Store(spark, config.store)
    base = store.current()
    old = store.pointer() if base and not rebuild else None
    notes = markdown.scan(spark, list(config.roots), list(config.private))
    live, touched = notes.select("path", "root_id", "content_hash").persist(), None
    try:
        if old:
            touched = diff(store.table("files", old["generation"]), live).filter("change <> 'unchanged'").select("path")
            if old["section_bytes"] != config.section_bytes:
                touched = touched.unionByName(live.select("path")).distinct()
            elif _serves(old, config, encoder is not None, encoder_version) and touched.isEmpty():
                return old
        generation = store.claim()
        store.write(live, "files", generation)
    finally:
        live.unpersist()
    live = store.table("files", generation)
    if old:
        new = markdown.split(notes.join(touched, "path", "left_semi"), config.section_bytes)
        kept = delete_by(store.table("sections", old["generation"]), touched)
    else:
        kept, new = None, markdown.split(notes, config.section_bytes)
    store.write(new, "new", generation)
    new = store.table("new", generation)
    store.write(new if kept is None else kept.unionByName(new), "sections", generation)
    sections = store.table("sections", generation)
    own = postings.postings(lexical.index(new))
    if old:
        own = own.unionByName(delete_by(store.table("postings", old["generation"]), touched).select(*own.columns))
    size = postings.postings_size(own)
    buckets = postings.buckets_for(size["rows"])
    postings.write(own, store.folder("postings", generation), buckets, parts=1 + size["rows"] // (postings.BUCKET_ROWS * buckets))
    state = _embed(store, old, sections, generation, encoder, encoder_version)
    changed = not same_sources(live, notes)
    files.remove(spark, store.folder("new", generation))
    if changed:
        if old:
            return old
        raise StoreError("the sources changed while they were read")
    count = sections.count()
    pointer = {
        "schema": SCHEMA_VERSION, "generation": generation, "sections": count, "section_bytes": config.section_bytes, "buckets": buckets,
        "mean_length": size["words"] / count if count else 0.0, "config": config.fingerprint, "encoder": encoder_version, **state,
    }
    store.publish(pointer, base)
    return pointer


def _serves(old: dict, config: Config, encodes: bool, version: str) -> bool:
    """Is the generation what a build of unchanged sources would make?"""
    vectors = (old["state"], old["encoder"]) == (READY, version) if encodes else old["state"] == DISABLED
    return vectors and old["config"] == config.fingerprint


def _embed(store: Store, old: dict | None, sections: DataFrame, generation: int, encoder, version: str) -> dict:
    if encoder is None:
        return {"state": DISABLED, "reason": "NO_ENCODER"}
    wanted = sections.select("section_id", "path", "root_id", "content_hash", "text").withColumn("encoder", F.lit(version))
    kept = None
    try:
        if old and old.get("vectors") is not None:
            before = store.table("vectors", old["generation"])
            kept = before.filter(is_valid(F.col("vector"), old["size"])).join(wanted, ["section_id", "path", "root_id", "content_hash", "encoder"], "left_semi")
        missing = wanted if kept is None else needs_embedding(wanted, kept.select("section_id", "content_hash", "encoder"), ["encoder"])
        made = encoder(missing.select("section_id", "text")).join(missing.drop("text"), "section_id").select("section_id", "path", "root_id", "content_hash", "encoder", F.col("vector").cast("array<float>").alias("vector"))
        store.write(made if kept is None else kept.unionByName(made), "vectors", generation)
    except Exception as e:  # an encoder is foreign code: whatever it raises, the text index is good
        if kept is not None:
            store.write(kept, "vectors", generation)
        return {"state": STALE, "reason": REFRESH_FAILED, "error": type(e).__name__}
    got = store.table("vectors", generation).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("size")).first()
    return {"state": READY, "reason": None, "vectors": got["n"], "size": got["size"] or 0}


def state_of(spark: SparkSession, config: Config, encoder_version: str | None = None) -> tuple[str, str | None]:
    """State of the vectors of the current generation, and the reason if they are not ready."""
    try:
        at = Store(spark, config.store).pointer()
    except (StoreError, ValueError):
        return DISABLED, "INDEX_UNAVAILABLE"
    if at is None:
        return DISABLED, "INDEX_MISSING"
    if at["state"] == READY and encoder_version is not None and at["encoder"] != encoder_version:
        return STALE, MANIFEST_CHANGED
    if at["state"] == READY and at["vectors"] != at["sections"]:
        return STALE, VECTOR_TABLE_CORRUPT
    return at["state"], at["reason"]


def open_index(spark: SparkSession, config: Config, live: bool = True, gone: frozenset[str] = frozenset()) -> Index | None:
    """The current generation, or None before the first; with `live`, or sources that count as `gone`, hits are compared with the files as they are now."""
    store = Store(spark, config.store)
    at = store.pointer()
    if at is None:
        return None
    g = at["generation"]
    now = (lambda paths: markdown.hashes_now(spark, config, paths - gone)) if live or gone else None
    vectors = store.table("vectors", g) if at["state"] == READY else None
    return Index(store.table("sections", g), list(config.roots), list(config.global_notes), now, vectors, config.synonyms, store.table("postings", g), at["sections"], at["mean_length"], at["buckets"], g)
