"""Encoders of text: a callable or an object with `encode(list of texts)`, run over a column in batches.

`HashEncoder` needs no model; `OnnxEncoder` runs a model bundle (model.onnx, vocab.txt,
manifest.json with SHA-256 digests) once for each Python worker.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from importlib.metadata import PackageNotFoundError, version

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .text import index_form

READY, STALE, DISABLED = "ready", "stale", "disabled"
EXTRA_MISSING, MODEL_MISSING, MODEL_HASH_MISMATCH = "EXTRA_MISSING", "MODEL_MISSING", "MODEL_HASH_MISMATCH"
MANIFEST_CHANGED, VECTOR_TABLE_CORRUPT, REFRESH_FAILED = "MANIFEST_CHANGED", "VECTOR_TABLE_CORRUPT", "REFRESH_FAILED"
FILES = ("model.onnx", "vocab.txt")


class HashEncoder:
    """Words hashed to signed places of a vector: texts that share words are near each other."""

    def __init__(self, size: int = 384):
        self.size, self.version = size, f"hash-{size}"

    def encode(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.size))
        for n, t in enumerate(texts):
            for w in index_form(t or "").split():
                d = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[n, d % self.size] += 1 if d >> 63 else -1
            if not out[n].any():
                out[n, 0] = 1
        return (out / np.linalg.norm(out, axis=1, keepdims=True)).tolist()


def manifest_fingerprint(manifest: dict) -> str:
    return hashlib.sha256(json.dumps(manifest, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _installed(name: str) -> str | None:
    try:
        return version(name)
    except PackageNotFoundError:
        return None


def backend_reason(bundle: str | None, installed: Callable[[str], str | None] = _installed) -> str | None:
    """Why a bundle cannot serve, or None if it can."""
    if bundle is None or not os.path.isfile(os.path.join(bundle, "manifest.json")):
        return MODEL_MISSING
    if installed("numpy") is None or installed("onnxruntime") is None:
        return EXTRA_MISSING
    with open(os.path.join(bundle, "manifest.json"), encoding="utf-8") as f:
        wanted = json.load(f).get("files", {})
    for name in FILES:
        at = os.path.join(bundle, name)
        if name not in wanted or not os.path.isfile(at):
            return MODEL_MISSING
        with open(at, "rb") as f:
            if hashlib.file_digest(f, "sha256").hexdigest() != wanted[name]:
                return MODEL_HASH_MISMATCH
    return None


class OnnxEncoder:
    """Masked mean of a model's last layer, at unit length. The session is made where it is first used."""

    def __init__(self, bundle: str, length: int = 512, batch: int = 64):
        self.bundle, self.length, self.batch, self._session = bundle, length, batch, None
        with open(os.path.join(bundle, "manifest.json"), encoding="utf-8") as f:
            self.version = manifest_fingerprint(json.load(f))

    def __getstate__(self):
        return self.__dict__ | {"_session": None}

    def _load(self):
        import onnxruntime

        from .wordpiece import WordPiece

        with open(os.path.join(self.bundle, "vocab.txt"), encoding="utf-8") as f:
            words = {line.rstrip("\n"): n for n, line in enumerate(f)}
        self._session = onnxruntime.InferenceSession(os.path.join(self.bundle, "model.onnx"), providers=["CPUExecutionProvider"])
        self._words = WordPiece(words, self.length)

    def encode(self, texts: list[str]) -> list[list[float]]:
        if self._session is None:
            self._load()
        out = []
        for lo in range(0, len(texts), self.batch):
            ids = [self._words.encode(t or "") for t in texts[lo : lo + self.batch]]
            width = max(map(len, ids))
            tokens, mask = np.zeros((len(ids), width), np.int64), np.zeros((len(ids), width), np.int64)
            for n, i in enumerate(ids):
                tokens[n, : len(i)], mask[n, : len(i)] = i, 1
            fed = {"input_ids": tokens, "attention_mask": mask, "token_type_ids": np.zeros_like(tokens)}
            names = {x.name for x in self._session.get_inputs()}
            layer = self._session.run(None, {k: v for k, v in fed.items() if k in names})[0]
            mean = (layer * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)
            out += (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)).tolist()
        return out


def bundle_token(bundle: str) -> tuple:
    """What tells one state of a bundle's files from another, without reading them."""
    found = sorted(os.scandir(bundle), key=lambda e: e.name) if os.path.isdir(bundle) else []
    return tuple((e.name, e.stat().st_mtime_ns, e.stat().st_size) for e in found)


class LazyEncoder:
    """An encoder that a factory makes at its first use. A failure is remembered, and raised again, as long as the token stays the same."""

    def __init__(self, factory: Callable[[], object], token: Callable[[], object] = lambda: None, version: str | None = None):
        self.factory, self.token, self._version = factory, token, version
        self._made, self._failed = None, None

    def get(self):
        if self._made is None:
            now = self.token()
            if self._failed is not None and self._failed[0] == now:
                raise self._failed[1]
            try:
                self._made, self._failed = self.factory(), None
            except Exception as e:  # foreign code
                self._failed = (now, e)
                raise
        return self._made

    @property
    def version(self) -> str:
        return self._version or self.get().version

    def encode(self, texts: list[str]) -> list[list[float]]:
        return self.get().encode(texts)


def encode_rows(rows: DataFrame, encoder, key: str = "section_id", text: str = "text") -> DataFrame:
    """key, vector (array of float) of every row; one Arrow batch at a time is in memory."""
    apply = getattr(encoder, "encode", encoder)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f[key], "vector": [list(map(float, v)) for v in apply(f[text].fillna("").tolist())]})

    return rows.select(key, text).mapInPandas(run, f"{key} string, vector array<float>")
