"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

`encode` gives the ids of the sentencepiece library for a BPE model with byte
fallback, the identity normaliser and a dummy prefix; `decode` is its inverse.
Pieces of such a model never hold a word mark after another character, so a text
splits into words (marks, then other characters) that merge independently; each
distinct word of a slice is encoded once.

Null text counts as empty. An empty text has the end id only. Rows are kept as
they are, repeated or with a null key. Memory is bounded by the slice.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .bpe import Merges
from .flat import codepoints, map_texts, offsets, span_hash, spread, sums

MARK = 0x2581
_RAW = 1 << 21  # symbol of a character that is no piece: _RAW + its code point


class PieceModel:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.size, self.eos = sp.get_piece_size(), sp.eos_id()
        pieces = [sp.id_to_piece(i) for i in range(self.size)]
        plain = {p: i for i, p in enumerate(pieces) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        if any(chr(MARK) in p.lstrip(chr(MARK)) for p in plain):
            raise ValueError("pieces with a word mark inside are not supported")
        self.byte_id = np.zeros(256, np.int32)
        surface: list[bytes] = []
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                surface.append(bytes([int(p[3:5], 16)]))
            else:
                surface.append(p.replace(chr(MARK), " ").encode() if p in plain else b"")
        # unknown surfaces as the library prints them
        surface[sp.unk_id()] = " ⁇ ".encode()
        self.first_char = np.array([s[:1] == b" " for s in surface])
        self.surface, self.surface_len = np.frombuffer(b"".join(surface), np.uint8), np.fromiter(map(len, surface), np.int64, self.size)
        self.surface_at = offsets(self.surface_len)[:-1]
        self.decimal = [str(i).encode() for i in range(self.size)]

        symbol = {p: i for p, i in plain.items()}
        for p in plain:
            for ch in p:
                symbol.setdefault(ch, _RAW + ord(ch))
        self.of_char = np.arange(0x110000, dtype=np.int32) + np.int32(_RAW)
        for p, i in plain.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in plain.values()}, reverse=True))}
        rows = [(symbol[p[:k]], symbol[p[k:]], order[sp.get_score(i)], i) for p, i in plain.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        self.merges = Merges(*zip(*rows, strict=True))

    def words(self, texts: list[str]):
        """Distinct words of texts: (ids flat, ids of each, distinct word of each occurrence, occurrences by document)."""
        cps = codepoints("".join([f"▁{t}" if t else "" for t in texts]))
        off = offsets(np.fromiter((len(t) + 1 if t else 0 for t in texts), np.int64, len(texts)))
        cps = np.where(cps == 32, np.uint32(MARK), cps)
        mark = cps == MARK
        first = mark.copy()
        first[1:] &= ~mark[:-1]
        first[off[:-1][off[:-1] < off[1:]]] = True
        starts = np.flatnonzero(first)
        counts = np.diff(np.append(starts, len(cps)))
        _, one, which = np.unique(span_hash(cps, starts, counts), return_index=True, return_inverse=True)
        n = counts[one]
        ids, n_ids = self.merges.encode(self.of_char[cps[spread(starts[one], n)]], n)
        if len(raw := np.flatnonzero(ids >= _RAW)):
            ids, n_ids = self._bytes(ids, n_ids, raw)
        return ids, n_ids, which, np.searchsorted(starts, off)

    def _bytes(self, ids, n_ids, raw):
        """Characters without a piece become their UTF-8 bytes."""
        enc = [chr(c).encode() for c in (ids[raw] - _RAW).tolist()]
        size = np.ones(len(ids), np.int64)
        size[raw] = list(map(len, enc))
        out = np.repeat(ids, size)
        out[spread((np.cumsum(size) - size)[raw], size[raw])] = self.byte_id[np.frombuffer(b"".join(enc), np.uint8)]
        return out, sums(size, offsets(n_ids))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids with the end id, and the offsets of the texts in them."""
        ids, n_ids, which, docs = self.words(texts)
        first = offsets(n_ids)[:-1]
        n = n_ids[which]
        flat = ids[spread(first[which], n)]
        per_doc = sums(n, docs)
        ends = np.cumsum(per_doc)
        return np.insert(flat, ends, self.eos), offsets(per_doc + 1)

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
        """UTF-8 of the texts whose ids are ids[off[i]:off[i+1]]; control ids give nothing, the dummy prefix goes."""
        n = self.surface_len[ids]
        flat = self.surface[spread(self.surface_at[ids], n)].tobytes()
        at = offsets(n)[off]
        out = []
        for lo, hi, a, b in zip(at[:-1].tolist(), at[1:].tolist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
            skip = int(b > a and bool(self.first_char[ids[a]]))
            out.append(flat[lo + skip : hi])
        return out


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_pieces(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids array<int> (with the end id), decoded string."""

    def run(keys, texts):
        m = model(path)
        ids, off = m.encode([t or "" for t in texts])
        return {"key": keys[key], "ids": [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)], "decoded": [d.decode(errors="replace") for d in m.decode(ids, off)]}

    return map_texts(df, [key], text, run, "key long, ids array<int>, decoded string").withColumnRenamed("key", key)


def piece_digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of the encoding and of the text decoded from it."""

    def run(keys, texts):
        m = model(path)
        ids, n_ids, which, docs = m.words([t or "" for t in texts])
        at = offsets(n_ids)
        decimal, flat = m.decimal, ids.tolist()
        word = [b" ".join([decimal[i] for i in flat[a:b]]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        end, names = decimal[m.eos], which.tolist()
        digest = [hashlib.sha256(b" ".join([*[word[w] for w in names[a:b]], end])).hexdigest() for a, b in zip(docs[:-1].tolist(), docs[1:].tolist(), strict=True)]
        n = n_ids[which]
        per_doc = sums(n, docs)
        decoded = m.decode(ids[spread(at[:-1][which], n)], offsets(per_doc))
        return {"key": keys[key], "n_tokens": (per_doc + 1).tolist(), "ids_sha256": digest, "decoded_sha256": [hashlib.sha256(d).hexdigest() for d in decoded]}

    return map_texts(df, [key], text, run, "key long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
