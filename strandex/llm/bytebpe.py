"""Byte-level BPE of a tokenizers file, by flat arrays.

The split into pretokens follows the pattern
`'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`
by comparing the classes of neighbouring code points. A special token's string in
a text is that token, as the tokenizers library has it by default.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np

from .bpe import HashTable, Merges
from .flat import codepoints, offsets, span_hash, spread, sums

SPACE, LETTER, NUMBER, OTHER, SPECIAL = range(5)
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_AT = 0x110000  # stands for the first special token, _AT + 1 for the second, ...
#: Pretokens that stay known, and the slots of their table.
_KNOWN, _KNOWN_BITS = 700_000, 22
_ORD = {c: ord(c) for c in "'stdmrevl"}


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.full(_AT + 64, SPECIAL, np.uint8)
    out[:_AT] = [kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(_AT)]
    out[_WHITE] = SPACE
    return out


def _byte_letters() -> dict[str, int]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], _byte_letters()
        pre = spec["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or spec["normalizer"] or model["ignore_merges"]:
            raise ValueError("not a plain byte-level BPE file")
        vocab = model["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        self.of_byte = np.zeros(256, np.int32)
        for i, b in self.bytes_of.items():
            if len(b) == 1:
                self.of_byte[b[0]] = i
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        self.merges = Merges([vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs], range(len(pairs)), [vocab[a + b] for a, b in pairs])
        self.seen: HashTable | None = None
        self.specials = [(t["content"], t["id"]) for t in spec["added_tokens"]]
        self.largest_id = max([*vocab.values(), *(n for _, n in self.specials)])

    def pretokens(self, texts: list[str]):
        """(code points, piece starts, piece lengths, pieces by document)."""
        subs = [(s, chr(0x10FFFF), n) for n, (s, _) in enumerate(self.specials) if any(s in t for t in texts)]
        if subs:
            parts = [self._with_specials(t, subs) for t in texts]
            cps, size = np.concatenate([*parts, np.zeros(0, np.uint32)]), np.array([len(p) for p in parts], np.int64)
        else:
            cps, size = codepoints("".join(texts)), np.fromiter(map(len, texts), np.int64, len(texts))
        off, n = offsets(size), len(cps)
        if not n:
            return cps, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
        kind = _classes()[cps]
        begin = np.zeros(n + 1, bool)
        begin[off] = True
        run = np.ones(n, bool)
        run[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == SPECIAL)
        run |= begin[:-1]
        first = np.append(run, True)
        after = np.flatnonzero(run & (kind != SPACE) & (kind != SPECIAL) & ~begin[:-1])
        after = after[kind[after - 1] == SPACE]
        first[after - 1] = True
        first[after[cps[after - 1] == 32]] = False
        self._contractions(cps, kind, run, first, begin)
        starts = np.flatnonzero(first[:-1])
        return cps, starts, np.diff(np.append(starts, n)), np.searchsorted(starts, off)

    @staticmethod
    def _contractions(cps, kind, run, first, begin):
        c = _ORD
        q = np.flatnonzero((cps[:-1] == c["'"]) & run[:-1] & first[:-2] & (kind[1:] == LETTER) & ~begin[1:-1])
        if not len(q):
            return
        one = cps[q + 1]
        there = (q + 2 < len(cps)) & ~begin[np.minimum(q + 2, len(cps))]
        two = np.where(there, cps[np.minimum(q + 2, len(cps) - 1)], 0)
        short = np.isin(one, [c["s"], c["t"], c["d"], c["m"]])
        long = (np.isin(one, [c["r"], c["v"]]) & (two == c["e"])) | ((one == c["l"]) & (two == c["l"]))
        hit = short | long
        first[q[hit] + 1] = False
        first[q[hit] + 2 + long[hit]] = True

    @staticmethod
    def _with_specials(text: str, subs) -> np.ndarray:
        parts, at = [], 0
        while True:
            found = min(((i, -len(s), n) for s, _, n in subs if (i := text.find(s, at)) >= 0), default=None)
            parts.append(codepoints(text[at : found[0]] if found else text[at:]))
            if not found:
                return np.concatenate(parts)
            parts.append(np.array([_AT + found[2]], np.uint32))
            at = found[0] - found[1]

    def distinct(self, texts: list[str]):
        """Distinct pretokens of texts, as (bytes, byte counts, special ids or -1, representative (starts, lengths), which, by document, code points)."""
        cps, starts, counts, docs = self.pretokens(texts)
        _, one, which = np.unique(span_hash(cps, starts, counts), return_index=True, return_inverse=True)
        raw, size, special = self._raw(cps, starts[one], counts[one])
        return raw, size, special, (starts, counts), which, docs, cps

    @staticmethod
    def _raw(cps, first, n):
        """UTF-8 of pretokens, bytes of each, and their special token or -1."""
        flat = cps[spread(first, n)]
        special = np.where(cps[first] >= _AT, cps[first].astype(np.int64) - _AT, -1) if len(first) else np.zeros(0, np.int64)
        flat = np.where(flat >= _AT, np.uint32(63), flat)
        width = 1 + (flat > 0x7F).astype(np.int64) + (flat > 0x7FF) + (flat > 0xFFFF)
        raw = np.frombuffer(flat.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        return raw, sums(width, offsets(n)), special

    def known(self, texts: list[str]):
        """(token counts by known pretoken, pretoken of each occurrence, occurrences by document); ids of pretoken w begin at self.at[w] of self.ids.

        Pretokens stay known from slice to slice, up to a bound.
        """
        cps, starts, counts, docs = self.pretokens(texts)
        h = span_hash(cps, starts, counts)
        if self.seen is None or self.seen.used > _KNOWN or len(h) > (1 << _KNOWN_BITS) // 2 - _KNOWN:
            bits = max(_KNOWN_BITS, int(2 * len(h)).bit_length())
            self.seen = HashTable(np.zeros(0, np.uint64), np.zeros(0, np.int32), bits)
            self.ids, self.n = np.zeros(0, np.int32), np.zeros(0, np.int64)
        which = self.seen.get(h)
        new = np.flatnonzero(which < 0)
        if len(new):
            u, one, back = np.unique(h[new], return_index=True, return_inverse=True)
            raw, size, special = self._raw(cps, starts[new[one]], counts[new[one]])
            ids, n = self.merges.encode(self.of_byte[raw], size)
            at = offsets(n)
            for w in np.flatnonzero(special >= 0).tolist():
                ids[at[w]] = self.specials[special[w]][1]
            first = len(self.n)
            self.seen.add(u, np.arange(first, first + len(u)))
            self.ids, self.n = np.concatenate([self.ids, ids]), np.concatenate([self.n, n])
            which[new] = first + back
        self.at = offsets(self.n)
        return self.n, which, docs

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and the offsets of the texts in them."""
        n, which, docs = self.known(texts)
        per = n[which]
        return self.ids[spread(self.at[which], per)], offsets(sums(per, docs))

    def count(self, texts: list[str]) -> np.ndarray:
        n, which, docs = self.known(texts)
        return sums(n[which], docs)


@lru_cache(maxsize=2)
def model(path: str) -> ByteBPE:
    return ByteBPE(path)
