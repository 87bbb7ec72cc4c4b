"""Token counts at every prefix, by dynamic programming.

For each distinct pretoken the table has, at every byte prefix, the last token of
the prefix's encoding and the token count: the last token t of a prefix of length i
is the one vocabulary entry ending at i that may follow the last token of the
prefix of length i - len(t), and count[i] = count[i - len(t)] + 1. Whether t may
follow u (encoding their bytes gives just u, t) is memoised. The DP runs over all
distinct pretokens of a slice at once, position by position. A text's count at any
prefix is then a sum of table entries: budgets and truncations need no encoding.

Counts are those of the library's encoding of the prefix. Where a cut changes the
split (inside a contraction, after the last of several white-space characters) the
entry is that of the changed split. A special token's string is one unit: no
prefix ends inside it.

Null text counts as empty: 0 tokens. Repeated rows and null keys stay as they are.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from . import bytebpe
from .bpe import HashTable, pair_key
from .flat import U8, map_texts, mix, offsets, spread

_P = U8(0x5851F42D4C957F2D)
_WIDE = 32  # bytes; longer pretokens take the loop over one pretoken
_MEMO_BITS = 21


class PrefixCounts:
    def __init__(self, path: str):
        self.bpe = bytebpe.ByteBPE(path)
        ids = np.array(sorted(self.bpe.bytes_of), np.int64)
        toks = [self.bpe.bytes_of[i] for i in ids.tolist()]
        size = np.fromiter(map(len, toks), np.int64, len(toks))
        flat = np.frombuffer(b"".join(toks), np.uint8)
        got, n = self.bpe.merges.encode(self.bpe.of_byte[flat], size)
        own = (n == 1) & (got[offsets(n)[:-1]] == ids)
        self.longest = int(size[own].max())
        at = offsets(size)
        self.token_bytes, self.token_at, self.token_size = flat, np.zeros(ids.max() + 1, np.int64), np.zeros(ids.max() + 1, np.int64)
        self.token_at[ids], self.token_size[ids] = at[:-1], size
        h = np.zeros(len(ids), U8)
        with np.errstate(over="ignore"):
            for k in range(int(size.max())):  # from the last byte to the first
                live = size > k
                h[live] += (flat[at[1:][live] - 1 - k].astype(U8) + U8(1)) * self._power(k)
        self.vocab = HashTable(mix(h[own] + size[own].astype(U8)), ids[own])
        self._forget()

    @staticmethod
    def _power(k: int) -> np.uint64:
        return U8(pow(int(_P), k, 1 << 64))

    def _forget(self) -> None:
        self.memo = HashTable(np.zeros(0, U8), np.zeros(0, np.int32), _MEMO_BITS)

    def may_follow(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        key = pair_key(u, t)
        known = self.memo.get(key)
        if len(new := np.flatnonzero(known < 0)):
            fresh, back = np.unique(key[new], return_inverse=True)
            a, b = (fresh >> U8(32)).astype(np.int64), (fresh & U8(0xFFFFFFFF)).astype(np.int64)
            both = np.stack([a, b], 1).ravel()
            n = self.token_size[both]
            flat = self.token_bytes[spread(self.token_at[both], n)]
            got, count = self.bpe.merges.encode(self.bpe.of_byte[flat], n[::2] + n[1::2])
            first = offsets(count)[:-1]
            ok = (count == 2) & (got[first] == a) & (got[np.minimum(first + 1, len(got) - 1)] == b)
            known[new] = ok[back]
            if self.memo.used + len(fresh) > (1 << _MEMO_BITS) // 2:
                self._forget()
            if len(fresh) < (1 << _MEMO_BITS) // 2:
                self.memo.add(fresh, ok.astype(np.int32))
        return known > 0

    def table(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts at the prefixes 0..size of every word, flat, and where each word's begin."""
        at = offsets(size + 1)
        out = np.zeros(at[-1], np.int32)
        begin = offsets(size)
        low = 0
        for high in (6, 10, 16, _WIDE):
            words = np.flatnonzero((size > low) & (size <= high))
            low = high
            if len(words):
                words = words[np.argsort(-size[words], kind="stable")]
                n = size[words]
                grid = np.zeros((high, len(words)), np.uint8)
                place = spread(np.zeros(len(words), np.int64), n)
                grid[place, np.repeat(np.arange(len(words)), n)] = raw[spread(begin[words], n)]
                counts = self._grid(grid, n)
                out[spread(at[words], n + 1)] = counts[spread(np.zeros(len(words), np.int64), n + 1), np.repeat(np.arange(len(words)), n + 1)]
        for w in np.flatnonzero(size > _WIDE).tolist():
            out[at[w] : at[w + 1]] = self._single(raw[begin[w] : begin[w + 1]].tobytes())
        return out, at

    def _grid(self, grid: np.ndarray, n: np.ndarray) -> np.ndarray:
        """grid: bytes by position and word; n: lengths, falling."""
        high, words = grid.shape
        last = np.zeros((high + 1, words), np.int32)
        count = np.zeros((high + 1, words), np.int32)
        for i in range(1, high + 1):
            open_ = np.arange(np.searchsorted(-n, -i, side="right"))
            h = np.zeros(len(open_), U8)
            for k in range(1, min(i, self.longest) + 1):
                h = h + (grid[i - k, open_].astype(U8) + U8(1)) * self._power(k - 1)
                token = self.vocab.get(mix(h + U8(k)))
                ok = token >= 0
                if k < i and len(some := np.flatnonzero(ok)):
                    ok[some] = self.may_follow(last[i - k, open_[some]], token[some])
                if ok.any():
                    w = open_[ok]
                    last[i, w], count[i, w] = token[ok], count[i - k, w] + 1
                    open_, h = open_[~ok], h[~ok]
                    if not len(open_):
                        break
            if len(open_):
                raise RuntimeError("a prefix has no last token")
        return count

    def _single(self, word: bytes) -> np.ndarray:
        by_bytes = self._by_bytes()
        last, count = [0] * (len(word) + 1), np.zeros(len(word) + 1, np.int32)
        for i in range(1, len(word) + 1):
            for k in range(1, min(i, self.longest) + 1):
                t = by_bytes.get(word[i - k : i])
                if t is not None and (k == i or self._follows(last[i - k], t)):
                    last[i], count[i] = t, count[i - k] + 1
                    break
        return count

    @lru_cache(maxsize=1)  # noqa: B019  one model a worker
    def _by_bytes(self) -> dict[bytes, int]:
        ids = self.vocab.values[self.vocab.values >= 0].tolist()
        return {self.bpe.bytes_of[i]: i for i in ids}

    @lru_cache(maxsize=1 << 16)  # noqa: B019
    def _follows(self, u: int, t: int) -> bool:
        return bool(self.may_follow(np.array([u]), np.array([t]))[0])

    def slice(self, texts: list[str]) -> Slice:
        return Slice(self, texts)


class Slice:
    """The prefix tables of some texts; `counts` are exact at every prefix."""

    def __init__(self, owner: PrefixCounts, texts: list[str]):
        self.owner = owner
        raw, size, special, (self.starts, self.lengths), self.which, self.docs, self.cps = owner.bpe.distinct(texts)
        self.table, self.at = owner.table(raw, size)
        self.words = self.table[self.at[1:] - 1].astype(np.int64)
        self.words[special >= 0] = 1
        self.special = special
        self.base = offsets(self.words[self.which])
        self.kind = bytebpe._classes()

    def totals(self) -> np.ndarray:
        return np.diff(self.base[self.docs])

    def _size(self, word: int) -> np.ndarray:
        """UTF-8 bytes of the word's prefixes, by code points."""
        c = self.cps[self.starts[word] : self.starts[word] + self.lengths[word]]
        return offsets(1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF))

    def _joined(self, word: int) -> int:
        """Tokens of white space piece word - 1 together with the first character of the next."""
        a = self.starts[word - 1]
        text = self.cps[a : self.starts[word] + 1].astype("<u4").tobytes().decode("utf-32-le").encode()
        _, n = self.owner.bpe.merges.encode(self.owner.bpe.of_byte[np.frombuffer(text, np.uint8)], np.array([len(text)]))
        return int(n[0])

    def inside(self, doc: int, word: int) -> np.ndarray:
        """Counts, from the text's start, at the code point prefixes 1..length of the word."""
        before = self.base[word] - self.base[self.docs[doc]]
        w = self.which[word]
        if self.special[w] >= 0:
            return np.array([before + 1])
        out = before + self.table[self.at[w] + self._size(word)[1:]].astype(np.int64)
        c = self.cps[self.starts[word]]
        if word > self.docs[doc] and self.kind[c] == bytebpe.SPACE and self.kind[self.cps[self.starts[word] - 1]] == bytebpe.SPACE:
            out[0] = self.base[word - 1] - self.base[self.docs[doc]] + self._joined(word)
        if len(out) == 3 and c == 39 and self.kind[self.cps[self.starts[word] + 1]] == bytebpe.LETTER:
            out[1] = before + 2
        return out

    def prefixes(self, doc: int) -> np.ndarray:
        """Counts at the code point prefixes 0, 1, ... of the text; a special token's string is one step."""
        lo, hi = self.docs[doc], self.docs[doc + 1]
        return np.concatenate([[0], *[self.inside(doc, w) for w in range(lo, hi)]]).astype(np.int64)

    def fit(self, doc: int, budget: int) -> int:
        """Code points of the longest prefix of at most `budget` tokens."""
        lo, hi = int(self.docs[doc]), int(self.docs[doc + 1])
        base = self.base[lo : hi + 1] - self.base[lo]
        w = min(hi - 1, lo + int(np.searchsorted(base, budget, side="right")))
        lengths = self.chars(lo, hi)
        while w >= lo:
            ok = np.flatnonzero(self.inside(doc, w) <= budget)
            if len(ok):
                return int(lengths[: w - lo].sum()) + (int(ok[-1]) + 1 if self.special[self.which[w]] < 0 else int(lengths[w - lo]))
            w -= 1
        return 0

    def chars(self, lo: int, hi: int) -> np.ndarray:
        n, s = self.lengths[lo:hi].copy(), self.special[self.which[lo:hi]]
        if (s >= 0).any():
            n[s >= 0] = [len(self.owner.bpe.specials[x][0]) for x in s[s >= 0].tolist()]
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounts:
    return PrefixCounts(path)


def prefix_counts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, prefix_tokens array<int>: tokens of the prefixes of 0, 1, 2, ... characters."""

    def run(keys, texts):
        s = counter(path).slice([t or "" for t in texts])
        return {"key": keys[key], "prefix_tokens": [s.prefixes(d).tolist() for d in range(len(texts))]}

    return map_texts(df, [key], text, run, "key long, prefix_tokens array<int>").withColumnRenamed("key", key)


def token_budget(df: DataFrame, path: str, budget: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit (n_tokens > budget), fit_chars (characters of the longest prefix within the budget)."""

    def run(keys, texts):
        full = [t or "" for t in texts]
        s = counter(path).slice(full)
        n = s.totals()
        return {
            "key": keys[key],
            "n_bytes": [len(t.encode()) for t in full],
            "n_tokens": n.tolist(),
            "over_limit": (n > budget).tolist(),
            "fit_chars": [s.fit(d, budget) if many else len(t) for d, (t, many) in enumerate(zip(full, (n > budget).tolist(), strict=True))],
        }

    return map_texts(df, [key], text, run, "key long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long").withColumnRenamed("key", key)
