"""WordPiece: normalise, split, greedy longest match, truncate, frame with special tokens."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

#: White space to `str.split` that is a control character, which is removed first.
_REMOVED_WHITE = "\x0b\x0c\x1c\x1d\x1e\x1f\x85"
#: Runs between white space whose ids are kept, and the characters that such a run has at most.
_KEPT, _KEPT_LENGTH = 100_000, 40


def _control(c: str) -> bool:
    return c not in "\t\n\r" and unicodedata.category(c) in ("Cc", "Cf")


def _ideograph(c: str) -> bool:
    n = ord(c)
    return any(a <= n <= b for a, b in ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F)))


def _punctuation(c: str) -> bool:
    n = ord(c)
    return 33 <= n <= 47 or 58 <= n <= 64 or 91 <= n <= 96 or 123 <= n <= 126 or unicodedata.category(c)[0] == "P"


class _Lazy(dict):
    """A table for `str.translate`, filled by a function as characters are met."""

    def __init__(self, of: Callable[[str], str | None]):
        self.of = of

    def __missing__(self, n: int) -> str | None:
        self[n] = out = self.of(chr(n))
        return out


_CLEAN = _Lazy(lambda c: None if c in "\0�" or _control(c) else f" {c} " if _ideograph(c) else c)
_UNMARKED = _Lazy(lambda c: None if unicodedata.category(c) == "Mn" else c)
_APART = _Lazy(lambda c: f" {c} " if _punctuation(c) else c)


class WordPiece:
    """vocabulary: token -> id, with [UNK], [CLS], [SEP]; length: ids at most, framing included."""

    def __init__(self, vocabulary: dict[str, int], length: int = 512, lower: bool = True, longest: int = 100, keep: str = "left", prefix: str = "##"):
        self.vocabulary, self.length, self.lower, self.longest, self.keep, self.prefix = vocabulary, length, lower, longest, keep, prefix
        self.special = {t: i for t, i in vocabulary.items() if t.startswith("[") and t.endswith("]")}
        later = {t.removeprefix(prefix): i for t, i in vocabulary.items() if t.startswith(prefix)}
        self._first, self._later = ((t, sorted({len(x) for x in t} - {0}, reverse=True)) for t in (vocabulary, later))
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self._known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.__dict__ | {"_known": {}}

    def normalise(self, text: str) -> str:
        if text.isascii() and text.isprintable():
            return text.lower() if self.lower else text
        out = text.translate(_CLEAN)
        return unicodedata.normalize("NFD", out).translate(_UNMARKED).lower() if self.lower else out

    def words(self, text: str) -> list[str]:
        return [text] if text.isalnum() else text.translate(_APART).split()

    def pieces(self, word: str) -> list[int]:
        unknown = [self.vocabulary["[UNK]"]]
        if len(word) > self.longest:
            return unknown
        out, at, (table, lengths) = [], 0, self._first
        while at < len(word):
            for n in lengths:  # at a word's end a slice is shorter, and then the longest there is
                if (i := table.get(word[at : at + n])) is not None:
                    break
            else:
                return unknown
            out.append(i)
            at += n
            table, lengths = self._later
            if lengths == [1]:  # only single characters may follow
                out += map(table.get, word[at:])
                return unknown if None in out else out
        return out

    def _plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens. No step looks beyond a run between white space, so the ids of short runs are kept, in a table of bounded size."""
        for c in _REMOVED_WHITE:
            text = text.replace(c, "")
        known, out = self._known, []
        for run in text.split():
            if (ids := known.get(run)) is None:
                ids = tuple([i for w in self.words(self.normalise(run)) for i in self.pieces(w)])
                if len(run) <= _KEPT_LENGTH:
                    if len(known) >= _KEPT:
                        known.clear()
                    known[run] = ids
            out += ids
        return out

    def body(self, text: str) -> list[int]:
        """Special tokens in the text are ids of their own: the earliest first, the longest of those."""
        out: list[int] = []
        at = 0
        for found in self._special.finditer(text):
            out += self._plain(text[at : found.start()])
            out.append(self.special[found[0]])
            at = found.end()
        return out + self._plain(text[at:])

    def encode(self, text: str) -> list[int]:
        room = self.length - 2
        ids = self.body(text)
        ids = ids[:room] if self.keep == "left" else ids[-room:]
        return [self.vocabulary["[CLS]"], *ids, self.vocabulary["[SEP]"]]
