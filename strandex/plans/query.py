"""Query compilation on the driver: clauses, guard atoms, synonym variants, scope.

A query is a few words, so this is plain Python; what comes out are the small lists that
the DataFrame plans are built from.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from dataclasses import dataclass, field

from ..functions.text import STOPWORDS, fold, index_form, tokens_of

MAX_TOKENS, MAX_VARIANTS, MAX_CANDIDATES, MAX_RELAXED = 64, 16, 200, 1000
MIN_CANDIDATES, OVERSAMPLE, RELAXED_SHARE = 50, 5, 0.5
_STOP = frozenset(STOPWORDS)
_IDENTIFIER = re.compile(r"[A-Za-z][A-Za-z0-9]*-\d+")
_INDEX_WORD = re.compile(r"[^\W_]+")


def index_words(text: str) -> tuple[str, ...]:
    return tuple(_INDEX_WORD.findall(index_form(text)))


@dataclass(frozen=True)
class Compiled:
    """clauses: phrases of index words, all of which must match; tokens: the query's words, in order."""

    clauses: tuple[tuple[str, ...], ...]
    tokens: tuple[str, ...]

    @property
    def empty(self) -> bool:
        return not self.clauses


def compile_query(text: str) -> Compiled:
    """Words are clauses of their own, quoted parts phrases; an unclosed quote counts for nothing. At most MAX_TOKENS words."""
    parts = text.split('"')
    quotes = len(parts) - 1
    clauses: list[str] = []
    tokens: list[str] = []
    for n, part in enumerate(parts):
        found = tokens_of(part)[: MAX_TOKENS - len(tokens)]
        if found:
            closed = n % 2 == 1 and not (quotes % 2 == 1 and n == quotes)
            clauses += [" ".join(found)] if closed else found
            tokens += found
    words = tuple(w for w in (index_words(c) for c in clauses) if w)
    return Compiled(words, tuple(tokens))


def content_terms(tokens) -> list[str]:
    return list(dict.fromkeys(t for t in (x.casefold() for x in tokens) if t not in _STOP))


def required_terms(n: int) -> int:
    return n if n <= 2 else max(2, math.ceil(RELAXED_SHARE * n))


def guard_atoms(text: str) -> list[str]:
    """Quoted phrases, and identifiers outside them, by position in the normalised query."""
    norm = fold(text)
    quoted = [(m.start(), m.end(), a) for m in re.finditer(r'"([^"]*)"', norm) if (a := m.group(1).strip())]
    free = [(m.start(), m.group()) for m in _IDENTIFIER.finditer(norm) if not any(s <= m.start() < e for s, e, _ in quoted)]
    return [a for _, a in sorted([(s, a) for s, _, a in quoted] + free)]


@dataclass(frozen=True)
class Synonyms:
    """Groups of exchangeable forms; a form belongs to one group at most."""

    version: int | None = None
    groups: tuple[tuple[str, ...], ...] = ()

    @staticmethod
    def from_terms(version: int, terms: dict[str, list[str]]) -> Synonyms:
        if not isinstance(version, int) or version < 1:
            raise ValueError("synonym table: version must be 1 or more")
        if len(terms) > 128:
            raise ValueError("synonym table: more than 128 terms")
        seen: set[str] = set()
        groups = []
        for term, aliases in terms.items():
            if not 1 <= len(aliases) <= 4:
                raise ValueError(f"synonym table: {term}: 1 to 4 aliases")
            forms = [fold(f) for f in (term, *aliases)]
            for f in forms:
                if tokens_of(f) != [f] or _IDENTIFIER.fullmatch(f):
                    raise ValueError(f"synonym table: {f!r} is not one ordinary word")
                if f in seen:
                    raise ValueError(f"synonym table: {f!r} occurs twice")
                seen.add(f)
            groups.append(tuple(forms))
        return Synonyms(version, tuple(groups))

    @property
    def fingerprint(self) -> str:
        body = {"version": self.version, "groups": sorted(sorted(g) for g in self.groups)}
        return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def alternatives(self, word: str) -> list[str]:
        return sorted({f for g in self.groups if word in g for f in g} - {word})

    def metadata(self, enabled: bool = True) -> dict:
        return {"configured": self.version is not None, "version": self.version, "fingerprint": self.fingerprint if self.version else None, "groups": len(self.groups), "enabled": enabled}


def query_variants(text: str, table: Synonyms) -> list[str]:
    """The query with one unquoted ordinary word replaced by one alternative: at most MAX_VARIANTS."""
    norm = fold(text)
    quoted = [m.span() for m in re.finditer(r'"[^"]*"', norm)]
    out: list[str] = []
    for m in re.finditer(r"[A-Za-z][A-Za-z0-9]*-\d+|\w+", norm):
        if _IDENTIFIER.fullmatch(m.group()) or any(s <= m.start() < e for s, e in quoted):
            continue
        for other in table.alternatives(m.group()):
            v = fold(norm[: m.start()] + other + norm[m.end() :])
            if v != norm and v not in out and len(out) < MAX_VARIANTS:
                out.append(v)
    return out


@dataclass(frozen=True)
class Root:
    id: str
    project: str
    path: str = ""
    exclude: tuple[str, ...] = ()


@dataclass(frozen=True)
class Scope:
    """Root ids and paths of global notes that a query may see."""

    roots: tuple[str, ...] = ()
    globals: tuple[str, ...] = ()
    unknown_root: bool = field(default=False)

    @property
    def empty(self) -> bool:
        return self.unknown_root or not (self.roots or self.globals)


def resolve_scope(roots: list[Root], global_paths: list[str], project: str | None = None, root_id: str | None = None, all_projects: bool = False) -> Scope:
    """Without a project, root or all_projects only global notes are visible; a root implies its project."""
    if root_id is not None and root_id not in {r.id for r in roots}:
        return Scope(unknown_root=True)
    if project is None and root_id is not None and not all_projects:
        project = next(r.project for r in roots if r.id == root_id)
    seen = [r.id for r in roots if (all_projects or (project is not None and r.project == project)) and (root_id is None or r.id == root_id)]
    return Scope(tuple(seen), tuple(global_paths))


def candidate_bound(limit: int) -> int:
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    return min(MAX_CANDIDATES, max(OVERSAMPLE * limit, MIN_CANDIDATES))
