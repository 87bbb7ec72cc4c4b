"""Configuration, synonym tables, golden cases and thresholds: small files, read on the driver."""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
import tempfile
import tomllib
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from ..plans.query import Root, Synonyms


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Config:
    roots: tuple[Root, ...]
    store: str
    private: tuple[str, ...] = ()
    global_notes: tuple[str, ...] = ()
    section_bytes: int = 12000
    synonyms: Synonyms = Synonyms()
    bundle: str | None = None

    @property
    def fingerprint(self) -> str:
        return fingerprint({"roots": [asdict(r) for r in self.roots], "private": self.private, "global_notes": self.global_notes, "section_bytes": self.section_bytes, "synonyms": self.synonyms.fingerprint})


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fingerprint(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def write_json(path: str, value) -> None:
    """Whole or not at all."""
    fd, name = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(canonical_json(value) + "\n")
    os.replace(name, path)


def _one_of(table: dict, *names: str, default=None):
    found = [n for n in names if n in table]
    if len(found) > 1:
        raise ConfigError(f"{' and '.join(found)} name the same setting")
    return table[found[0]] if found else default


def _inside(path: str, folder: str) -> bool:
    return os.path.commonpath([os.path.abspath(path), os.path.abspath(folder)]) == os.path.abspath(folder)


def read_config(path: str) -> Config:
    with open(path, "rb") as f:
        raw = tomllib.load(f)
    base = os.path.dirname(os.path.abspath(path))
    where = lambda p: os.path.normpath(os.path.join(base, os.path.expanduser(p)))
    roots = []
    for r in raw.get("roots", []):
        name, project = r.get("id"), _one_of(r, "project", "project_scope")
        if not name or not project or not r.get("path"):
            raise ConfigError("a root needs id, path and project")
        roots.append(Root(name, project, where(r["path"]), tuple(_one_of(r, "exclude", "exclude_globs", "excludes", default=[]))))
    if not roots:
        raise ConfigError("no roots")
    if len({r.id for r in roots}) != len(roots):
        raise ConfigError("two roots have one id")
    for a in roots:
        for b in roots:
            if a is not b and _inside(a.path, b.path):
                raise ConfigError(f"roots {b.id} and {a.id} overlap")
    notes = tuple(where(p) for p in raw.get("global_notes", []))
    for n in notes:
        if not any(_inside(n, r.path) for r in roots):
            raise ConfigError(f"global note {n} is outside all roots")
    size = raw.get("section_bytes", 12000)
    if isinstance(size, bool) or not isinstance(size, int) or size <= 0:
        raise ConfigError("section_bytes must be a positive whole number")
    store = raw.get("database") or raw.get("index", {}).get("database")
    if not store:
        raise ConfigError("no database")
    table = read_synonyms(where(raw["synonym_table"])) if raw.get("synonym_table") else Synonyms()
    bundle = _one_of(raw | {"semantic.bundle_dir": raw["semantic"]["bundle_dir"]} if "bundle_dir" in raw.get("semantic", {}) else raw, "semantic.bundle_dir", "semantic_bundle", "model_bundle")
    if bundle not in (None, "hash"):  # `hash` names the encoder that needs no bundle
        bundle = where(bundle)
    config = Config(tuple(roots), where(store), tuple(_one_of(raw, "private_paths", "private", default=[])), notes, size, table, bundle)
    for n in notes:
        if any(path_excluded(n, r, list(config.private)) for r in roots if _inside(n, r.path)):
            raise ConfigError(f"global note {n} is excluded")
    return config


def path_excluded(path: str, root: Root, private: list[str]) -> bool:
    """The rule of the scan for one path, on the driver: secrets files, private paths and globs, and the root's globs, on every ancestor too."""
    if not _inside(path, root.path):
        return True
    parts = os.path.relpath(path, root.path).split(os.sep)
    for n in range(1, len(parts) + 1):
        relative, name = "/".join(parts[:n]), parts[n - 1]
        whole = os.path.join(root.path, relative)
        if name.startswith(".env") or any(whole == g.rstrip("/") or any(fnmatch.fnmatchcase(x, g) for x in (whole, relative, name)) for g in private):
            return True
        if any(fnmatch.fnmatchcase(x, g) for g in root.exclude for x in (relative, name)):
            return True
    return False


def read_synonyms(path: str) -> Synonyms:
    with open(path, "rb") as f:
        raw = tomllib.load(f)
    return Synonyms.from_terms(raw.get("version"), raw.get("terms", {}))


def read_thresholds(path: str) -> dict:
    """Sections of a TOML file with numbers: global, by category, and for the fused mode."""
    with open(path, "rb") as f:
        raw = tomllib.load(f)

    def check(table: dict, at: str) -> None:
        for k, v in table.items():
            if isinstance(v, dict):
                check(v, f"{at}.{k}")
            elif isinstance(v, bool) or not isinstance(v, (int, float, str)):
                raise ConfigError(f"{at}.{k} is not a number")

    check(raw, "thresholds")
    return raw


CASES = "status string, case_id string, category string, query string, expected array<string>, forbidden array<string>, abstain boolean, project string, root string, all_projects boolean, deleted array<string>"


def read_cases(spark: SparkSession, path: str, least: int = 40) -> DataFrame:
    """The golden cases of a JSON file as rows; wrong types, double ids and small sets are errors."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    status, rows, seen = raw.get("status"), [], set()
    if status not in ("DRAFT", "REVIEWED"):
        raise ConfigError("status must be DRAFT or REVIEWED")
    for c in raw.get("cases", []):
        scope = c.get("scope", {})
        lists = [c.get("expected_source_paths", []), c.get("forbidden_paths", []), c.get("delete_sources", [])]
        if not isinstance(c.get("id"), str) or c["id"] in seen or not isinstance(c.get("query"), str) or not isinstance(c.get("abstain", False), bool) or not all(isinstance(x, list) and all(isinstance(p, str) for p in x) for x in lists):
            raise ConfigError(f"case {c.get('id')!r} is not valid")
        seen.add(c["id"])
        rows.append((status, c["id"], c.get("category"), c["query"], *lists[:2], c.get("abstain", False), scope.get("project"), scope.get("root"), bool(scope.get("all_projects", False)), lists[2]))
    if len(rows) < least:
        raise ConfigError(f"{len(rows)} cases; at least {least} are needed")
    return spark.createDataFrame(rows, CASES)
