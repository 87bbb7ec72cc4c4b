"""Markdown notes: scanning roots, splitting notes into sections.

`scan` reads files with Spark's binary source; `split` turns each note into sections in
`mapInArrow`, since the heading and fence state runs through a note line by line.
"""

import fnmatch
import hashlib
import os
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import accumulate, pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions.text import cut_bytes
from ..plans.query import Root
from . import files
from .config import path_excluded

#: Stands for the ancestry of what comes before the first heading, in ids.
DOCUMENT = "(document)"
_HEADING = re.compile(r"(#{1,6})[ \t]+([^\n]+)")
_CLOSING = re.compile(r"[ \t]+#+[ \t]*$")
_FENCE = re.compile(r"[ \t]{0,3}(`{3,}|~{3,})([^\n]*)")
_NOTHING = {"", "null", "none", "~"}
_FIELDS = {"type": "note_type", "note_type": "note_type", "updated": "updated_date", "created": "created_date"}

SCHEMA = (
    "section_id string, path string, heading string, heading_path array<string>, line_start int, line_end int, "
    "root_id string, text string, content_hash string, note_type string, updated_date string, created_date string"
)
SECTION_SCHEMA = SCHEMA + ", links array<string>"
#: Characters of texts and links, and rows, of the sections that Python hands back at once; one section may have more.
_SLICE, _ROWS = 1_000_000, 1000
_ARROW = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}


def frontmatter(lines: list[str]) -> tuple[dict[str, str | None], int]:
    """Fields of the block that a first line `---` opens, and the lines it takes; none if it never ends.

    The last value of a field counts, empty ones and nulls not at all; `type` beats `note_type`.
    """
    out: dict[str, str | None] = dict.fromkeys(("note_type", "updated_date", "created_date"))
    if not lines or lines[0].strip() != "---":
        return out, 0
    end = next((n for n, x in enumerate(lines[1:], 1) if x.strip() in ("---", "...")), None)
    if end is None:
        return out, 0
    pairs = [(k.strip(), v.strip().strip("\"'")) for k, colon, v in (x.partition(":") for x in lines[1:end]) if colon]
    for name, value in sorted(pairs, key=lambda p: p[0] == "type"):
        if name in _FIELDS and value.lower() not in _NOTHING:
            out[_FIELDS[name]] = value
    return out, end + 1


def _cut_line(line: str, limit: int) -> list[str]:
    """Pieces of at most `limit` bytes, cut between characters; white space around the last one is dropped."""
    raw, cuts = line.encode(), [0]
    while cuts[-1] < len(raw):
        to = min(cuts[-1] + limit, len(raw))
        while to < len(raw) and raw[to] & 0xC0 == 0x80:
            to -= 1
        cuts.append(to)
    pieces = [raw[a:b].decode() for a, b in pairwise(cuts)]
    return [*pieces[:-1], pieces[-1].strip()]


def pack_lines(lines: list[str], limit: int) -> list[tuple[int, int, str]]:
    """(first line, line after the last, text) of chunks of at most `limit` bytes.

    lines have their ends, which count. A body that fits without the white space around it
    is one chunk. Otherwise as many lines as fit go together, and a longer line is cut.
    """
    limit = max(limit, 4)
    whole = "".join(lines).strip()
    if len(whole.encode()) <= limit:
        return [(0, len(lines), whole)] if whole else []
    before = [0, *accumulate(len(x.encode()) for x in lines)]
    out, at = [], 0
    while at < len(lines):
        stop = bisect_right(before, before[at] + limit) - 1
        if stop == at:
            stop = at + 1
            out += [(at, stop, piece) for piece in _cut_line(lines[at], limit)]
        elif text := "".join(lines[at:stop]).strip():
            out.append((at, stop, text))
        at = stop
    return out


def headings(lines: list[str], start: int) -> Iterator[tuple[int, int, str]]:
    """(line, level, title) of the headings outside fenced blocks.

    A fence ends at one of its own character, no shorter, with nothing behind it, or never.
    """
    fence = ""
    for n in range(start, len(lines)):
        line = lines[n].rstrip("\r\n")
        mark = _FENCE.match(line)
        if fence:
            if mark and mark[1].startswith(fence) and not mark[2].strip():
                fence = ""
        elif mark:
            fence = mark[1]
        elif m := _HEADING.match(line):
            yield n, len(m[1]), _CLOSING.sub("", m[2].strip()).rstrip()


def sections_of(lines: list[str], start: int) -> Iterator[tuple[str | None, list[str], int, int, int]]:
    """(heading, ancestry with it, first line, first line of the body, line after the last) of what precedes the first heading and of each section."""
    found = list(headings(lines, start))
    first = found[0][0] if found else len(lines)
    if first > start:
        yield None, [], start, start, first
    stack: list[tuple[int, str]] = []
    ends = [at for at, _, _ in found[1:]] + [len(lines)]
    for (at, level, title), end in zip(found, ends, strict=False):
        stack = [s for s in stack if s[0] < level] + [(level, title)]
        yield title, [t for _, t in stack], at, at + 1, end


#: Fixed value: Markdown links, and wiki links without their anchor and title.
_LINK = re.compile(r"!?(?:\[[^\]]*\]\(([^)\s]+)[^)]*\)|\[\[([^|\]#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\])")


def links_of(text: str) -> list[str]:
    """Targets of links, each once, in order."""
    return list(dict.fromkeys(m[1] or m[2] for m in _LINK.finditer(text)))


def split_note(path: str, content: bytes, section_bytes: int = 12000) -> list[dict]:
    """The sections of a note, chunked by size; ids depend on path, ancestry and its occurrence."""
    return list(_split_note(path, content, section_bytes))


def _split_note(path: str, content: bytes, section_bytes: int, with_links: bool = True) -> Iterator[dict]:
    note = content.decode("utf-8", "replace")
    lines = note.splitlines(keepends=True)
    meta, skip = frontmatter(lines)
    same = {"path": path, "content_hash": hashlib.sha256(content).hexdigest(), **meta, "links": links_of(note) if with_links else []}
    times: Counter[str] = Counter()
    for heading, ancestry, at, body, end in sections_of(lines, skip):
        identity = " > ".join(ancestry) or DOCUMENT
        times[identity] += 1
        identity += f"~{times[identity]}" if times[identity] > 1 else ""
        chunks = pack_lines(lines[body:end], section_bytes)
        if not chunks and heading is not None:
            chunks = [(0, end - body, "")]
        for k, (lo, hi, text) in enumerate(chunks):
            name = identity + (f"#chunk-{k + 1}" if len(chunks) > 1 else "")
            yield {
                "section_id": hashlib.sha256(f"{path}\0{name}".encode()).hexdigest(),
                "heading": heading,
                "heading_path": ancestry,
                "line_start": (body + lo if k else at) + 1,
                "line_end": body + hi,
                "text": text,
                **same,
            }


def _slices(rows: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        own = len(row["text"]) + sum(map(len, row["links"]))
        if held and (size + own > _SLICE or len(held) == _ROWS):
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
        held.append(row)
        size += own
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def split(notes: DataFrame, section_bytes: int = 12000, columns: list[str] | None = None) -> DataFrame:
    """notes: path, root_id, content (binary) -> sections with their links (those of the whole note), or the given columns of them.

    A worker holds the batch that it is sent, one note of it and one slice of sections.
    """
    kinds = dict(f.split(" ") for f in SECTION_SCHEMA.split(", "))
    names = columns or list(kinds)
    schema = pa.schema([(n, _ARROW[kinds[n]]) for n in names])

    def sections(batch: pa.RecordBatch) -> Iterator[dict]:
        for row in zip(*(batch.column(n) for n in ("path", "root_id", "content")), strict=True):
            path, root, content = (x.as_py() for x in row)
            for s in _split_note(path, content, section_bytes, "links" in names):
                yield s | {"root_id": root}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _slices(sections(batch), schema)

    return notes.select("path", "root_id", "content").mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names))


# --- scanning


def excluded(path: Column, root: Root, private: list[str]) -> Column:
    """A predicate on absolute paths: secrets files, private paths and globs, and the root's own globs, on every ancestor too."""
    base = root.path.rstrip("/")
    relative = F.when(path.startswith(base + "/"), F.substring(path, F.lit(len(base) + 2), F.length(path)))
    parts = F.split(relative, "/")
    # every prefix of the relative path: a rule that excludes a folder excludes what is in it
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))

    def one(p: Column) -> Column:
        name = F.element_at(F.split(p, "/"), -1)
        whole = F.concat(F.lit(base + "/"), p)
        tests = [name.startswith(".env")]
        for g in private:
            rule = _glob(g)
            tests += [whole == g.rstrip("/"), whole.rlike(rule), p.rlike(rule), name.rlike(rule)]
        for g in root.exclude:
            tests += [p.rlike(_glob(g)), name.rlike(_glob(g))]
        return reduce(lambda a, b: a | b, tests)

    return relative.isNull() | F.coalesce(F.exists(prefixes, one), F.lit(True))


def _glob(pattern: str) -> str:
    """fnmatch as a Java regular expression: * also crosses slashes."""
    return "(?s)^" + fnmatch.translate(pattern).removeprefix("(?s:").rsplit(")", 1)[0] + "$"


@F.pandas_udf(BooleanType())
def _inside(path: pd.Series, root: pd.Series) -> pd.Series:
    """Does a local path end below the root once links are followed? Paths of other stores have no links."""
    top = {r: os.path.realpath(r) for r in root.unique()}
    return pd.Series([not os.path.isabs(p) or os.path.realpath(p).startswith(top[r] + os.sep) for p, r in zip(path, root, strict=True)])


def scan(spark: SparkSession, roots: list[Root], private: list[str] | None = None) -> DataFrame:
    """path, root_id, content, content_hash of the Markdown files below the roots; the last root wins for a path."""
    parts = []
    for n, root in enumerate(roots):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root.path)
        path = F.regexp_replace("path", "^file:/*", "/")
        rows = found.select(path.alias("path"), "content").filter(F.lower("path").rlike(r"\.(md|markdown)$") & ~excluded(F.col("path"), root, private or []))
        rows = rows.filter(_inside("path", F.lit(root.path)))
        parts.append(rows.select("path", F.lit(root.id).alias("root_id"), "content", F.lit(n).alias("turn")))
    rows = reduce(DataFrame.unionByName, parts)
    last = rows.groupBy("path").agg(F.max("turn").alias("turn"))
    return rows.join(last, ["path", "turn"], "left_semi").select("path", "root_id", "content", F.sha2("content", 256).alias("content_hash"))


def hashes_now(spark: SparkSession, config, paths: set[str]) -> dict[str, str]:
    """Content hashes of a query's hits, as their files are now; a file that is gone, or excluded by now, has none."""
    allowed = {p for p in paths if not os.path.isabs(p) or safe_source(config, p) is not None}
    there = files.existing(spark, allowed)
    if not there:
        return {}
    rows = spark.read.format("binaryFile").load([re.sub(r"([\\{}\[\]*?,])", r"\\\1", p) for p in there]).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.sha2("content", 256).alias("hash"))
    return {r["path"]: r["hash"] for r in rows.collect()}


def read_source(spark: SparkSession, config, path: str, heading: str | None = None, limit: int = 20000) -> str:
    """A note as it is now, or its sections under a heading; the path may be relative to a root or to the working folder."""
    if limit < 1:
        raise ValueError("the limit must be positive")
    found = safe_source(config, path)
    if found is None:
        raise ValueError(f"{path} is outside all roots, excluded, or does not exist")
    got = spark.read.format("binaryFile").load(found[1]).select("content").first()  # one note
    text = bytes(got["content"]).decode("utf-8")
    if heading is not None:
        parts = [s["text"] for s in split_note(found[1], text.encode(), max(limit, 256)) if s["heading"] == heading or " > ".join(s["heading_path"]) == heading]
        if not parts:
            raise ValueError(f"no heading {heading} in {path}")
        text = "\n\n".join(parts)
    return cut_bytes(text, limit)


def safe_source(config, path: str) -> tuple[Root, str] | None:
    """The root of a path, and the path without links; None if it is in no root, excluded or not there."""
    tries = [path] if os.path.isabs(path) else [os.path.abspath(path), *[os.path.join(r.path, path) for r in config.roots]]
    for t in tries:
        real = os.path.realpath(t)
        for root in config.roots:
            top = os.path.realpath(root.path)
            if os.path.isfile(real) and os.path.commonpath([real, top]) == top:
                own = os.path.join(root.path, os.path.relpath(real, top))
                if not path_excluded(own, root, list(config.private)):
                    return root, own
    return None
