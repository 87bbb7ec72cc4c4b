"""Markdown splitting and scanning, configuration, the generation store, search, the engine and the command line."""

import hashlib
import json
import os
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from strandex import cli
from strandex.functions.encoder import HashEncoder, LazyEncoder, backend_reason
from strandex.functions.text import links
from strandex.operators.search import Policies, search, semantic_with
from strandex.plans.query import Root
from strandex.plans.service import Engine, policy_diagnostics
from strandex.sources import config as conf
from strandex.sources import files, markdown, store
from strandex.streaming import ingest


def sections(text, size=12000):
    return markdown.split_note("n.md", text.encode(), size)


def test_headings_and_frontmatter():
    got = sections("---\ntype: decision\nupdated: '2026-01-02'\ncreated: null\n---\n# Parent\nbody\n## Child\n")
    assert [s["heading_path"] for s in got] == [["Parent"], ["Parent", "Child"]]
    assert (got[0]["line_start"], got[0]["note_type"], got[0]["updated_date"], got[0]["created_date"], got[1]["text"]) == (6, "decision", "2026-01-02", None, "")
    assert sections("---\ntype: x\n# never closed")[0]["note_type"] is None
    assert [s["heading"] for s in sections("intro\n# A")] == [None, "A"]
    got = sections("---\nnote_type: x\ntype: null\nupdated: 2026\nupdated: none\ncreated: 'a'\ncreated: b\n...\ntext")[0]
    assert (got["note_type"], got["updated_date"], got["created_date"], got["line_start"]) == ("x", "2026", "b", 9)
    assert sections("---\ntype: a\nnote_type: b\n---\nx")[0]["note_type"] == "a"


def test_fences_hide_headings():
    got = sections("# Real\n```\n# no\n~~~\n# no\n```\n~~~ py\n# no\n```\n~~~\n# C#\n# Trailing ###\n")
    assert [s["heading"] for s in got] == ["Real", "C#", "Trailing"]
    assert [s["heading"] for s in sections("# Real\n````\n# no\n```\n# no\n```` x\n# no\n````\n# After")] == ["Real", "After"]
    assert [s["heading"] for s in sections("# Real\n```\n# hidden")] == ["Real"]


def by_the_rules(path, note, limit):
    """P2-P5 of the survey, line by line and character by character: (id, heading, ancestry, first line, last line, text)."""
    limit, lines, skip = max(limit, 4), note.splitlines(True), 0
    if lines and lines[0].strip() == "---":
        ends = [k for k in range(1, len(lines)) if lines[k].strip() in ("---", "...")]
        skip = ends[0] + 1 if ends else 0
    marks, inside = [], None
    for k in range(skip, len(lines)):
        line = lines[k].rstrip("\r\n")
        indent = len(line) - len(line.lstrip(" \t"))
        rest = line[indent:]
        run = len(rest) - len(rest.lstrip(rest[:1])) if rest[:1] in ("`", "~") and rest else 0
        fence = (rest[0], run, rest[run:]) if run >= 3 and indent <= 3 else None
        if inside:
            if fence and fence[0] == inside[0] and fence[1] >= inside[1] and not fence[2].strip():
                inside = None
        elif fence:
            inside = fence
        else:
            hashes = len(line) - len(line.lstrip("#"))
            after = line[hashes:]
            if 1 <= hashes <= 6 and after[:1] in (" ", "\t") and len(after) > 1:
                title = after.strip()
                bare = title.rstrip(" \t").rstrip("#")
                if bare != title and bare[-1:] in (" ", "\t"):
                    title = bare.rstrip()
                marks.append((k, hashes, title))
    parts, stack = [], []
    if not marks or marks[0][0] > skip:
        parts.append((None, [], skip, skip, marks[0][0] if marks else len(lines)))
    for i, (k, level, title) in enumerate(marks):
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, title))
        parts.append((title, [t for _, t in stack], k, k + 1, marks[i + 1][0] if i + 1 < len(marks) else len(lines)))
    out, seen = [], []
    for heading, ancestry, show, lo, hi in parts:
        key = " > ".join(ancestry) or "(document)"
        seen.append(key)
        chunks, held = [], []
        body = "".join(lines[lo:hi]).strip()
        if len(body.encode()) <= limit:
            chunks = [(lo, hi, body)] if body else []
        else:
            for k in [*range(lo, hi), hi]:
                size = sum(len(lines[h].encode()) for h in held)
                if held and (k == hi or size + len(lines[k].encode()) > limit):
                    if text := "".join(lines[h] for h in held).strip():
                        chunks.append((held[0], k, text))
                    held = []
                if k < hi and len(lines[k].encode()) > limit:
                    piece, pieces = "", []
                    for c in lines[k]:
                        if piece and len((piece + c).encode()) > limit:
                            pieces.append(piece)
                            piece = ""
                        piece += c
                    chunks += [(k, k + 1, x) for x in [*pieces, piece.strip()]]
                elif k < hi:
                    held.append(k)
        if not chunks and heading is not None:
            chunks = [(lo, hi, "")]
        for n, (a, b, text) in enumerate(chunks, 1):
            name = key + (f"~{seen.count(key)}" if seen.count(key) > 1 else "") + (f"#chunk-{n}" if len(chunks) > 1 else "")
            out.append((hashlib.sha256(f"{path}\0{name}".encode()).hexdigest(), heading, ancestry, (show if n == 1 else a) + 1, b, text))
    return out


def test_sections_equal_those_by_the_rules():
    rnd = random.Random(17)
    bits = ["# A", "## B", "#", "# ", "#  ", "###\tC ##", "# C#", "# D ###", "# ##", "####### no", "#no", " # no", "```", "````", "``` py `x`", "~~~", "~~~~ ", "\t```", "   ~~~", "    ```", "text", "", "   ", "  indented  ", "é😀" * 4, "x" * 30, "---", "type: a", "(document)", "# (document)", "a\x0cb", "\u2028"]
    for _ in range(4000):
        note = "".join(rnd.choice(bits) + rnd.choice(["\n", "\n", "\n", "\r\n"]) for _ in range(rnd.randint(0, 14))) + rnd.choice(["", "end", "# Z"])
        for limit in (1, 9, 25, 12000):
            got = [(s["section_id"], s["heading"], s["heading_path"], s["line_start"], s["line_end"], s["text"]) for s in markdown.split_note("n.md", note.encode(), limit)]
            assert got == by_the_rules("n.md", note, limit), (note, limit)


def test_chunks_count_line_ends_and_lose_outer_white_space():
    assert [s["text"] for s in sections("   indented  \nb")] == ["indented  \nb"]
    assert [s["text"] for s in sections("aaaa\nbbbb\ncccc\n", 9)] == ["aaaa", "bbbb", "cccc"]
    assert [s["text"] for s in sections("aaaa\nbbbb\ncccc", 9)] == ["aaaa", "bbbb\ncccc"]
    assert [s["heading"] for s in sections("``` py `x`\n# not?\n```\n# Yes")] == [None, "Yes"]


def test_links(spark):
    notes = ["[a](x.md) [[n#part|t]] [[n]] ![i](p.png 't') [[#x]] [x]() [[a#]] [[ b ]] [y](u v)", "[[p|]] [e](\u2003z) [f](g\u2003h)", "", "[[[x]]] [a][b](c)"]
    want = [["x.md", "n", "p.png", " b ", "u"], ["g"], []]
    assert [markdown.links_of(n) for n in notes[:3]] == want
    got = spark.createDataFrame([(k, n) for k, n in enumerate(notes)], "k int, t string").select("k", links(F.col("t")).alias("l")).orderBy("k").collect()
    assert [r.l for r in got] == [markdown.links_of(n) for n in notes]


class Captured:
    """Stands for notes: what `split` would run in a worker, as a function of Arrow batches."""

    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return lambda batches: run(iter(batches))

    def mapInPandas(self, run, schema):  # noqa: N802
        return lambda batches: (pa.RecordBatch.from_pandas(f) for f in run(b.to_pandas() for b in batches))


def of_notes(contents):
    return pa.RecordBatch.from_pylist([{"path": f"{n}.md", "root_id": "r", "content": c} for n, c in enumerate(contents)])


def test_a_worker_holds_a_slice_of_sections():
    batch = of_notes([(f"# Note {n}\n" + "some words of a line\n" * 250).encode() for n in range(3000)])
    tracemalloc.start()
    rows = sum(b.num_rows for b in markdown.split(Captured(), 2000)([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 9000 and peak < 10_000_000  # the batch has 15 MB of texts
    # the links of a note are in each of its sections
    note = "".join(f"# H{n}\n[link](target-{n}.md)\n" for n in range(1500))
    got = list(markdown.split(Captured())([of_notes([note.encode()])]))
    assert max(b.nbytes for b in got) < 3_000_000
    assert [r for b in got for r in b.to_pylist()] == [s | {"root_id": "r"} for s in markdown.split_note("0.md", note.encode())]


def test_queries_of_chunks_hand_back_their_columns_only(spark):
    for name in ("split_body_chunks", "split_sections"):
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
        assert "MapInArrow" in plan and "links" not in plan, name


def test_chunks():
    got = sections("# A\n" + "x" * 40, 10)
    assert len(got) > 1 and all(len(s["text"].encode()) <= 10 and s["heading_path"] == ["A"] for s in got)
    assert len({s["section_id"] for s in got}) == len(got)
    tiny = sections("# A\n" + "é€😀" * 3, 1)
    assert "".join(s["text"] for s in tiny) == "é€😀" * 3 and all(len(s["text"].encode()) <= 4 for s in tiny)
    assert len({s["section_id"] for s in sections("# A\none\n# A\ntwo")}) == 2
    assert sections("a\r\nb")[0]["content_hash"] != sections("a\nb")[0]["content_hash"]


TOML = """
database = "store"
global_notes = ["shared/always.md"]
private_paths = ["secret/**"]
model_bundle = "hash"
{extra}
[[roots]]
id = "one"
project = "p"
path = "one"
exclude = ["drafts"]
[[roots]]
id = "shared"
project_scope = "s"
path = "shared"
"""


@pytest.fixture
def vault(tmp_path):
    notes = {
        "one/a.md": "---\ntype: note\n---\n# Cache plan\nThe cache budget is fixed, see PAUS-4.\n## Limits\nrate limits and quotas\n",
        "one/b.md": "# Other\nPHO-123 talks about rate limits of mail\n",
        "one/drafts/c.md": "# Draft\ncache budget\n",
        "one/.env.md": "# Env\ncache budget\n",
        "one/plain.txt": "cache budget",
        "shared/always.md": "# Always\nthe cache budget of all\n",
        "shared/other.MD": "# Shared\ncache budget elsewhere\n",
    }
    for name, text in notes.items():
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_text(text)
    outside = tmp_path / "outside.md"
    outside.write_text("# Out\ncache budget\n")
    os.symlink(outside, tmp_path / "one/link.md")
    (tmp_path / "c.toml").write_text(TOML.format(extra=""))
    return tmp_path


def test_configuration_errors(vault):
    good = (vault / "c.toml").read_text()
    assert conf.read_config(f"{vault}/c.toml").section_bytes == 12000
    for broken in (
        good.replace('id = "shared"', 'id = "one"'), good.replace('path = "shared"', 'path = "one/x"'), good.replace("shared/always", "elsewhere/always"),
        good.replace("shared/always", "one/drafts/c"), "section_bytes = 0\n" + good, "private = []\n" + good, 'database = "x"', good.replace('database = "store"', ""),
    ):
        (vault / "bad.toml").write_text(broken)
        with pytest.raises(conf.ConfigError):
            conf.read_config(f"{vault}/bad.toml")


def test_scan_rules(spark, vault):
    c = conf.read_config(f"{vault}/c.toml")
    got = {os.path.relpath(r.path, vault) for r in markdown.scan(spark, list(c.roots), list(c.private)).collect()}
    assert got == {"one/a.md", "one/b.md", "shared/always.md", "shared/other.MD"}
    assert markdown.safe_source(c, "a.md")[1] == f"{vault}/one/a.md"
    assert markdown.safe_source(c, f"{vault}/outside.md") is None and markdown.safe_source(c, "drafts/c.md") is None and markdown.safe_source(c, "link.md") is None
    assert markdown.read_source(spark, c, "a.md", "Limits") == "rate limits and quotas"
    assert markdown.read_source(spark, c, "a.md", "Cache plan > Limits", 14) == "ra\n[truncated]"
    for args in (("nowhere.md",), ("a.md", "No"), ("a.md", None, 0)):
        with pytest.raises(ValueError):
            markdown.read_source(spark, c, *args)


def names(rows, base):
    return [(os.path.relpath(r["path"], base), r["heading"]) for r in rows]


def test_index_search_refresh(spark, vault):
    c = conf.read_config(f"{vault}/c.toml")
    engine = Engine(spark, c, HashEncoder(32))
    assert engine.search("cache").metrics.failure_reason == "INDEX_MISSING"
    first = engine.index()
    assert (first["generation"], first["state"], first["sections"]) == (1, "ready", 5)
    got = engine.search("cache budget", project="p", mode="lexical")
    assert names(got.items, vault) == [("one/a.md", "Cache plan"), ("shared/always.md", "Always")]
    assert [r["reason"] for r in got.items] == ["heading match, body match", "global-note inclusion, body match"]
    assert names(engine.search("cache budget", mode="lexical").items, vault) == [("shared/always.md", "Always")]
    assert {r["root_id"] for r in engine.search("cache budget", all_projects=True, mode="lexical").items} == {"one", "shared"}
    assert engine.search("cache", root_id="nowhere").items == [] and engine.search("...", project="p", mode="lexical").items == []
    fused = engine.search("cache budget PAUS-4", project="p")
    assert fused.metrics.retrieval_mode == "fused" and not fused.metrics.fallback
    assert (fused.items[0]["guard_reason"], fused.items[0]["lane"]) == ("protected:atom-1", "lexical+semantic")
    assert fused.items[0]["project"] == "p" and "PHO-123" not in "".join(r["text"] for r in fused.items)
    # postings and scan give the same
    index = store.open_index(spark, c)
    scan = store.open_index(spark, c)
    scan.postings = None
    for q in ("what is the plan for rate limits",):
        a, b = ([(r.section_id, round(r.score, 9), r.reason) for r in search(i, q, project="p").collect()] for i in (index, scan))
        assert a == b and a


def test_changed_sources(spark, vault):
    """A changed source: its hits go, the fused result is lexical; a refresh brings it back and encodes only what changed."""
    c = conf.read_config(f"{vault}/c.toml")
    engine = Engine(spark, c, HashEncoder(32))
    engine.index()
    assert len(engine.search("cache budget", project="p", mode="lexical").items) == 2
    (vault / "one/a.md").write_text("# Cache plan\nThe cache budget has changed\n")
    stale = engine.search("cache budget", project="p")
    assert stale.metrics.fallback and stale.refresh == {f"{vault}/one/a.md"} and names(stale.items, vault) == [("shared/always.md", "Always")]
    before = {r.section_id: r.vector for r in store.Store(spark, c.store).table("vectors").collect()}
    seen = []

    class Counting(HashEncoder):
        def encode(self, texts):
            if len(texts) > 0:
                seen.append(list(texts))
            return super().encode(texts)

    second = store.build(spark, c, encoder=lambda rows: counted(rows, Counting(32), seen), encoder_version="hash-32")
    assert (second["generation"], second["sections"]) == (2, 4) and seen == [["The cache budget has changed"]]
    after = {r.section_id: r.vector for r in store.Store(spark, c.store).table("vectors").collect()}
    assert sum(before.get(k) == v for k, v in after.items()) == 3
    os.remove(vault / "one/b.md")
    third = engine.index()
    assert third["sections"] == 3 and store.Store(spark, c.store).table("postings").filter("path LIKE '%b.md'").count() == 0
    assert len(engine.search("cache budget changed", project="p", mode="lexical").items) == 1


def counted(rows, encoder, seen):
    texts = [(r.section_id, r.text) for r in rows.collect()]
    vectors = encoder.encode([t for _, t in texts])
    return rows.sparkSession.createDataFrame([(s, v) for (s, _), v in zip(texts, vectors, strict=True)], "section_id string, vector array<float>")


def test_sources_that_count_as_deleted(spark, vault):
    c = conf.read_config(f"{vault}/c.toml")
    engine = Engine(spark, c, HashEncoder(16))
    engine.index()
    got = engine.search("cache budget", project="p", mode="lexical", gone={f"{vault}/one/a.md"})
    assert names(got.items, vault) == [("shared/always.md", "Always")] and got.refresh == {f"{vault}/one/a.md"}
    assert len(engine.search("cache budget", project="p", mode="lexical").items) == 2


def test_vectors_are_kept_by_generation(spark, vault):
    engine = Engine(spark, conf.read_config(f"{vault}/c.toml"), HashEncoder(16))
    engine.index()
    assert engine.search("cache budget", project="p").metrics.retrieval_mode == "fused"
    first = engine._kept
    engine.search("cache budget", project="p")
    assert engine._kept is first and first[1].storageLevel.useMemory
    (vault / "one/b.md").write_text("# New\ncache budget again\n")
    engine.index()
    assert len(engine.search("cache budget", project="p").items) == 3 and engine._kept[0] == 2 and not first[1].storageLevel.useMemory
    engine.close()


def test_encoders_that_load_late():
    calls, token = [], [1]

    def factory():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("no model")
        return HashEncoder(16)

    lazy = LazyEncoder(factory, lambda: token[0], "v")
    for _ in range(3):
        with pytest.raises(RuntimeError):
            lazy.encode(["a"])
    assert len(calls) == 1 and lazy.version == "v"
    token[0] = 2
    with pytest.raises(RuntimeError):
        lazy.encode(["a"])
    token[0] = 3
    assert len(lazy.encode(["a"])) == 1 and lazy.encode(["b"]) and len(calls) == 3


def test_failures_of_encoders(spark, vault):
    c = conf.read_config(f"{vault}/c.toml")

    def broken(rows):
        raise RuntimeError("no model")

    pointer = store.build(spark, c, encoder=broken, encoder_version="x")
    assert (pointer["state"], pointer["reason"]) == ("stale", "REFRESH_FAILED") and store.state_of(spark, c) == ("stale", "REFRESH_FAILED")
    got = Engine(spark, c, HashEncoder(16)).search("cache budget", project="p")
    assert got.metrics.fallback and got.metrics.status == "semantic_failure" and got.items
    index = store.open_index(spark, c)
    assert semantic_with(index, broken, "cache budget", project="p").count() == 2
    assert backend_reason(None) == "MODEL_MISSING" and backend_reason(str(vault)) == "MODEL_MISSING"


def test_races_and_schemas(spark, vault, monkeypatch):
    c = conf.read_config(f"{vault}/c.toml")
    store.build(spark, c)
    before = set(os.listdir(c.store))
    assert store.build(spark, c)["generation"] == 1 and set(os.listdir(c.store)) == before  # no change, no write
    (vault / "one/b.md").write_text("# Other\nnew text\n")
    monkeypatch.setattr(store, "same_sources", lambda a, b: False)
    assert store.build(spark, c)["generation"] == 1
    # another builder publishes while this one writes
    monkeypatch.setattr(store, "same_sources", lambda a, b: bool(files.replace_text(spark, at, json.dumps(current | {"generation": 2}))) or True)
    at, current = f"{vault}/store/current.json", json.loads(files.read_text(spark, f"{vault}/store/current.json"))
    with pytest.raises(store.StoreError, match="published"):
        store.build(spark, c)
    monkeypatch.undo()
    files.replace_text(spark, at, json.dumps(current))
    assert store.build(spark, c)["generation"] == 4
    assert not files.create_new(spark, f"{vault}/store/g00000004/_claim") and store.Store(spark, c.store).claim() == 5
    at = f"{vault}/store/current.json"
    files.replace_text(spark, at, json.dumps(json.loads(files.read_text(spark, at)) | {"schema": 1}))
    with pytest.raises(store.StoreError):
        store.open_index(spark, c)
    assert store.state_of(spark, c) == ("disabled", "INDEX_UNAVAILABLE")
    assert store.build(spark, c)["generation"] == 6
    store.Store(spark, c.store).prune(1)
    assert sorted(n for n in os.listdir(c.store) if n[0] == "g") == ["g00000006"]


def test_invalid_vectors_make_the_result_lexical(spark, vault):
    c = conf.read_config(f"{vault}/c.toml")
    engine = Engine(spark, c, HashEncoder(16))
    engine.index()
    index = store.open_index(spark, c)
    v = index.vectors
    from pyspark.sql import functions as F

    index.vectors = v.withColumn("vector", F.transform("vector", lambda x: x * F.lit(float("nan")).cast("float")))
    refresh = set()
    rows = search(index, "cache budget", project="p", query_vector=HashEncoder(16).encode(["cache budget"])[0], refresh=refresh).collect()
    assert rows and all(r.lane == "lexical" for r in rows) and refresh


def test_policies_and_arguments(spark, vault):
    for bad in ({"semantic_score_floor": 2}, {"relative_semantic_score_floor": True}, {"balanced_admission": 1}):
        with pytest.raises(ValueError):
            Policies(**bad)
    d = policy_diagnostics(None, Policies(semantic_score_floor=None))
    assert not d["selection_policies"]["semantic_score_floor"]["enabled"] and d["rrf_rank_constant"] == 60
    assert d["selection_policies"]["relaxed_lexical_matching"]["value"] == 0.5 and all(p["rationale"] for p in d["selection_policies"].values())
    engine = Engine(spark, conf.read_config(f"{vault}/c.toml"))
    for args in ({"mode": "other"}, {"deadline_ms": 0}, {"limit": 0}, {"all_projects": "yes"}):
        with pytest.raises(ValueError):
            engine.search("q", **args)


def test_deadline(spark, vault):
    c = conf.read_config(f"{vault}/c.toml")
    engine = Engine(spark, c)
    engine.index()
    got = engine.search("cache budget", project="p", mode="lexical", deadline_ms=1)
    assert got.items == [] and (got.metrics.status, got.metrics.failure_reason) == ("timeout", "deadline_exceeded")
    assert len(engine.search("cache budget", project="p", mode="lexical", deadline_ms=120_000).items) == 2


def test_command_line(spark, vault, capsys):
    at = ["--config", f"{vault}/c.toml"]
    assert cli.main([*at, "index"], spark) == 0 and "index generation 1" in capsys.readouterr().out
    assert cli.main([*at, "search", "cache budget", "--project", "p", "--json"], spark) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["diagnostics"]["retrieval_mode"] == "fused" and out["items"][0]["heading"] == ["Cache plan"] and "lane" not in out["items"][0]
    assert cli.main([*at, "search", "cache budget", "--project", "p", "--retrieval-mode", "lexical", "--json"], spark) == 0
    assert isinstance(json.loads(capsys.readouterr().out), list)
    assert cli.main([*at, "hook", "cache budget", "--project", "p", "--json", "--deadline-ms", "120000"], spark) == 0
    hook = json.loads(capsys.readouterr().out)
    assert hook["metrics"]["status"] == "ok" and "fusion_policies" in hook["items"][0]
    assert cli.main([*at, "read", "a.md", "--heading", "Limits"], spark) == 0 and "rate limits and quotas" in capsys.readouterr().out
    assert cli.main([*at, "read", "nowhere.md"], spark) == 2 and "error" in capsys.readouterr().err
    assert cli.main([*at, "model", "status", "--json"]) == 0 and json.loads(capsys.readouterr().out)["reason"] == "MODEL_MISSING"
    assert cli.main(["--config", f"{vault}/none.toml", "index"], spark) == 2
    (vault / "bundle").mkdir()
    assert cli.main(["model", "license", "--bundle-dir", f"{vault}/bundle"]) == 0 and capsys.readouterr().out == ""
    (vault / "bundle/manifest.json").write_text(json.dumps({"licenses": [{"name": "m", "spdx_id": "MIT", "notice": "all of it\n"}, {}]}))
    assert cli.main(["model", "license", "--bundle-dir", f"{vault}/bundle"]) == 0 and capsys.readouterr().out == "m: MIT\nall of it\nlicense: unknown\n"


def test_notes_as_a_stream(spark, vault):
    at = f"{vault}/stream"
    run = lambda: ingest.ingest(spark, f"{vault}/one/drafts", at, "one").awaitTermination()
    run()
    assert [r.text for r in ingest.current(spark, at).collect()] == ["cache budget"]
    (vault / "one/drafts/d.md").write_text("# New\nmore\n")
    run()
    assert {r.heading for r in ingest.current(spark, at).collect()} == {"Draft", "New"}


def test_root_order(spark, vault):
    roots = [Root("x", "p", f"{vault}/one"), Root("y", "p", f"{vault}/one")]
    assert {r.root_id for r in markdown.scan(spark, roots).collect()} == {"y"}
