"""Queries for sources, text columns, freshness and conversations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.text import content_hash, content_terms, excerpt, fold_udf, index_tokens, links, lower_form, multiset_fingerprint, query_tokens
from ..operators import freshness, workload
from ..operators.evaluate import containment
from ..operators.lexical import scope_condition
from ..sources import conversations, markdown
from .query import Root, resolve_scope
from .registry import query, table

INDEX_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
QUERY_WORDS = r"regexp_extract_all(lower(text), '[A-Za-z][A-Za-z0-9]*-[0-9]+|[\p{L}\p{N}_]+')"
ROOTS = [Root(f"src{n}", f"project{n % 4}") for n in range(20)]
GLOBALS = ["doc/7.md", "doc/11.md"]


def notes(spark, sf_dir):
    """documents as notes: path, root_id, text, content_hash."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.lit("doc/"), "doc_id", F.lit(".md")).alias("path"), F.col("source").alias("root_id"), "text", "lang", content_hash(F.col("text")).alias("content_hash"))


NOTES = "notes AS (SELECT doc_id, 'doc/' || doc_id || '.md' AS path, source AS root_id, text, lang, sha256(text) AS content_hash FROM documents)"


@query(f"WITH {NOTES} SELECT doc_id, path, root_id, path IN ('doc/7.md', 'doc/11.md') AS is_global FROM notes WHERE root_id IN ('src1', 'src5', 'src9', 'src13', 'src17') OR path IN ('doc/7.md', 'doc/11.md')")
def scan_scope_filter(spark, sf_dir):
    scope = resolve_scope(ROOTS, GLOBALS, project="project1")
    return notes(spark, sf_dir).filter(scope_condition(scope)).select("doc_id", "path", "root_id", F.col("path").isin(GLOBALS).alias("is_global"))


@query(f"WITH {NOTES} SELECT doc_id, path FROM notes WHERE false")
def scope_none_empty(spark, sf_dir):
    return notes(spark, sf_dir).filter(scope_condition(resolve_scope(ROOTS, [], root_id="nowhere"))).select("doc_id", "path")


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_fingerprint(spark, sf_dir):
    return notes(spark, sf_dir).select("doc_id", "content_hash")


@query("SELECT count(*) AS n_files, CAST(sum(('0x' || substr(sha256('doc/' || doc_id || '.md' || chr(10) || sha256(text)), 1, 15))::BIGINT) AS VARCHAR) AS fingerprint FROM documents")
def corpus_fingerprint(spark, sf_dir):
    rows = notes(spark, sf_dir).select(F.sha2(F.concat_ws("\n", "path", "content_hash"), 256).alias("d"))
    return rows.agg(F.count(F.lit(1)).alias("n_files"), multiset_fingerprint(F.col("d")).alias("fingerprint"))


@query(f"SELECT doc_id, len({QUERY_WORDS})::BIGINT AS n_terms, array_to_string({QUERY_WORDS}, ' ') AS terms FROM documents")
def tokenize_terms(spark, sf_dir):
    t = query_tokens(F.lower("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_terms"), F.array_join(t, " ").alias("terms"))


def _stop() -> str:
    from ..functions.text import STOPWORDS

    return "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


@query(f"SELECT doc_id, count(DISTINCT w) AS n_terms FROM (SELECT doc_id, unnest(list_filter({QUERY_WORDS}, lambda x: NOT list_contains({_stop()}, x))) AS w FROM documents) GROUP BY doc_id")
def distinct_terms_stopwords(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.size(content_terms(query_tokens(F.lower("text")))).cast("long").alias("n_terms"))
    return d.filter("n_terms > 0")


WHITE = r"[\x09-\x0D\x1C-\x1F\x{85}\p{Z}]+"


@query(f"SELECT doc_id, trim(regexp_replace(lower(text), '{WHITE}', ' ', 'g')) AS norm FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", lower_form(F.col("text")).alias("norm"))


@query()
def normalize_text_folded(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fold_udf("text").alias("norm"))


@query(f"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '{WHITE}', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 500 THEN t ELSE rtrim(substr(t, 1, 500)) || '...' END AS excerpt FROM f""")
def excerpt_500(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", excerpt(F.col("text")).alias("excerpt"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN url || ' note-' || page_id WHEN 1 THEN 'note-' || page_id || ' ' || url WHEN 2 THEN 'note-' || page_id || ' a b b.md' ELSE ' spaced ' END AS targets FROM pages""")
def link_extract(spark, sf_dir):
    """Wiki links with titles and anchors, Markdown links with titles, repeats, and forms that are no links."""
    note = F.concat(F.lit("note-"), "page_id")
    page = F.concat(F.lit("[page]("), "url", F.lit(")"))
    forms = [
        F.concat_ws(" and ", page, F.concat(F.lit("[["), note, F.lit("|Note]]")), page),
        F.concat_ws(", ", F.concat(F.lit("![["), note, F.lit("#part|Note]]")), F.concat(F.lit("[[#here]] [["), note, F.lit("]]")), page),
        F.concat(F.lit("[x]() [[|t]] [["), note, F.lit("#a b]] [[a b]] ![pic](b.md 'title') [ref][b]")),
        F.lit("[[ spaced |x]] [[a#]] [one] (two)"),
    ]
    text = F.coalesce(*[F.when(F.col("page_id") % 4 == k, f) for k, f in enumerate(forms)])
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(links(text), " ").alias("targets"))


@query(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({INDEX_WORDS}) AS term FROM documents) GROUP BY term")
def term_document_frequency(spark, sf_dir):
    return workload.document_frequency(table(spark, sf_dir, "documents"), "doc_id", index_tokens(F.lower("text")))


@query(f"SELECT count(*) AS n, sum(len({INDEX_WORDS}))::BIGINT AS n_words, round(avg(len({INDEX_WORDS})), 6) AS mean_length FROM documents")
def corpus_stats(spark, sf_dir):
    n = F.size(index_tokens(F.lower("text")))
    return table(spark, sf_dir, "documents").select(n.alias("n")).agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("n_words"), F.round(F.avg("n"), 6).alias("mean_length"))


# --- an index against live sources: every 5th note changed, every 11th gone, some new


def live_notes(spark, sf_dir):
    d = notes(spark, sf_dir).filter("doc_id % 11 <> 3")
    changed = F.when(F.col("doc_id") % 5 == 2, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.col("content_hash"))
    path = F.when(F.col("doc_id") % 7 == 6, F.concat(F.lit("new/"), "doc_id", F.lit(".md"))).otherwise(F.col("path"))
    return d.select(path.alias("path"), "root_id", changed.alias("content_hash"))


LIVE = f"""{NOTES}, live AS (SELECT CASE WHEN doc_id % 7 = 6 THEN 'new/' || doc_id || '.md' ELSE path END AS path, root_id,
  CASE WHEN doc_id % 5 = 2 THEN sha256(text || '!') ELSE content_hash END AS content_hash FROM notes WHERE doc_id % 11 <> 3)"""


@query(f"WITH {LIVE} SELECT n.doc_id, n.path FROM notes n JOIN live l ON n.path = l.path AND n.content_hash = l.content_hash")
def staleness_filter(spark, sf_dir):
    return freshness.fresh_hits(notes(spark, sf_dir), live_notes(spark, sf_dir)).select("doc_id", "path")


@query(f"WITH {LIVE} SELECT path FROM notes n WHERE NOT EXISTS (SELECT 1 FROM live l WHERE n.path = l.path AND n.content_hash = l.content_hash)")
def refresh_set(spark, sf_dir):
    return freshness.refresh_set(notes(spark, sf_dir), live_notes(spark, sf_dir))


@query(f"""WITH {LIVE} SELECT coalesce(n.path, l.path) AS path, CASE WHEN n.path IS NULL THEN 'insert' WHEN l.path IS NULL THEN 'delete'
  WHEN n.content_hash = l.content_hash AND n.root_id = l.root_id THEN 'unchanged' ELSE 'update' END AS change FROM notes n FULL JOIN live l ON n.path = l.path""")
def incremental_diff(spark, sf_dir):
    return freshness.diff(notes(spark, sf_dir), live_notes(spark, sf_dir))


@query(f"WITH {LIVE} SELECT path, root_id, content_hash FROM live UNION ALL SELECT path, root_id, content_hash FROM notes WHERE path NOT IN (SELECT path FROM live)")
def upsert_generation(spark, sf_dir):
    return freshness.upsert(notes(spark, sf_dir).select("path", "root_id", "content_hash"), live_notes(spark, sf_dir), "path")


@query(f"WITH {LIVE} SELECT doc_id FROM notes WHERE path IN (SELECT path FROM live)")
def delete_removed(spark, sf_dir):
    gone = freshness.diff(notes(spark, sf_dir), live_notes(spark, sf_dir)).filter("change = 'delete'")
    return freshness.delete_by(notes(spark, sf_dir), gone).select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 OR doc_id NOT IN (SELECT vec_id FROM embeddings)")
def needs_reembedding(spark, sf_dir):
    sections = notes(spark, sf_dir).select("doc_id", F.col("doc_id").cast("string").alias("section_id"), "content_hash", F.lit("v1").alias("encoder"))
    made = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("section_id"))
    kind = F.when(F.col("section_id").cast("long") % 3 == 0, F.lit("v0")).otherwise(F.lit("v1"))
    vectors = made.join(sections.select("section_id", "content_hash"), "section_id").withColumn("encoder", kind)
    return freshness.needs_embedding(sections, vectors, ["encoder"]).select("doc_id")


# --- notes and conversations


@query("""WITH t AS (SELECT *, printf('conv/%08d.md', conv_id) AS path, len(string_split(text, chr(10))) AS n FROM conversations),
p AS (SELECT *, 5 + coalesce(sum(n + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, turn = max(turn) OVER (PARTITION BY conv_id) AS last FROM t),
s AS (SELECT path, 'Conversation ' || conv_id || ' > Session 1 > ' || role || ' ' || turn AS ids, role || ' ' || turn AS heading, a AS lo, a + n + (NOT last)::INT AS hi, regexp_replace(text, '^[ \\n\\r\\t]+|[ \\n\\r\\t]+$', '', 'g') AS text FROM p
  UNION ALL SELECT DISTINCT path, 'Conversation ' || conv_id, 'Conversation ' || conv_id, 1, 2, '' FROM t UNION ALL SELECT DISTINCT path, 'Conversation ' || conv_id || ' > Session 1', 'Session 1', 3, 4, '' FROM t)
SELECT sha256(path || chr(0) || ids) AS section_id, path, heading, ids AS heading_path, lo::INT AS line_start, hi::INT AS line_end, text FROM s""")
def split_sections(spark, sf_dir):
    """Rendered conversations through the splitter."""
    rendered = conversations.render(table(spark, sf_dir, "conversations"))
    rows = markdown.split(rendered.select("path", F.lit("conversations").alias("root_id"), F.col("markdown").cast("binary").alias("content")), columns=["section_id", "path", "heading", "heading_path", "line_start", "line_end", "text"])
    return rows.select("section_id", "path", "heading", F.array_join("heading_path", " > ").alias("heading_path"), "line_start", "line_end", "text")


@query()
def split_body_chunks(spark, sf_dir):
    """Documents through the splitter, in chunks of 2000 bytes."""
    rows = notes(spark, sf_dir).select("path", "root_id", F.col("text").cast("binary").alias("content"))
    return markdown.split(rows, 2000, ["section_id", "path", "heading", "line_start", "line_end", "text"])


@query("""SELECT conv_id, printf('conv/%08d.md', conv_id) AS path, '# Conversation ' || conv_id || chr(10) || chr(10) || '## Session 1' || chr(10) || chr(10) ||
  string_agg('### ' || role || ' ' || turn || chr(10) || text, chr(10) || chr(10) ORDER BY turn) || chr(10) AS markdown FROM conversations GROUP BY conv_id""")
def render_sessions(spark, sf_dir):
    return conversations.render(table(spark, sf_dir, "conversations"))


LINES = """lines AS (SELECT conv_id, turn, role, text, 5 + coalesce(sum(n + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_start, n
  FROM (SELECT *, len(string_split(text, chr(10))) AS n FROM conversations))"""


@query(f"WITH {LINES} SELECT conv_id, turn, line_start::BIGINT AS line_start, (line_start + n)::BIGINT AS line_end FROM lines")
def turn_line_ranges(spark, sf_dir):
    return conversations.turn_lines(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "line_start", "line_end")


@query(f"""WITH {LINES}, t AS (SELECT printf('conv/%08d.md', conv_id) AS path, conv_id, turn, line_start AS a, line_start + n AS b FROM lines),
targets AS (SELECT conv_id AS question_id, path, a, b, printf('%s#%08d-%08d', path, a::BIGINT, b::BIGINT) AS evidence_id FROM t WHERE turn % 2 = 1),
hits AS (SELECT conv_id || '-' || turn AS section_id, path, a - turn % 3 AS lo, b - (turn % 4 = 3)::INT AS hi FROM t)
SELECT section_id, evidence_id FROM hits JOIN targets USING (path) WHERE lo <= a AND hi >= b""")
def evidence_containment(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    references = turns.filter("turn % 2 = 1").select(F.col("conv_id").alias("question_id"), "conv_id", "turn")
    hits = conversations.sections(turns).withColumn("turn", F.element_at(F.split("section_id", "-"), 2).cast("long"))
    hits = hits.withColumn("line_start", F.col("line_start") - F.col("turn") % 3).withColumn("line_end", F.col("line_end") - (F.col("turn") % 4 == 3).cast("int"))
    return containment(hits.select("section_id", "path", "line_start", "line_end"), conversations.evidence_targets(references, turns)).select("section_id", "evidence_id")


@query("""WITH s AS (SELECT conv_id % 10 AS conv_id, conv_id AS session, CASE WHEN conv_id % 4 = 3 THEN NULL ELSE DATE '2023-01-01' + (conv_id * 37 % 400)::INT END AS d FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT conv_id, session, row_number() OVER (PARTITION BY conv_id ORDER BY d IS NULL, d, session) AS place FROM s""")
def ordered_sessions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    day = F.date_add(F.to_date(F.lit("2023-01-01")), (F.col("conv_id") * 37 % 400).cast("int"))
    forms = ["yyyy-MM-dd", "'12:00 am on 'd MMMM, yyyy", "yyyy-MM-dd'T00:00:00.000Z'"]
    form = F.coalesce(*[F.when(F.col("conv_id") % 4 == n, F.date_format(day, f)) for n, f in enumerate(forms)], F.lit("soon"))
    rows = c.select((F.col("conv_id") % 10).alias("conv_id"), F.col("conv_id").alias("session"), form.alias("session_date"))
    return conversations.ordered_sessions(rows).select("conv_id", "session", F.col("place").cast("long").alias("place"))


@query()
def wordpiece_tokens(spark, sf_dir):
    """Ids of the documents with a vocabulary of their letters: the tokenizer's path through the table."""
    from ..functions.wordpiece import WordPiece

    special = ["[PAD]", "[UNK]", "[CLS]", "[SEP]"]
    letters = [chr(c) for c in range(ord("a"), ord("z") + 1)] + list("0123456789")
    tok = WordPiece({t: n for n, t in enumerate(special + letters + [f"##{x}" for x in letters])}, length=256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                ids = [tok.encode(t.as_py() or "") for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")
