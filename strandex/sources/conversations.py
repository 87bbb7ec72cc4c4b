"""Conversations: reading, session order, rendering to Markdown with line ranges, evidence, questions.

`read` takes a JSON list of conversations with sessions; `render_sessions` makes a note of
each session. The plain functions below work on a table of turns, where a conversation is
one session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import evidence_id

# Forms of a session's date, and the categories of questions.
DATE_FORMATS = (
    "h:mm a 'on' d MMMM, yyyy",
    "h:mm a 'on' d MMM, yyyy",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]['Z']",
    "yyyy-MM-dd",
)
CATEGORIES = {1: "multi-hop", 2: "temporal", 3: "open-domain", 4: "single-hop", 5: "adversarial"}


def parse_date(c: Column) -> Column:
    """The first of the known forms that fits, else null; brackets around a date play no part."""
    text = F.trim(F.regexp_replace(F.trim(c), r"^[()]+|[()]+$", ""))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS])


def ordered_sessions(sessions: DataFrame) -> DataFrame:
    """conv_id, session, session_date -> with `date` and `place`: dated sessions by date first, then the others by their text; ties by number."""
    undated = F.when(F.col("date").isNull(), F.col("session_date"))
    order = Window.partitionBy("conv_id").orderBy(F.col("date").isNull(), "date", undated, "session")
    return sessions.withColumn("date", parse_date(F.col("session_date"))).withColumn("place", F.row_number().over(order))


_TURNS = "array<struct<dia_id:string,speaker:string,text:string,session_date_time:string,query:string,blip_caption:string>>"
_LIST = "array<struct<conversation:map<string,string>,qa:array<struct<question:string,answer:string,category:int,evidence:array<string>>>>>"


def read(spark: SparkSession, path: str, counts: dict[int, int] | None = None) -> DataFrame:
    """conv, conversation (map of session names to JSON), qa of a JSON list; with `counts`, its questions by category must be these.

    The file is one JSON document, so one task parses it; all that follows is by conversation.
    """
    text = spark.read.option("wholetext", True).text(path)
    rows = text.select(F.posexplode(F.from_json("value", _LIST)).alias("conv", "c")).select(F.col("conv").cast("long").alias("conv"), "c.*")
    if not rows.filter("conversation IS NULL").isEmpty() or rows.isEmpty():
        raise ValueError(f"{path} is no list of conversations")
    if counts is not None:
        got = {r["category"]: r["n"] for r in rows.select(F.explode("qa.category").alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n")).collect()}
        if got != counts:
            raise ValueError(f"questions by category: {got} instead of {counts}")
    return rows


def _clean(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n")


def sessions(conversations: DataFrame) -> DataFrame:
    """conv_id, session, session_date, turns, date, place of every session, in order within its conversation."""
    entry = conversations.select(F.col("conv").alias("conv_id"), "conversation", F.explode("conversation").alias("name", "value"))
    own = entry.filter(F.col("name").rlike("^session_[0-9]+$"))
    date = F.col("conversation")[F.concat("name", F.lit("_date_time"))]
    rows = own.select("conv_id", F.substring_index("name", "_", -1).cast("int").alias("session"), _clean(date).alias("session_date"), F.from_json("value", _TURNS).alias("turns"))
    return ordered_sessions(rows)


def render_sessions(rows: DataFrame) -> DataFrame:
    """conv_id, session, path, markdown, ranges (dia_id, line_start, line_end of each turn) of sessions.

    Three levels of headings: conversation, session with its time, turn with its speaker;
    an image's query and caption are a line of the turn's text.
    """
    title = F.format_string("# conversation %02d", "conv_id")
    name = F.format_string("## session %02d | timestamp: %s", "session", "session_date")

    def text(t: Column) -> Column:
        query, caption, own = _clean(t["query"]), _clean(t["blip_caption"]), _clean(t["text"])
        image = F.concat(F.lit("[image query: "), query, F.lit("; caption: "), caption, F.lit("]"))
        gap = F.when((own != "") & ~own.endswith("\n"), "\n").otherwise("")
        return F.when((query != "") | (caption != ""), F.concat(own, gap, image)).otherwise(own)

    def turn(t: Column) -> Column:
        date = _clean(t["session_date_time"])
        head = F.concat(F.lit("### turn "), _clean(t["dia_id"]), F.lit(" | speaker: "), _clean(t["speaker"]), F.lit(" | timestamp: "), F.when(date != "", date).otherwise(F.col("session_date")))
        return F.struct(_clean(t["dia_id"]).alias("dia_id"), head.alias("head"), text(t).alias("text"))

    made = rows.withColumn("made", F.transform("turns", turn))
    # a turn's block: heading, blank line, text; a blank line follows every block
    bodies = F.transform("made", lambda m: F.concat(m["head"], F.lit("\n\n"), m["text"]))
    markdown = F.concat(F.array_join(F.concat(F.array(title, name), bodies), "\n\n"), F.lit("\n"))
    lines = F.transform("made", lambda m: F.size(F.split(F.concat(m["head"], F.lit("\n\n"), m["text"]), "\n")))
    before = F.size(F.split(name, "\n")) + 4
    made = made.withColumn("n", lines)

    def place(m: Column, i: Column) -> Column:
        start = before + F.aggregate(F.slice("n", F.lit(1), i), F.lit(0), lambda s, x: s + x + 1)
        return F.struct(m["dia_id"].alias("dia_id"), start.alias("line_start"), (start + F.element_at("n", i + 1) - 1).alias("line_end"))

    path = F.format_string("conversation-%02d--session-%02d.md", "conv_id", "session")
    return made.select("conv_id", "session", "place", path.alias("path"), markdown.alias("markdown"), F.transform("made", place).alias("ranges"))


def question_targets(conversations: DataFrame, rendered: DataFrame) -> DataFrame:
    """question_id, conv_id, question, category, path, line_start, line_end, evidence_id of the evidence of answerable questions.

    A turn's name stands for its last session; unknown names are dropped, repeated ones
    stay. Questions of one text within a conversation share the evidence of the last.
    """
    turns = rendered.select("conv_id", "place", "path", F.posexplode("ranges").alias("at", "r"))
    known = turns.groupBy("conv_id", F.col("r.dia_id").alias("dia_id")).agg(F.max_by(F.struct("path", "r.line_start", "r.line_end"), F.struct("place", "at")).alias("t"))
    own = questions(conversations)
    same = Window.partitionBy("conv", "question")
    own = own.withColumn("evidence", F.max_by("evidence", "n").over(same))
    refs = own.select("question_id", F.col("conv").alias("conv_id"), "question", "category", F.explode("evidence").alias("dia_id"))
    rows = refs.join(known, ["conv_id", "dia_id"]).select("question_id", "conv_id", "question", "category", "t.*")
    return rows.withColumn("evidence_id", evidence_id(F.col("path"), F.col("line_start"), F.col("line_end")))


def evidence_text(targets: DataFrame, rendered: DataFrame) -> DataFrame:
    """question_id, evidence: the lines of each question's evidence, by evidence id."""
    rows = targets.join(rendered.select("path", "markdown"), "path")
    lines = F.array_join(F.slice(F.split("markdown", "\n"), F.col("line_start"), F.col("line_end") - F.col("line_start") + 1), "\n")
    parts = rows.select("question_id", F.struct("evidence_id", lines.alias("lines")).alias("p"))
    return parts.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["lines"]), "\n").alias("evidence"))


def turn_lines(turns: DataFrame) -> DataFrame:
    """turns: conv_id, turn, role, text -> with line_start, line_end (1-based) in the rendered note.

    A note begins with its title, a blank line, the session heading and a blank line; each
    turn has a heading, its lines and a blank line.
    """
    n = F.size(F.split("text", "\n")).cast("long")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.withColumn("n_lines", n)
    start = F.lit(5) + F.coalesce(F.sum(F.col("n_lines") + 2).over(before), F.lit(0))
    return rows.withColumn("line_start", start.cast("long")).withColumn("line_end", (F.col("line_start") + F.col("n_lines")).cast("long"))


def path_of(c: Column) -> Column:
    return F.format_string("conv/%08d.md", c)


def render(turns: DataFrame) -> DataFrame:
    """conv_id, path, markdown: a note for each conversation (turns are of one conversation, so a group is one note)."""
    turn = F.struct("turn", F.concat_ws("\n", F.concat(F.lit("### "), F.col("role"), F.lit(" "), F.col("turn")), F.col("text")).alias("body"))
    notes = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    head = F.concat(F.lit("# Conversation "), F.col("conv_id"), F.lit("\n\n## Session 1\n\n"))
    body = F.array_join(F.transform("turns", lambda t: t["body"]), "\n\n")
    return notes.select("conv_id", path_of(F.col("conv_id")).alias("path"), F.concat(head, body, F.lit("\n")).alias("markdown"))


def sections(turns: DataFrame) -> DataFrame:
    """The sections that splitting the rendered notes gives, one for each turn, without a parser."""
    lines = turn_lines(turns)
    path = path_of(F.col("conv_id"))
    return lines.select(
        F.concat_ws("-", "conv_id", "turn").alias("section_id"),
        path.alias("path"),
        F.col("role").alias("root_id"),
        F.concat_ws(" ", "role", "turn").alias("heading"),
        F.array(F.concat(F.lit("Conversation "), F.col("conv_id")), F.lit("Session 1"), F.concat_ws(" ", "role", "turn")).alias("heading_path"),
        "text",
        "line_start",
        "line_end",
        F.sha2("text", 256).alias("content_hash"),
    )


def evidence_targets(references: DataFrame, turns: DataFrame) -> DataFrame:
    """references: question_id, conv_id, turn -> question_id, path, line range and evidence id; unknown turns are dropped."""
    lines = turn_lines(turns).select("conv_id", "turn", "line_start", "line_end")
    rows = references.join(lines, ["conv_id", "turn"]).withColumn("path", path_of(F.col("conv_id")))
    return rows.select("question_id", "path", "line_start", "line_end", evidence_id(F.col("path"), F.col("line_start"), F.col("line_end")).alias("evidence_id"))


def questions(conversations: DataFrame, adversarial: bool = False) -> DataFrame:
    """conversations: conv, qa array of (question, answer, category, evidence) -> a row for each question of the wanted categories."""
    rows = conversations.select("conv", F.posexplode("qa").alias("n", "q")).select("conv", "n", "q.*")
    wanted = F.col("category") == 5 if adversarial else F.col("category").between(1, 4)
    return rows.filter(wanted).withColumn("question_id", F.format_string("conv%d_q%d", "conv", "n"))


def reference_date(sessions: DataFrame) -> DataFrame:
    """conv_id and the date of its last session in order."""
    return ordered_sessions(sessions).groupBy("conv_id").agg(F.max_by("session_date", "place").alias("reference_date"))
