"""The pipeline's stages on a small corpus with planted cases, and the queries' registration."""

import random

import corpus_pipeline
from strandex.llm import minhash, pii
from strandex.llm import queries as llm

SF = "/root/testdata/sf0.001"


def corpus():
    rnd = random.Random(6)
    words = {"en": "the of and worth shound thing other", "fr": "être oeuvre éçau lequel dont avec"}
    vocab = {l: [a + b for a in w.split() for b in w.split()] for l, w in words.items()}
    rows = [(n, " ".join(rnd.choice(vocab[l]) for _ in range(70)), l, f"src{n % 3}", 0) for n in range(60) for l in [("en", "fr")[n % 2]]]
    rows += [(100, rows[0][1], "en", "src1", 0), (101, rows[0][1] + " tail", "en", "src2", 0)]  # copies
    rows += [(102, "short text", "en", "src1", 0), (103, "1234 5678 !!", "en", "src1", 0), (104, None, None, None, None)]
    rows += [(105, rows[4][1] + " new words follow here so that this is another " * 3 + " write to me@corp.org now", "en", "src2", 0)]
    return rows


def test_stages(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame([(r[0], 1) for r in rows[:60]], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        kept[name] = {r.doc_id for r in docs.collect()}
        if name != "best_fit_packing":
            assert [f.simpleString() for f in docs.schema] == [f.simpleString() for f in spark.createDataFrame([], schema).schema]
            if name == "personal_data":
                text = {r.doc_id: r.text for r in docs.collect()}
    everyone = {r[0] for r in rows}
    assert kept["language_id"] == everyone - {103, 104}
    assert {102} == kept["language_id"] - kept["quality_rules"] - {105}
    assert kept["near_dedup"] == kept["quality_rules"] - {100, 101}
    assert kept["personal_data"] == kept["near_dedup"] == kept["best_fit_packing"]
    for k, t in text.items():
        assert not pii.base_spans(t)
        assert t == next(r[1] for r in rows if r[0] == k) or k == 105


def test_near_dedup_stage_uses_five_words(spark):
    """A change of the last word of ten leaves 5 of 7 five-word shingles (0.71) and 8 of 10 two-word ones (0.8)."""
    words = "one two three four five six seven eight nine ten".split()
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, " ".join(words * 6)), (4, " ".join(words * 6) + " more")]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()} == {1, 2, 3}
    assert {r.doc_id for r in minhash.near_duplicates(docs, size=2, percent=80).filter("kept").collect()} == {1}


def test_texts_are_exchanged_with_python_before_a_stage_returns(spark):
    """Small batches hold for what a stage writes itself; its result has only rows for the JVM to join."""
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(["one two three", "mail a@b.example", "four five"] * 4)], "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (corpus_pipeline.language_stage, corpus_pipeline.dedup_stage, corpus_pipeline.privacy_stage):
        plan = stage(spark, docs, "")._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" not in plan and "Python" not in plan, stage.__name__


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_every_operator_is_registered():
    names = [f"op{n}_" for n in range(1, 11)]
    assert all(sum(q.startswith(n) for q in llm.QUERIES) == 1 for n in names) and len(corpus_pipeline.STAGES) == 5
    assert set(llm.ORACLES) <= set(llm.QUERIES)


def test_language_query_on_held_out_rows(spark):
    rows = llm.QUERIES["op4_language_id"](spark, SF).filter("held_out").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.95 * len(rows) > 0
