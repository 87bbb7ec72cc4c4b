"""Text, vector and statistics functions, the query compiler, word pieces."""

import math
import pickle
import random
import time
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandex.functions import text, vectors
from strandex.functions.stats import headroom, latency_summary, nearest_rank, score_summary
from strandex.functions.wordpiece import WordPiece
from strandex.plans.query import Root, Synonyms, candidate_bound, compile_query, content_terms, guard_atoms, index_words, query_variants, required_terms, resolve_scope


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_folding():
    assert text.fold("  Café STRASSE\tß ") == "café strasse ss"
    assert index_words("Crème_brûlée, PAUS-12") == ("creme", "brulee", "paus", "12")


def test_columns_of_text(spark):
    long = "ab " * 300
    assert one(spark, text.excerpt(F.lit(" a\n b c "))) == "a b c"
    assert one(spark, text.excerpt(F.lit(long))) == long[:500].rstrip() + "..."
    assert one(spark, text.excerpt(F.lit(None).cast("string"))) is None
    assert one(spark, text.links(F.lit("[a](x.md) [[n|N]] and [b](x.md 't') [[ m ]]"))) == ["x.md", "n", " m "]
    assert one(spark, text.identifiers(F.lit("See ABC-12, abc-12 and X1-3 or 1A-2"))) == ["abc-12", "x1-3", "a-2"]
    assert one(spark, text.answer(F.lit("so ANSWER: no. ANSWER:  yes "))) == "yes"
    assert one(spark, text.evidence_id(F.lit("a\\b.md"), F.lit(5), F.lit(7))) == "a/b.md#00000005-00000007"
    assert one(spark, text.content_terms(text.query_tokens(F.lit("what is the plan of plan b-2")))) == ["plan", "b-2"]


def test_cut_bytes():
    assert text.cut_bytes("abc", 3) == "abc"
    assert text.cut_bytes("é" * 20, 19) == "ééé\n[truncated]"
    assert text.cut_bytes("word   more than fits", 17) == "word\n[truncated]"
    assert text.cut_bytes("long enough", 4) == "\n[tr"


@given(st.text(max_size=60), st.integers(1, 40))
@settings(max_examples=200, deadline=None)
def test_cut_bytes_never_exceeds(t, n):
    assert len(text.cut_bytes(t, n).encode()) <= n


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(i)).cast("float") for i in x])
    assert one(spark, vectors.is_valid(v(1, 2), 2)) and not one(spark, vectors.is_valid(v(1, 2), 3))
    assert not one(spark, vectors.is_valid(v(1, math.nan), 2)) and not one(spark, vectors.is_valid(v(1, math.inf), 2))
    assert not one(spark, vectors.is_valid(F.lit(None).cast("array<float>"), 2))
    assert one(spark, vectors.dot(vectors.normalised(v(3, 4)), v(3, 4))) == pytest.approx(5)
    for bad in ([], [0.0, 0.0], [math.nan]):
        with pytest.raises(ValueError):
            vectors.unit(bad)
    assert vectors.unpack(vectors.pack([1.5, -2.0]), 2) == [1.5, -2.0]
    with pytest.raises(ValueError):
        vectors.unpack(b"1234", 2)


def test_percentiles_are_nearest_ranks(spark):
    for n in (1, 2, 3, 7, 20, 59):
        values = [float(k * k % 61) for k in range(n)]
        df = spark.createDataFrame([(v,) for v in values], "x double")
        for q in (0.5, 0.95):
            assert df.agg(nearest_rank(q, "x")).first()[0] == sorted(values)[max(0, math.ceil(q * n) - 1)]
    empty = spark.createDataFrame([], "x double")
    assert tuple(empty.agg(*latency_summary("x")).first()) == (0, 0.0, 0.0, 0.0)
    four = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double").agg(*score_summary("x")).first()
    assert (four["p50"], four["p95"], four["mean"]) == (2.0, 4.0, 2.5)
    assert headroom(100, 300) == {"value": 100, "limit": 300, "passed": True, "headroom": 3}


def test_compiler():
    assert compile_query('alpha "cold path" PAUS-12').clauses == (("alpha",), ("cold", "path"), ("paus", "12"))
    assert compile_query('an "open quote').clauses == (("an",), ("open",), ("quote",))
    assert compile_query('" * ( NEAR').clauses == (("near",),)
    assert compile_query("...").empty
    many = compile_query(" ".join(f"w{n}" for n in range(100_000)))
    assert len(many.tokens) == 64
    assert content_terms(["What", "Plan", "plan", "PAUS-1"]) == ["plan", "paus-1"]
    assert [required_terms(n) for n in (1, 2, 3, 4, 5, 7)] == [1, 2, 2, 2, 3, 4]


def test_guard_atoms():
    assert guard_atoms('Why did  PAUS-4\tbeat "  Cold Path "?') == ["paus-4", "cold path"]
    assert guard_atoms('"PAUS-4 x" plain') == ["paus-4 x"] and guard_atoms('"" plain') == []


def test_synonyms():
    table = Synonyms.from_terms(1, {"database": ["db", "sql"]})
    assert query_variants('database "database" PAUS-11', table) == ['db "database" paus-11', 'sql "database" paus-11']
    assert query_variants("other", table) == []
    assert table.fingerprint == Synonyms.from_terms(1, {"database": ["sql", "db"]}).fingerprint
    for version, terms in ((0, {}), (1, {"a": []}), (1, {"a": ["b", "c", "d", "e", "f"]}), (1, {"a b": ["c"]}), (1, {"a": ["b"], "b": ["c"]}), (1, {"a": ["x-1"]}), (1, {f"t{n}": [f"u{n}"] for n in range(129)})):
        with pytest.raises(ValueError):
            Synonyms.from_terms(version, terms)
    big = Synonyms.from_terms(1, {f"w{n}": [f"{x}{n}" for x in "abcd"] for n in range(9)})
    assert len(query_variants(" ".join(f"w{n}" for n in range(9)), big)) == 16


def test_scope():
    roots = [Root("a", "p"), Root("b", "p"), Root("c", "q")]
    assert resolve_scope(roots, ["g"]) == resolve_scope(roots, ["g"], project=None) and resolve_scope(roots, ["g"]).roots == ()
    assert resolve_scope(roots, [], project="p").roots == ("a", "b")
    assert resolve_scope(roots, [], root_id="b").roots == ("b",)
    assert resolve_scope(roots, [], project="p", root_id="c").roots == ()
    assert resolve_scope(roots, ["g"], root_id="nowhere").empty
    assert resolve_scope(roots, [], all_projects=True).roots == ("a", "b", "c")
    assert [candidate_bound(n) for n in (1, 10, 20, 500)] == [50, 50, 100, 200]
    with pytest.raises(ValueError):
        candidate_bound(0)


def test_word_pieces():
    vocab = {t: n for n, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "!", "cafe", "漢", "[MASK]"])}
    tok = WordPiece(vocab, length=8)
    assert tok.encode("Unaffable!") == [2, 4, 5, 6, 7, 3]
    assert tok.encode("Café 漢 xyz") == [2, 8, 9, 1, 3]
    assert tok.encode("un[MASK]un") == [2, 4, 10, 4, 3]
    assert tok.encode("un " * 20) == [2, *[4] * 6, 3]
    assert WordPiece(vocab, length=4, keep="right").encode("un un !") == [2, 4, 7, 3]
    assert tok.encode("x" * 101) == [2, 1, 3] and tok.encode("\x00\x07") == [2, 3]


def test_word_pieces_by_the_rules_and_in_linear_time():
    def pieces(tok, word):
        if len(word) > tok.longest:
            return [1]
        out, at = [], 0
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in tok.vocabulary), None)
            if end is None:
                return [1]
            out.append(tok.vocabulary[("##" if at else "") + word[at:end]])
            at = end
        return out

    letters = list("abcde")
    short = {t: n for n, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", *letters, *[f"##{x}" for x in letters], "!", "漢"])}
    vocabularies = [short, short | {"abc": 50, "##bcd": 51, "[SEP][SEP]": 52, "σς": 53}]
    bits = [*letters, "A", "É", "Σ", "漢", "!", ".", " ", "\n", "\x1c", "\x85", " ", "­", "́", "[SEP]", "[PAD]", "[", "a" * 101]
    rnd = random.Random(3)
    for vocabulary in vocabularies:
        tok = WordPiece(vocabulary, length=100_000)
        for _ in range(2000):
            text = "".join(rnd.choices(bits, k=rnd.randint(0, 12)))
            want, rest = [], text
            while rest:
                at, _, found = min(((i, -len(t), t) for t in tok.special if (i := rest.find(t)) >= 0), default=(len(rest), 0, ""))
                clean = "".join(f" {c} " if c == "漢" else c for c in rest[:at] if c in "\n" or unicodedata.category(c) not in ("Cc", "Cf"))
                clean = "".join(c for c in unicodedata.normalize("NFD", clean) if unicodedata.category(c) != "Mn").lower()
                for w in "".join(f" {c} " if c in "!.[]" else c for c in clean).split():
                    want += pieces(tok, w)
                want += [vocabulary[found]] if found else []
                rest = rest[at + len(found) :]
            assert tok.body(text) == want, text
            assert pickle.loads(pickle.dumps(tok)).body(text) == want
    began = time.process_time()
    assert len(WordPiece(short).body("[SEP]" * 60_000)) == 60_000  # each of them was a search through all that follows
    assert time.process_time() - began < 5
