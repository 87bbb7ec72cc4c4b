"""Queries for evaluation, reports and workloads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.stats import latency_summary, score_summary
from ..operators import evaluate, workload
from .registry import query, table

# Ranked hits and cases from the tables: a case for each order priority and customer segment of ten,
# hits are its orders by price; relevant are those of status F.

HITS = """hits AS (SELECT 'c' || (o_custkey % 60) AS case_id, row_number() OVER (PARTITION BY o_custkey % 60 ORDER BY o_totalprice DESC, o_orderkey) AS rank,
  'p' || (o_orderkey % 97) AS path, 'o' || o_orderkey AS section_id FROM orders WHERE o_custkey % 60 <> 7)"""
CASES = """cases AS (SELECT 'c' || n AS case_id, CASE WHEN n % 3 = 0 THEN 'verbatim' WHEN n % 3 = 1 THEN 'paraphrase' ELSE 'abstention' END AS category, n % 3 = 2 AS abstain, n FROM range(0, 60) t(n)),
expected AS (SELECT case_id, 'p' || ((n * 13 + k) % 97) AS path FROM cases, range(0, 12) r(k) WHERE NOT abstain),
forbidden AS (SELECT case_id, 'p' || ((n * 29 + 5) % 97) AS path FROM cases)"""


def hits(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_custkey % 60 <> 7").withColumn("case_id", F.concat(F.lit("c"), F.col("o_custkey") % 60))
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return o.select("case_id", rank.alias("rank"), F.concat(F.lit("p"), F.col("o_orderkey") % 97).alias("path"), F.concat(F.lit("o"), "o_orderkey").alias("section_id"))


def cases(spark):
    n = F.col("id")
    kind = F.when(n % 3 == 0, "verbatim").when(n % 3 == 1, "paraphrase").otherwise("abstention")
    some = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.concat(F.lit("p"), (n * 13 + k) % 97))
    expected = F.when(n % 3 != 2, some).otherwise(F.array().cast("array<string>"))
    forbidden = F.array(F.concat(F.lit("p"), (n * 29 + 5) % 97))
    return spark.range(60).select(F.concat(F.lit("c"), n).alias("case_id"), kind.alias("category"), expected.alias("expected"), forbidden.alias("forbidden"), (n % 3 == 2).alias("abstain"))


SCORES = f"""{HITS}, {CASES}, ks AS (SELECT unnest([1, 2, 4, 8]) AS k),
marked AS (SELECT c.case_id, c.category, c.abstain, ks.k, h.rank, h.path, h.rank IS NOT NULL AND h.rank <= ks.k AS seen,
    EXISTS (SELECT 1 FROM expected e WHERE e.case_id = c.case_id AND e.path = h.path) AS ok, EXISTS (SELECT 1 FROM forbidden f WHERE f.case_id = c.case_id AND f.path = h.path) AS bad
  FROM cases c CROSS JOIN ks LEFT JOIN hits h ON h.case_id = c.case_id),
got AS (SELECT case_id, category, abstain, k, count_if(seen) AS n_hits, count(DISTINCT CASE WHEN seen AND ok THEN path END) AS found, min(CASE WHEN seen AND ok THEN rank END) AS first,
    count(DISTINCT CASE WHEN seen AND bad THEN path END) AS n_forbidden FROM marked GROUP BY ALL),
scores AS (SELECT *, score >= 5e-1 AS passed FROM (SELECT case_id, category, k, abstain, n_hits, CASE WHEN NOT abstain THEN found / 12e0 END AS recall, CASE WHEN NOT abstain THEN CASE WHEN n_hits > 0 THEN found / n_hits::DOUBLE ELSE 0e0 END END AS precision,
    CASE WHEN NOT abstain THEN coalesce(1e0 / first, 0e0) END AS rr, n_forbidden,
    CASE WHEN abstain THEN (n_hits = 0 AND n_forbidden = 0)::INT::DOUBLE WHEN n_forbidden > 0 THEN 0e0 ELSE found / 12e0 END AS score,
    CASE WHEN abstain THEN n_hits = 0 AND n_forbidden = 0 ELSE found = 12 AND n_forbidden = 0 END AS complete FROM got))"""


def scores(spark, sf_dir):
    return evaluate.score_cases(hits(spark, sf_dir), cases(spark))


@query(f"WITH {SCORES} SELECT case_id, category, k, abstain, n_hits::BIGINT AS n_hits, round(recall, 6) AS recall, round(precision, 6) AS precision, round(rr, 6) AS rr, n_forbidden::BIGINT AS n_forbidden, round(score, 6) AS score, passed, complete FROM scores")
def score_cases_at_k(spark, sf_dir):
    r = lambda c: F.round(c, 6).alias(c)
    return scores(spark, sf_dir).select("case_id", "category", "k", "abstain", "n_hits", r("recall"), r("precision"), r("rr"), "n_forbidden", r("score"), "passed", "complete")


MEASURES = """count(*) AS n_cases, round(coalesce(avg(recall), 1e0), 6) AS recall, round(coalesce(avg(precision), 1e0), 6) AS precision, round(coalesce(avg(rr), 1e0), 6) AS mrr,
  round(coalesce(avg(CASE WHEN abstain THEN passed::INT END), 1e0), 6) AS abstention_accuracy, sum(n_forbidden)::BIGINT AS forbidden, round(avg(passed::INT), 6) AS accuracy, round(avg(score), 6) AS mean_score"""


@query(f"WITH {SCORES} SELECT k, category, {MEASURES} FROM scores GROUP BY GROUPING SETS ((k), (k, category))")
def gates_by_category(spark, sf_dir):
    return evaluate.gates(scores(spark, sf_dir))


@query(f"WITH {SCORES} SELECT k, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr FROM scores WHERE NOT abstain GROUP BY k")
def mrr_recall_by_cutoff(spark, sf_dir):
    return scores(spark, sf_dir).filter("NOT abstain").groupBy("k").agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"))


@query(f"""WITH {SCORES.replace("hits AS (SELECT 'c'", "hits0 AS (SELECT 'c'").replace(f", {CASES}", ", hits AS (SELECT * FROM hits0), " + CASES)},
p AS (SELECT policy, k, recall, precision, rr, passed FROM scores, (SELECT unnest(['active', 'short', 'first']) AS policy) WHERE policy = 'active' OR (policy = 'short' AND n_hits <= 4) OR (policy = 'first' AND rr >= 5e-1)),
g AS (SELECT policy, k, round(coalesce(avg(recall), 1e0), 6) AS recall, round(coalesce(avg(precision), 1e0), 6) AS precision, round(coalesce(avg(rr), 1e0), 6) AS mrr, round(avg(passed::INT), 6) AS accuracy FROM p GROUP BY ALL)
SELECT g.policy, g.k, round(g.recall - a.recall, 6) AS d_recall, round(g.precision - a.precision, 6) AS d_precision, round(g.mrr - a.mrr, 6) AS d_mrr, round(g.accuracy - a.accuracy, 6) AS d_accuracy
FROM g JOIN g a ON g.k = a.k AND a.policy = 'active' WHERE g.policy <> 'active'""")
def ablation_deltas(spark, sf_dir):
    policies = F.array(
        F.lit("active"),
        F.when(F.col("n_hits") <= 4, "short"),
        F.when(F.col("rr") >= 0.5, "first"),
    )
    rows = scores(spark, sf_dir).withColumn("policy", F.explode(F.array_compact(policies)))
    return evaluate.ablation_deltas(rows.groupBy("policy", "k").agg(*evaluate.gate_measures()))


RECORDS = """records AS (SELECT conv_id % 7 AS conv_id, conv_id AS q, count_if(turn > 2) AS n_hits, CASE WHEN conv_id % 13 = 5 THEN 'TIMEOUT' END AS error FROM conversations GROUP BY conv_id)"""


def records(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("q")).agg(F.count_if(F.col("turn") > 2).alias("n_hits"))
    return c.select((F.col("q") % 7).alias("conv_id"), "q", "n_hits", F.when(F.col("q") % 13 == 5, "TIMEOUT").alias("error"))


@query(f"""WITH {RECORDS} SELECT conv_id, count(*) AS n, count(error) AS errors, count_if(error IS NULL AND n_hits = 0)::BIGINT AS abstained,
  round(count_if(error IS NULL AND n_hits > 0) / count(*)::DOUBLE, 6) AS false_injection_rate, round(coalesce(avg(CASE WHEN error IS NULL THEN n_hits END), 0e0), 6) AS mean_hits
FROM records GROUP BY GROUPING SETS ((conv_id), ())""")
def abstention_summary(spark, sf_dir):
    return evaluate.abstention(records(spark, sf_dir))


@query(f"WITH {RECORDS} SELECT n_hits::BIGINT AS n_hits, count(*) AS n FROM records GROUP BY n_hits")
def injected_histogram(spark, sf_dir):
    return records(spark, sf_dir).groupBy("n_hits").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(value) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def score_summaries(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(*score_summary("value"))


@query("SELECT event_type, count(value) AS n, coalesce(quantile_disc(value, 0.5), 0e0) AS p50, coalesce(quantile_disc(value, 0.95), 0e0) AS p95, coalesce(max(value), 0e0) AS max FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(*latency_summary("value"))


@query("SELECT event_type AS stage, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS max, round(count(value) * 1000e0 / sum(value), 6) AS per_second FROM events GROUP BY event_type")
def phase_report(spark, sf_dir):
    return workload.phase_report(table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), "value"), "stage", "value")


@query("SELECT event_type AS mode, CASE WHEN value > 100 THEN 'fallback' ELSE 'direct' END AS state, count(*) AS n, count_if((props::JSON->>'k')::INT >= 50)::BIGINT AS fallbacks FROM events GROUP BY ALL")
def diagnostics_counts(spark, sf_dir):
    state = F.when(F.col("value") > 100, "fallback").otherwise("direct")
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("mode"), state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.count_if(k >= 50).alias("fallbacks"))


def _words() -> str:
    from ..functions.text import STOPWORDS

    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    return rf"words AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda w: length(w) >= 4 AND w NOT IN ({stop}))) AS term FROM documents)"


@query(f"WITH {_words()} SELECT term, count(DISTINCT doc_id) AS df FROM words GROUP BY term HAVING count(DISTINCT doc_id) >= 20")
def topic_words(spark, sf_dir):
    return workload.common_words(table(spark, sf_dir, "documents"), F.col("text"), 20)


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents),
p AS (SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM w)
SELECT term, count(DISTINCT doc_id) AS df FROM p GROUP BY term HAVING count(DISTINCT doc_id) >= 20""")
def topic_pairs(spark, sf_dir):
    return workload.common_pairs(table(spark, sf_dir, "documents"), F.col("text"), 20)


@query(f"""WITH {RECORDS}, m AS (SELECT round(count_if(n_hits = 0) / count(*)::DOUBLE, 6) AS zero, round(count_if(n_hits = 1) / count(*)::DOUBLE, 6) AS one,
  round(count_if(n_hits = 2) / count(*)::DOUBLE, 6) AS two, round(count_if(n_hits >= 3) / count(*)::DOUBLE, 6) AS many FROM records)
SELECT *, many >= 6e-1 AND zero <= 1e-1 AND one <= 1e-1 AS valid FROM m""")
def hit_count_mix(spark, sf_dir):
    return workload.hit_count_mix(records(spark, sf_dir))


@query(f"""WITH {HITS}, targets AS (SELECT 'c' || n AS case_id, 'p' || ((n * 13 + k) % 97) AS path, n || '/' || k AS evidence_id FROM range(0, 50) t(n), range(0, 3) r(k)),
ks AS (SELECT unnest([10, 20]) AS k), q AS (SELECT case_id FROM hits UNION SELECT case_id FROM targets),
m AS (SELECT h.case_id, h.section_id, h.rank, t.evidence_id FROM hits h JOIN targets t ON h.case_id = t.case_id AND h.path = t.path),
s AS (SELECT q.case_id, k, (SELECT count(*) FROM targets t WHERE t.case_id = q.case_id) AS nt, (SELECT count(*) FROM hits h WHERE h.case_id = q.case_id AND h.rank <= k) AS nh,
  (SELECT count(DISTINCT evidence_id) FROM m WHERE m.case_id = q.case_id AND m.rank <= k) AS nf, (SELECT count(DISTINCT section_id) FROM m WHERE m.case_id = q.case_id AND m.rank <= k) AS nm,
  (SELECT min(rank) FROM m WHERE m.case_id = q.case_id AND m.rank <= k) AS first FROM q, ks)
SELECT case_id AS question_id, k, round(CASE WHEN nt > 0 THEN nf / nt::DOUBLE ELSE 0e0 END, 6) AS recall, round(CASE WHEN nh > 0 THEN nm / nh::DOUBLE ELSE 0e0 END, 6) AS precision, round(coalesce(1e0 / first, 0e0), 6) AS mrr FROM s""")
def evidence_outcomes(spark, sf_dir):
    h = hits(spark, sf_dir).select(F.col("case_id").alias("question_id"), "rank", "path", "section_id", F.lit(1).alias("line_start"), F.lit(9).alias("line_end"))
    n = F.col("id")
    t = spark.range(50).select(n, F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    t = t.select(F.concat(F.lit("c"), n).alias("question_id"), F.concat(F.lit("p"), (n * 13 + F.col("k")) % 97).alias("path"), F.concat_ws("/", n, "k").alias("evidence_id"), F.lit(2).alias("line_start"), F.lit(3).alias("line_end"))
    r = lambda c: F.round(c, 6).alias(c)
    return evaluate.evidence_outcome(h, t, (10, 20)).select("question_id", "k", r("recall"), r("precision"), r("mrr"))


OUTCOMES = """outcomes AS (SELECT o_orderpriority AS category, k, o_orderkey % 4 AS relevant, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 4) / 4e0 END AS recall,
  CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 4) / k::DOUBLE END AS "precision", CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 3) / 2e0 END AS mrr,
  (o_custkey % 3) / 2e0 AS score, CASE WHEN o_custkey % 11 = 0 THEN 'judge_error' END AS error FROM orders, (SELECT unnest([10, 20]) AS k))"""


def outcomes(spark, sf_dir):
    """An outcome for each order and cutoff, with its priority as the category."""
    o = table(spark, sf_dir, "orders").withColumn("k", F.explode(F.array(F.lit(10), F.lit(20))))
    n = F.col("o_orderkey")
    some = lambda c: F.when(n % 5 > 0, c)
    return o.select(
        F.col("o_orderpriority").alias("category"), "k", (n % 4).alias("relevant"), some((n % 4) / 4.0).alias("recall"), some((n % 4) / F.col("k")).alias("precision"),
        some((n % 3) / 2.0).alias("mrr"), ((F.col("o_custkey") % 3) / 2.0).alias("score"), F.when(F.col("o_custkey") % 11 == 0, "judge_error").alias("error"),
    )


@query(f"""WITH {OUTCOMES} SELECT k, category, count(*) AS total, sum(relevant)::BIGINT AS relevant, round(avg(coalesce(recall, 0)), 6) AS recall, round(avg(coalesce("precision", 0)), 6) AS "precision", round(avg(coalesce(mrr, 0)), 6) AS mrr
FROM outcomes GROUP BY GROUPING SETS ((k), (k, category))""")
def retrieval_groups(spark, sf_dir):
    return evaluate.retrieval_groups(outcomes(spark, sf_dir))


@query(f"""WITH {OUTCOMES} SELECT k, category, count(*) AS total, count_if(score >= 5e-1)::BIGINT AS correct, round(100e0 * count_if(score >= 5e-1) / count(*), 6) AS accuracy, round(100e0 * avg(score), 6) AS mean_score, count(error) AS errors
FROM outcomes GROUP BY GROUPING SETS ((k), (k, category))""")
def answer_groups(spark, sf_dir):
    return evaluate.answer_groups(outcomes(spark, sf_dir))


@query("""WITH r AS (SELECT conv_id AS question_id, count_if(turn > 2) AS n_hits, CASE WHEN conv_id % 13 = 5 THEN 'timeout' WHEN conv_id % 13 = 6 THEN 'fallback' END AS reason FROM conversations GROUP BY conv_id)
SELECT question_id, k, least(n_hits, k)::BIGINT AS injected, CASE WHEN reason IS NULL THEN least(n_hits, k) = 0 END AS abstained, coalesce((reason IS NULL AND least(n_hits, k) = 0)::INT::DOUBLE, 0e0) AS score,
  CASE WHEN reason IS NOT NULL THEN 'retrieval_error' END AS error, reason FROM r, (SELECT unnest([1, 4]) AS k)""")
def abstention_outcomes(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("question_id")).agg(F.count_if(F.col("turn") > 2).alias("n_hits"))
    kind = F.col("question_id") % 13
    d = F.struct(F.when(kind == 5, "timeout").otherwise("ok").alias("status"), (kind == 6).alias("fallback"), F.lit(None).cast("string").alias("failure_reason"))
    return evaluate.abstention_outcomes(c.withColumn("diagnostics", d), (1, 4)).withColumn("injected", F.col("injected").cast("long"))


@query("""WITH h AS (SELECT 'c' || (o_custkey % 60) AS case_id, o_totalprice AS price FROM orders)
SELECT case_id, count(*) AS n, round(min(price), 6) AS min, round(max(price), 6) AS max, round(avg(price), 6) AS mean, quantile_disc(price, 0.5) AS p50, quantile_disc(price, 0.95) AS p95 FROM h GROUP BY case_id""")
def injected_score_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey") % 60).alias("case_id"), F.col("o_totalprice").alias("price"))
    return o.groupBy("case_id").agg(*score_summary("price"))
