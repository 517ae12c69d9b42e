"""Outcomes of a survey and draws from a corpus: orders stand in for candidates, customers for planted loci."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusframe.functions import stats
from locusframe.plans import outcomes
from locusframe.sources import corpus, text

from . import statistics
from .base import registry, rounded, table, texts

QUERIES, ORACLES, query = registry()

_C = """WITH c AS (SELECT o_orderkey AS candidate_id, o_custkey AS anchor, o_orderpriority AS signature, CASE o_orderstatus WHEN 'F' THEN 'promote' WHEN 'O' THEN 'hold' ELSE 'eliminate' END AS disposition, o_totalprice AS priority,
list_filter([CASE WHEN o_totalprice < 1000 THEN 'significance' END, CASE WHEN o_orderpriority LIKE '5%' THEN 'novelty' END], lambda x: x IS NOT NULL) AS gates FROM orders),
t AS (SELECT c_custkey AS anchor, CASE WHEN c_acctbal < 0 THEN 'decoy:' ELSE '' END || c_mktsegment AS system_id, c_acctbal >= 0 AND c_mktsegment = 'BUILDING' AS is_novel, CASE WHEN c_acctbal < 0 THEN c_mktsegment ELSE '' END AS kill_reason FROM customer WHERE c_nationkey < 20)"""


def _candidates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("candidate_id"), F.col("o_custkey").alias("anchor_protein"), F.col("o_orderpriority").alias("group_signature"), F.lit("").alias("core_architecture"))


def _verdicts(spark, sf_dir):
    disposition = F.when(F.col("o_orderstatus") == "F", "promote").when(F.col("o_orderstatus") == "O", "hold").otherwise("eliminate")
    gates = F.array_compact(F.array(F.when(F.col("o_totalprice") < 1000, "significance"), F.when(F.startswith("o_orderpriority", F.lit("5")), "novelty")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("candidate_id"), disposition.alias("disposition"), F.col("o_totalprice").alias("priority"), gates.alias("failed_gates"))


def _truth(spark, sf_dir):
    """Customers of twenty nations as planted loci; the others' orders have an anchor that was not planted."""
    decoy = F.col("c_acctbal") < 0
    rows = table(spark, sf_dir, "customer").where("c_nationkey < 20")
    return rows.select(F.col("c_custkey").alias("anchor_gene"), F.concat(F.when(decoy, "decoy:").otherwise(""), "c_mktsegment").alias("system_id"), (~decoy & (F.col("c_mktsegment") == "BUILDING")).alias("is_novel"), F.when(decoy, F.col("c_mktsegment")).otherwise("").alias("kill_reason"))


@query(f"""{_C}, p AS (SELECT * FROM c WHERE disposition = 'promote'), l AS (SELECT signature, arg_min(candidate_id, (-priority, candidate_id)) AS lead, count(*) AS n FROM p GROUP BY 1)
SELECT signature, candidate_id, lead, CASE WHEN candidate_id = lead THEN 'lead' ELSE 'supporting' END AS role, priority, n FROM p JOIN l USING (signature)""")
def bench_packages(spark, sf_dir):
    return outcomes.bench_packages(_candidates(spark, sf_dir), _verdicts(spark, sf_dir))


@query(f"""{_C} SELECT system_id, CASE WHEN starts_with(system_id, 'decoy:') THEN 'decoy' WHEN bool_or(is_novel) THEN 'novel' ELSE 'described' END AS kind, count(DISTINCT t.anchor) AS planted, count(candidate_id) AS reached,
coalesce(sum((disposition = 'promote')::int), 0)::bigint AS promoted, min(kill_reason) AS kill_reason, (count(candidate_id) - coalesce(sum((disposition = 'promote')::int), 0))::bigint AS killed FROM t LEFT JOIN c ON t.anchor = c.anchor GROUP BY system_id""")
def system_scores(spark, sf_dir):
    return outcomes.system_scores(_truth(spark, sf_dir), _candidates(spark, sf_dir), _verdicts(spark, sf_dir))


@query(f"""{_C} SELECT system_id, gate, count(*) AS n FROM (SELECT system_id, unnest(gates) AS gate FROM t JOIN c USING (anchor) WHERE starts_with(system_id, 'decoy:')) GROUP BY ALL""")
def gates_by_system(spark, sf_dir):
    return outcomes.gates_by_system(_truth(spark, sf_dir), _candidates(spark, sf_dir), _verdicts(spark, sf_dir))


@query(f"""{_C} SELECT candidate_id, system_id FROM c LEFT JOIN t USING (anchor) WHERE disposition = 'promote' AND (system_id IS NULL OR NOT (is_novel OR starts_with(system_id, 'decoy:')))""")
def unexplained_promotions(spark, sf_dir):
    return outcomes.unexplained(_truth(spark, sf_dir), _candidates(spark, sf_dir), _verdicts(spark, sf_dir))


@query(f"""WITH m AS ({statistics._LONG}), r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS avg_rank FROM m),
s AS (SELECT feature, sum(avg_rank) FILTER (positive) AS ranks, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n, avg(value) FILTER (positive) AS mp, avg(value) FILTER (NOT positive) AS mn, bool_and(value IN (0, 1)) AS b FROM r GROUP BY 1)
SELECT feature, round((ranks - p * (p + 1) / 2.0) / (p * n), 4) AS auroc, p AS n_promoted, n AS n_set_aside, round(mp, 4) AS mean_promoted, round(mn, 4) AS mean_set_aside, CASE WHEN b THEN 'boolean' ELSE 'numeric' END AS kind, feature = 'n_chars' AS in_rubric FROM s WHERE p >= 2 AND n >= 2""")
def metric_separation(spark, sf_dir):
    long = statistics.document_metrics(spark, sf_dir)
    wide = long.groupBy("doc_id", F.col("positive").alias("promoted")).pivot("feature", list(statistics._METRICS)).agg(F.first("value"))
    out = outcomes.separation(wide, list(statistics._METRICS), ["n_chars"])
    return out.select("feature", *[rounded(F.col(c), 4).alias(c) for c in ("auroc", "mean_promoted", "mean_set_aside")], "n_promoted", "n_set_aside", "kind", "in_rubric")


@query("""SELECT doc_id, score::int AS score FROM (SELECT doc_id, (contains(b, 'that'))::int + (contains(b, 'and'))::int + (contains(b, 'heron'))::int AS score FROM (SELECT doc_id, lower(coalesce(text, '') || ' ' || coalesce(source, '')) AS b FROM documents)) ORDER BY score DESC, doc_id LIMIT 10""")
def literature_search(spark, sf_dir):
    """The ten documents with the most words of a question."""
    papers = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.coalesce("text", F.lit("")).alias("title"), F.coalesce("source", F.lit("")).alias("claims"), F.lit(None).cast("string").alias("observable"))
    return text.literature(papers, "that and of heron").select(F.col("paper_id").alias("doc_id"), "score")


@query("SELECT event_id FROM events ORDER BY md5('7|' || event_id), event_id LIMIT 250")
def random_loci(spark, sf_dir):
    """A draw of 250 anchors that every run repeats: the operator's own limit."""
    return corpus.drawn(table(spark, sf_dir, "events").select("event_id"), "event_id", 7, 250)


@query("""WITH m AS (SELECT lang AS family, doc_id, coalesce(text, '') AS s, row_number() OVER (PARTITION BY lang ORDER BY length(coalesce(text, '')), doc_id) - 1 AS place FROM documents)
SELECT family, doc_id::varchar AS member, length(s) AS n FROM m WHERE place % 50 = 0 AND place / 50 < 19 UNION ALL SELECT 'benchmark', 'reference', length(text) FROM benchmark WHERE item_id = 0""")
def family_seed(spark, sf_dir):
    """Every fiftieth document of a language by length, twenty members a family at most, the described one included."""
    members = texts(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select(F.col("lang").alias("family"), F.col("doc_id").alias("member"), F.col("text").alias("sequence"))
    reference = texts(spark, sf_dir, "benchmark", "item_id").where("item_id = 0").select(F.lit("benchmark").alias("family"), F.col("text").alias("sequence"))
    return corpus.family_seed(reference, members, 50, 20).select("family", "member", F.length("sequence").cast("long").alias("n"))


@query("""SELECT l_linenumber, l_discount, round(CASE WHEN l_discount <= 1e-300 THEN 300.0 ELSE -log10(l_discount) END, 6) AS neglog, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def neglog_transform(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_linenumber", "l_discount").agg(F.count("*").alias("n"))
    return rows.select("l_linenumber", "l_discount", rounded(stats.neglog(F.col("l_discount"))).alias("neglog"), "n")


@query(f"""{statistics._PER_USER} SELECT user_id, round(lgamma(a + b + 1.0) - lgamma(a + 1.0) - lgamma(b + 1.0) + lgamma(c + d + 1.0) - lgamma(c + 1.0) - lgamma(d + 1.0) - lgamma(a + b + c + d + 1.0) + lgamma(a + c + 1.0) + lgamma(b + d + 1.0), 5) AS log_p FROM f""")
def log_hypergeometric(spark, sf_dir):
    a, b, c, d = (F.col(x) for x in "abcd")
    t = statistics._user_tables(spark, sf_dir)
    return t.select("user_id", rounded(stats.log_hypergeometric(a, a + b, a + c, a + b + c + d), 5).alias("log_p"))


@query("""SELECT fingerprint, session_id, output, mismatch FROM (SELECT substr(md5(coalesce(s.text, '')), 1, 16) AS fingerprint, s.conv_id * 100000 + s.turn AS session_id FROM conversations s) s
LEFT JOIN (SELECT conv_id * 100000 + turn AS session_id, substr(md5(coalesce(text, '')), 1, 16) AS own_print, role AS own FROM conversations WHERE role = 'user') r USING (session_id)
LEFT JOIN (SELECT substr(md5(coalesce(text, '')), 1, 16) AS fingerprint, arg_min(role, conv_id * 100000 + turn) AS other FROM conversations WHERE role = 'user' GROUP BY 1) q USING (fingerprint),
LATERAL (SELECT CASE WHEN own_print = fingerprint THEN own ELSE other END AS output, own_print IS NOT NULL AND own_print <> fingerprint AS mismatch)""")
def replayed_sessions(spark, sf_dir):
    """Turns with the recorded role of their id, or else of a user's turn of the same text."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("session_id"), F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 16).alias("fingerprint"), F.col("role").alias("output"))
    return outcomes.replayed(rows.drop("output"), rows.where("output = 'user'")).select("fingerprint", "session_id", "output", F.coalesce("mismatch", F.lit(False)).alias("mismatch"))
