"""Exact tests, false-discovery control, ranks, spread and agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusframe.functions import spread, stats
from locusframe.operators import locus

from . import loci
from .base import registry, rounded, table

QUERIES, ORACLES, query = registry()

_CHOOSE = "(lgamma({0} + 1.0) - lgamma({1} + 1.0) - lgamma({0} - {1} + 1.0))"
_TAIL = (
    "list_sum(list_transform(range(a::bigint, least(a + b, a + c)::bigint + 1), lambda k: exp("
    + _CHOOSE.format("(a + b)", "k") + " + " + _CHOOSE.format("(c + d)", "(a + c - k)") + " - " + _CHOOSE.format("(a + b + c + d)", "(a + c)") + ")))"
)
_PER_USER = """WITH e AS (SELECT user_id, event_type = 'purchase' AS hit, value > 50 AS high FROM events), t AS (SELECT sum((hit AND high)::int) AS ta, sum((hit AND NOT high)::int) AS tb, sum((NOT hit AND high)::int) AS tc, sum((NOT hit AND NOT high)::int) AS td FROM e),
u AS (SELECT user_id, sum((high)::int)::bigint AS a, sum((NOT high)::int)::bigint AS b FROM e GROUP BY 1), n AS (SELECT sum(a)::bigint AS sa, sum(b)::bigint AS sb FROM u), f AS (SELECT user_id, a, b, sa - a AS c, sb - b AS d FROM u, n)"""


def _user_tables(spark, sf_dir):
    """Each user's high and low events against all others'."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum((F.col("value") > 50).cast("long")).alias("a"), F.sum((~(F.col("value") > 50)).cast("long")).alias("b"))
    total = e.agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    return e.crossJoin(F.broadcast(total)).select("user_id", "a", "b", (F.col("sa") - F.col("a")).alias("c"), (F.col("sb") - F.col("b")).alias("d"))  # one row


@query(f"""{_PER_USER} SELECT user_id, a, b, c::bigint AS c, d::bigint AS d, round(least(1.0, {_TAIL}), 6) AS p_value, round((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))::double, 6) AS odds FROM f""")
def fisher_exact(spark, sf_dir):
    t = _user_tables(spark, sf_dir)
    cells = [F.col(x) for x in "abcd"]
    return t.select("user_id", *"abcd", rounded(stats.fisher_p(*cells)).alias("p_value"), rounded(stats.odds_ratio(*cells)).alias("odds"))


@query(f"""{_PER_USER}, p AS (SELECT user_id, round(least(1.0, {_TAIL}), 9) AS p FROM f), r AS (SELECT *, row_number() OVER (ORDER BY p, user_id) AS rank, count(*) OVER () AS n FROM p),
m AS (SELECT *, max(CASE WHEN p <= 0.2 * rank / n THEN rank END) OVER () AS last FROM r) SELECT user_id, coalesce(rank <= last, false) AS rejected FROM m""")
def benjamini_hochberg_flags(spark, sf_dir):
    t = _user_tables(spark, sf_dir)
    p = t.select("user_id", F.round(stats.fisher_p(*[F.col(x) for x in "abcd"]), 9).alias("p"))
    return stats.benjamini_hochberg(p, "p", alpha=0.2).select("user_id", "rejected")


@query(f"""WITH cand AS ({loci._l(loci.ANCHOR)} SELECT * FROM around), back AS ({loci._l(loci.BACKGROUND)} SELECT * FROM around),
one AS (SELECT contig_id, anchor_id, list(DISTINCT label) FILTER (in_operon AND off <> 0) AS labels FROM cand GROUP BY ALL), n1 AS (SELECT count(*) AS n FROM one), c1 AS (SELECT unnest(labels) AS label, count(*) AS k FROM one GROUP BY 1),
two AS (SELECT contig_id, anchor_id, list(DISTINCT label) FILTER (in_operon AND off <> 0) AS labels FROM back GROUP BY ALL), n2 AS (SELECT count(*) AS n FROM two), c2 AS (SELECT unnest(labels) AS label, count(*) AS k FROM two GROUP BY 1),
f AS (SELECT c1.label, c1.k AS a, n1.n - c1.k AS b, coalesce(c2.k, 0) AS c, n2.n - coalesce(c2.k, 0) AS d FROM c1 LEFT JOIN c2 USING (label), n1, n2)
SELECT label, a, b, c, d, round(least(1.0, {_TAIL}), 6) AS p_value FROM f""")
def neighbour_enrichment(spark, sf_dir):
    """Labels next to purchases against labels next to signups."""
    located = loci._loci(spark, sf_dir, loci.ANCHOR, loci.BACKGROUND).withColumn("of", F.col("anchor.label"))
    seen = locus.conservation(located, ["of"]).groupBy("label").agg(*[F.sum(F.when(F.col("of") == anchor, F.col("n_loci"))).alias(c) for anchor, c in ((loci.ANCHOR, "a"), (loci.BACKGROUND, "c0"))])
    n = loci.genes(spark, sf_dir).agg(*[F.sum((F.col("label") == anchor).cast("long")).alias(c) for anchor, c in ((loci.ANCHOR, "n1"), (loci.BACKGROUND, "n2"))])
    both = seen.where("a is not null").crossJoin(F.broadcast(n))  # one row
    t = both.select("label", "a", (F.col("n1") - F.col("a")).alias("b"), F.coalesce("c0", F.lit(0)).alias("c"), (F.col("n2") - F.coalesce("c0", F.lit(0))).alias("d"))
    return t.select("*", rounded(stats.fisher_p(*[F.col(x) for x in "abcd"])).alias("p_value"))


_METRICS = {
    "n_chars": "length(text)",
    "n_lines": "length(text) - length(replace(text, '\n', ''))",
    "share_digits": "length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(text), 1)",
    "share_letters": "length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / greatest(length(text), 1)",
}


def document_metrics(spark, sf_dir):
    """doc_id, positive (rated good), feature and value of the rated documents, a row a feature."""
    text = F.coalesce("text", F.lit(""))
    n = F.length(text)
    of = {
        "n_chars": n,
        "n_lines": n - F.length(F.replace(text, F.lit("\n"), F.lit(""))),
        "share_digits": F.length(F.regexp_replace(text, "[^0-9]", "")) / F.greatest(n, F.lit(1)),
        "share_letters": F.length(F.regexp_replace(text, "[^A-Za-z]", "")) / F.greatest(n, F.lit(1)),
    }
    wide = table(spark, sf_dir, "documents").select("doc_id", *[c.cast("double").alias(k) for k, c in of.items()])
    rated = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("positive"))
    return wide.join(rated, "doc_id").unpivot(["doc_id", "positive"], list(of), "feature", "value")


_LONG = " UNION ALL ".join(f"SELECT d.doc_id, quality = 1 AS positive, '{k}' AS feature, ({v})::double AS value FROM documents d JOIN labels USING (doc_id)" for k, v in _METRICS.items())


@query(f"""WITH m AS ({_LONG}), r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS avg_rank FROM m),
s AS (SELECT feature, sum(avg_rank) FILTER (positive) AS ranks, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n FROM r GROUP BY 1)
SELECT feature, round((ranks - p * (p + 1) / 2.0) / (p * n), 6) AS auroc, p AS n_positive, n AS n_negative FROM s""")
def auroc_features(spark, sf_dir):
    out = stats.auroc(document_metrics(spark, sf_dir), "feature", "value", "positive")
    return out.withColumn("auroc", rounded(F.col("auroc")))


_SHUFFLES = 100


@query(f"""WITH l AS (SELECT l_returnflag AS flag, l_quantity AS q, md5(l_orderkey || '-' || l_partkey || '-' || l_linenumber) AS h FROM lineitem), o AS (SELECT flag, avg(q) AS observed FROM l GROUP BY 1),
n AS (SELECT flag, substr(h, 1, 2) AS draw, avg(q) AS null_value FROM l GROUP BY 1, 2)
SELECT flag, round(any_value(observed), 6) AS observed, round(avg(null_value), 6) AS null_mean, round(stddev_pop(null_value), 6) AS null_sd, round((sum((null_value >= observed)::int) + 1) / (count(*) + 1), 6) AS p_value, count(*) AS n FROM n JOIN o USING (flag) GROUP BY flag""")
def permutation_test(spark, sf_dir):
    """Each flag's mean quantity against its means in draws by a hash."""
    own = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("q"), F.substring(F.md5(F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber")), 1, 2).alias("draw"))
    drawn = own.groupBy("flag", "draw").agg(F.sum("q").alias("s"), F.count("q").alias("k"))
    observed = drawn.groupBy("flag").agg((F.sum("s") / F.sum("k")).alias("observed"))
    out = stats.permutation_p(drawn.select("flag", (F.col("s") / F.col("k")).alias("null_value")).join(observed, "flag"), ["flag"], "observed", "null_value")
    return out.select("flag", *[rounded(F.col(c)).alias(c) for c in ("observed", "null_mean", "null_sd", "p_value")], "n")


@query("""WITH l AS (SELECT c_mktsegment AS segment, r_name AS phylum, 'root;' || r_name || ';' || n_name AS lineage FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
p AS (SELECT segment, phylum, count(*) AS n, count(DISTINCT lineage) AS taxa FROM l GROUP BY 1, 2)
SELECT segment, sum(n)::bigint AS n_sequences, sum(taxa)::bigint AS n_taxa, count(*) AS n_phyla, round(max(n) / sum(n), 6) AS largest_fraction, max(n) / sum(n) > 0.8 OR count(*) <= 1 AS clade_restricted FROM p GROUP BY 1""")
def taxonomic_spread(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("segment"), F.concat_ws(";", F.lit("root"), "r_name", "n_name").alias("lineage"))
    return spread.taxonomic_spread(rows, ["segment"], "lineage").withColumn("largest_fraction", rounded(F.col("largest_fraction")))


@query("""WITH e AS (SELECT lang, doc_id FROM labels JOIN documents USING (doc_id) WHERE quality = 1), r AS (SELECT lang, doc_id FROM documents WHERE n_chars >= 500)
SELECT coalesce(e.lang, r.lang) AS lang, count(e.doc_id) AS n_expected, count(r.doc_id) AS n_recovered, count(CASE WHEN e.doc_id = r.doc_id THEN 1 END) AS n_both,
round(CASE WHEN count(e.doc_id) > 0 THEN count(CASE WHEN e.doc_id = r.doc_id THEN 1 END) / count(e.doc_id) ELSE 0 END, 6) AS recall, round(CASE WHEN count(r.doc_id) > 0 THEN count(CASE WHEN e.doc_id = r.doc_id THEN 1 END) / count(r.doc_id) ELSE 0 END, 6) AS "precision"
FROM e FULL JOIN r ON e.doc_id = r.doc_id AND e.lang = r.lang GROUP BY 1""")
def recall_precision(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    expected = docs.join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id").select("lang", "doc_id")
    out = spread.recall_precision(expected, docs.where("n_chars >= 500").select("lang", "doc_id"), "doc_id", ["lang"])
    return out.withColumns({c: rounded(F.col(c)) for c in ("recall", "precision")})


@query("""SELECT 'both' AS kind, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'unrated', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT 'either', count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels) UNION ALL SELECT 'semi', count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 'anti', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def set_operations(spark, sf_dir):
    d, r = (table(spark, sf_dir, t).select("doc_id") for t in ("documents", "labels"))
    of = {"both": d.intersect(r), "unrated": d.subtract(r), "either": d.union(r).distinct(), "semi": d.join(r.distinct(), "doc_id", "left_semi"), "anti": d.join(r.distinct(), "doc_id", "left_anti")}
    out = None
    for kind, rows in of.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.union(one)
    return out
