"""Neighbourhoods: users' events stand in for genes on contigs, purchases are the anchors."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusframe.operators import locus
from locusframe.operators.locus import System

from .base import registry, rounded, table

QUERIES, ORACLES, query = registry()
NEAR, GAP, LONG, ANCHOR, BACKGROUND = 3 * 86_400, 86_400, 600, "purchase", "signup"
# The systems of this catalogue; its order breaks ties.
SYSTEMS = [
    System("browse", "browsing", ("view", "click"), optional=("error",)),
    System("failure", "failing visit", ("error",), forbidden=("signup",)),
    System("joined", "visit that joins", ("signup", "view"), forbidden=("error",), anchor_aa=(9, 9)),
]


def genes(spark, sf_dir):
    start = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("contig_id"), F.col("event_id").alias("gene_id"), start.alias("start"), (start + LONG).alias("end"), F.when(F.col("value") > 100, 1).otherwise(-1).alias("strand"),
        F.col("event_type").alias("label"), F.length("props").alias("aa_length"),
    )


def _loci(spark, sf_dir, *anchors: str):
    return locus.without_arrays(locus.with_operon(locus.loci(genes(spark, sf_dir), F.col("label").isin(*(anchors or (ANCHOR,))), NEAR), GAP))


_G = f"""WITH g0 AS (SELECT user_id AS contig_id, event_id AS gene_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + {LONG} AS e, CASE WHEN value > 100 THEN 1 ELSE -1 END AS strand, event_type AS label, length(props) AS aa FROM events),
g AS (SELECT *, row_number() OVER w AS rn, lag(e) OVER w AS pe, lead(s) OVER w AS ns, lag(strand) OVER w AS ps FROM g0 WINDOW w AS (PARTITION BY contig_id ORDER BY s, gene_id))"""


def _l(anchor: str = ANCHOR) -> str:
    """around: a row a gene of each locus with its offset and whether it is in the operon."""
    return f"""{_G}, a AS (SELECT contig_id, gene_id AS anchor_id, s AS a_s, e AS a_e, strand AS a_strand, rn AS a_rn, aa AS a_aa FROM g WHERE label = '{anchor}'),
side AS (SELECT a.*, g.gene_id, g.label, g.s, g.e, g.strand, g.pe, g.ns, g.rn - a_rn AS off, ((CASE WHEN rn < a_rn THEN a_s - e ELSE s - a_e END) <= {NEAR})::int AS ok, (strand = a_strand AND (CASE WHEN rn < a_rn THEN ns - e ELSE s - pe END) <= {GAP})::int AS run FROM a JOIN g ON a.contig_id = g.contig_id AND abs(g.rn - a_rn) <= 6),
cut AS (SELECT *, min(CASE WHEN off = 0 THEN 1 ELSE ok END) OVER w AS near, min(CASE WHEN off = 0 THEN 1 ELSE run END) OVER w AS in_run, min(CASE WHEN off = 0 THEN 1 ELSE (strand = a_strand)::int END) OVER w AS same_run FROM side WINDOW w AS (PARTITION BY contig_id, anchor_id, sign(off) ORDER BY abs(off))),
around AS (SELECT *, in_run = 1 AS in_operon FROM cut WHERE near = 1)"""


@query(f"""{_l()} SELECT contig_id, anchor_id, count(*) AS n_genes, sum((off < 0)::int)::bigint AS n_left, (min(s) - 500)::bigint AS span_start, (max(e) + 500)::bigint AS span_end FROM around GROUP BY ALL""")
def locus_window(spark, sf_dir):
    return _loci(spark, sf_dir).select("contig_id", F.col("anchor.gene_id").alias("anchor_id"), F.size("genes").cast("long").alias("n_genes"), F.col("at").cast("long").alias("n_left"), "span_start", "span_end")


@query(f"""{_l()}, first AS (SELECT contig_id, anchor_id, min(off) AS first_off FROM around GROUP BY ALL)
SELECT contig_id, anchor_id, gene_id, off::int AS "offset", (CASE WHEN off = first_off THEN 0 ELSE s - pe END)::bigint AS gap, strand = a_strand AS same_strand, same_run = 1 AS co_directional_run FROM around JOIN first USING (contig_id, anchor_id)""")
def locus_neighbours(spark, sf_dir):
    return locus.neighbours(_loci(spark, sf_dir))


@query(f"""{_G}, b AS (SELECT *, sum(CASE WHEN ps IS NOT NULL AND (ps <> strand OR s - pe > {GAP}) THEN 1 ELSE 0 END) OVER (PARTITION BY contig_id ORDER BY s, gene_id) AS island FROM g)
SELECT contig_id, island::bigint AS island, count(*) AS n_genes, min(s)::bigint AS start, max(e)::bigint AS "end", min(strand)::int AS strand FROM b GROUP BY contig_id, island""")
def operon_islands(spark, sf_dir):
    marked = locus.islands(genes(spark, sf_dir), GAP)
    return marked.groupBy("contig_id", "island").agg(F.count("*").alias("n_genes"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("strand").alias("strand"))


@query(f"""{_l()}, t AS (SELECT contig_id, anchor_id, any_value(a_strand) AS a_strand, list(label || CASE WHEN strand = a_strand THEN '(+)' ELSE '(-)' END ORDER BY s, label || CASE WHEN strand = a_strand THEN '(+)' ELSE '(-)' END) AS l,
list(label || CASE WHEN strand = a_strand THEN '(+)' ELSE '(-)' END ORDER BY s, label || CASE WHEN strand = a_strand THEN '(+)' ELSE '(-)' END) FILTER (in_operon) AS o FROM around GROUP BY contig_id, anchor_id)
SELECT contig_id, anchor_id, array_to_string(CASE WHEN a_strand = -1 THEN list_reverse(l) ELSE l END, '-') AS architecture, array_to_string(CASE WHEN a_strand = -1 THEN list_reverse(o) ELSE o END, '-') AS core_architecture FROM t""")
def locus_architecture(spark, sf_dir):
    arch = lambda genes: locus.architecture(F.col(genes), F.col("arrays"), F.col("anchor"))
    return _loci(spark, sf_dir).select("contig_id", F.col("anchor.gene_id").alias("anchor_id"), arch("genes").alias("architecture"), arch("operon").alias("core_architecture"))


@query(f"""{_l()}, n AS (SELECT greatest(0, CASE WHEN off = -1 THEN a_s - e ELSE s - a_e END) AS gap FROM around WHERE abs(off) = 1) SELECT round(coalesce(avg(gap), 0.0), 6) AS mean_gap, count(*) AS n FROM n""")
def mean_intergenic_gap(spark, sf_dir):
    return locus.mean_intergenic_gap(_loci(spark, sf_dir)).select(rounded(F.col("mean_gap")).alias("mean_gap"), "n")


@query(f"""{_l()}, n AS (SELECT count(DISTINCT (contig_id, anchor_id)) AS total FROM around), c AS (SELECT label, count(DISTINCT (contig_id, anchor_id)) AS n_loci FROM around WHERE in_operon AND off <> 0 GROUP BY label)
SELECT label, n_loci, round(n_loci / total, 6) AS rate FROM c, n""")
def partner_conservation(spark, sf_dir):
    return locus.conservation(_loci(spark, sf_dir)).withColumn("rate", rounded(F.col("rate")))


def _system_sql() -> str:
    rows = []
    for i, s in enumerate(SYSTEMS):
        hit = " + ".join(f"CASE WHEN list_contains(inside, '{r}') THEN 1.0 WHEN list_contains(near, '{r}') THEN 0.5 ELSE 0.0 END" for r in s.required)
        bad = [f"list_contains(inside, '{f}')::int" for f in s.forbidden]
        if s.anchor_aa:
            bad.append(f"(aa > 0 AND NOT aa BETWEEN {s.anchor_aa[0] * 0.6} AND {s.anchor_aa[1] * 1.6})::int")
        known = ", ".join(f"'{x}'" for x in s.required + s.optional)
        rows.append(f"SELECT contig_id, anchor_id, {i} AS ordinal, '{s.system_id}' AS system_id, least(1.0, ({hit}) / {len(s.required)})::double AS score, ({' + '.join(bad) or '0'})::int AS n_violations, len(list_filter(inside, lambda x: x NOT IN ({known}, '{ANCHOR}'))) AS extra FROM l")
    return f"{_l()}, l AS (SELECT contig_id, anchor_id, any_value(a_aa) AS aa, list(label) AS near, list(label) FILTER (in_operon) AS inside FROM around GROUP BY contig_id, anchor_id), m AS ({' UNION ALL '.join(rows)})"


def _matched(spark, sf_dir):
    return locus.with_matches(_loci(spark, sf_dir), SYSTEMS).withColumn("anchor_id", F.col("anchor.gene_id"))


@query(f"{_system_sql()} SELECT contig_id, anchor_id, system_id, round(score, 6) AS score, n_violations, score >= 0.85 AND n_violations = 0 AS is_match FROM m")
def catalogue_match(spark, sf_dir):
    found = [locus.match(s) for s in SYSTEMS]
    # stack, not explode: a filter inferred from explode would be pushed below the operons and find them anew
    rows = _loci(spark, sf_dir).select("contig_id", F.col("anchor.gene_id").alias("anchor_id"), F.stack(F.lit(len(found)), *[c for m in found for c in (m["system_id"], m["score"], F.size(m["violations"]))]).alias("system_id", "score", "n_violations"))
    return rows.select("contig_id", "anchor_id", "system_id", rounded(F.col("score")).alias("score"), "n_violations", ((F.col("score") >= locus.MATCH_SCORE) & (F.col("n_violations") == 0)).alias("is_match"))


@query(f"""{_system_sql()}, b AS (SELECT *, row_number() OVER (PARTITION BY contig_id, anchor_id ORDER BY score DESC, n_violations, ordinal) AS p, coalesce(max(CASE WHEN n_violations = 0 THEN score END) OVER (PARTITION BY contig_id, anchor_id), 0.0) AS clean FROM m)
SELECT contig_id, anchor_id, system_id AS best, round(greatest(0.0, least(1.0, greatest(1 - clean, CASE WHEN score >= 0.6 AND extra > 0 THEN 0.35 + 0.1 * least(extra, 3) ELSE 0.0 END)))::double, 6) AS novelty FROM b WHERE p = 1""")
def locus_novelty(spark, sf_dir):
    rows = locus.with_novelty(_matched(spark, sf_dir))
    return rows.select("contig_id", "anchor_id", F.col("best.system_id").alias("best"), rounded(F.col("novelty")).alias("novelty"))
