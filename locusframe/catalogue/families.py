"""Families: profiles, searches, clusters and calls. Benchmark passages stand in for described members, documents for the database."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusframe.functions import sequence as S
from locusframe.operators import clusters, profiles, search

from .base import PROTEIN_SQL, registry, rounded, table, texts

QUERIES, ORACLES, query = registry()
#: Length of the k-mers that seed searches of documents; documents are long, short ones would meet nearly all.
K = 12

_CELLS = f"""WITH p AS (SELECT item_id, item_id % 4 AS family, {PROTEIN_SQL} AS s FROM benchmark), w AS (SELECT max(length(s))::int AS n FROM p),
c AS (SELECT family, item_id AS member, i AS col, substr(rpad(s, n, '-'), i::int + 1, 1) AS residue FROM p, w, unnest(range(0, n)) u(i)),
g AS (SELECT family, col FROM c GROUP BY ALL HAVING avg((residue = '-')::int) <= 0.5), k AS (SELECT c.* FROM c JOIN g USING (family, col)),
r AS (SELECT family, col, residue, count(*) AS n FROM k WHERE residue <> '-' GROUP BY ALL), q AS (SELECT family, col, count(*) AS kinds FROM r GROUP BY ALL),
s AS (SELECT family, member, coalesce(sum(1 / (kinds * n)), 0) AS w FROM k LEFT JOIN r USING (family, col, residue) LEFT JOIN q USING (family, col) GROUP BY ALL),
h AS (SELECT family, member, CASE WHEN sum(w) OVER f > 0 THEN w * count(*) OVER f / sum(w) OVER f ELSE 1.0 END AS weight FROM s WINDOW f AS (PARTITION BY family))"""
_BACKGROUND_SQL = ", ".join(f"('{a}', {v})" for a, v in S.BACKGROUND.items())
_FREQUENCIES = f"""{_CELLS}, b(residue, bg) AS (VALUES {_BACKGROUND_SQL}), o AS (SELECT family, col, residue, sum(weight) AS w FROM k JOIN h USING (family, member) JOIN b USING (residue) GROUP BY ALL), t AS (SELECT family, col, sum(w) AS total FROM o GROUP BY ALL),
f AS (SELECT g.family, g.col, b.residue, bg, (coalesce(w, 0) + 1.5 * bg) / (coalesce(total, 0) + 1.5) AS frequency FROM g CROSS JOIN b LEFT JOIN o ON o.family = g.family AND o.col = g.col AND o.residue = b.residue LEFT JOIN t ON t.family = g.family AND t.col = g.col)"""


def _aligned(spark, sf_dir):
    """Passages in four families, the ends filled up with gaps."""
    p = texts(spark, sf_dir, "benchmark", "item_id").select("item_id", S.text_as_protein(F.col("text")).alias("s"))
    width = p.agg(F.max(F.length("s")).alias("n"))
    return p.crossJoin(F.broadcast(width)).select((F.col("item_id") % 4).alias("family"), F.col("item_id").alias("member"), F.rpad("s", F.col("n"), F.lit("-")).alias("aligned"))  # one row


@query(f"{_CELLS} SELECT family, member, round(weight, 6) AS weight FROM h")
def henikoff_weights(spark, sf_dir):
    return profiles.henikoff_weights(profiles.kept_columns(profiles.cells(_aligned(spark, sf_dir)))).withColumn("weight", rounded(F.col("weight")))


def _frequencies(spark, sf_dir):
    found = profiles.kept_columns(profiles.cells(_aligned(spark, sf_dir)))
    return profiles.column_frequencies(found, profiles.henikoff_weights(found))


@query(f"{_FREQUENCIES} SELECT family, col, residue, round(frequency, 8) AS frequency, round(log2(frequency / bg), 6) AS odds FROM f")
def profile_column_freq(spark, sf_dir):
    out = _frequencies(spark, sf_dir)
    return out.select("family", F.col("col").cast("long").alias("col"), "residue", rounded(F.col("frequency"), 8).alias("frequency"), rounded(F.col("odds")).alias("odds"))


@query(f"""{_FREQUENCIES} SELECT family, col, round(sum(frequency * log2(frequency / bg)), 6) AS information, arg_max(residue, (frequency, -ascii(residue))) AS consensus, sum(frequency * log2(frequency / bg)) >= 1.5 AS core FROM f GROUP BY ALL""")
def profile_information(spark, sf_dir):
    out = profiles.column_information(_frequencies(spark, sf_dir))
    return out.select("family", F.col("col").cast("long").alias("col"), rounded(F.col("information")).alias("information"), "consensus", "core")


def _database(spark, sf_dir):
    return texts(spark, sf_dir).select(F.col("doc_id").alias("target"), S.text_as_protein(F.col("text")).alias("t_seq"))


def _passages(spark, sf_dir):
    return texts(spark, sf_dir, "benchmark", "item_id").select("item_id", S.text_as_protein(F.col("text")).alias("s"))


def _searched(spark, sf_dir):
    queries = _passages(spark, sf_dir).select(F.col("item_id").alias("query"), F.col("s").alias("q_seq"))
    return search.sequence_search(queries, _database(spark, sf_dir), K, lambda s: s, keep=None, limit=None)


@query()
def sequence_search(spark, sf_dir):
    """Documents that hold what is like a passage, with the alignment."""
    found = search.hits(_searched(spark, sf_dir))
    return found.select("query", "target", "place", "seeds", "segment", rounded(F.col("bits")).alias("bits"), rounded(F.log10("evalue"), 4).alias("log_evalue"), "alignment.q_start", "alignment.q_end", "alignment.t_start", "alignment.t_end", rounded(F.col("alignment.identity")).alias("identity"), "alignment.gaps")


@query()
def search_funnel(spark, sf_dir):
    """How many documents each step of the search kept for each passage."""
    queries = _passages(spark, sf_dir).select(F.col("item_id").alias("query"))
    return search.funnel(_searched(spark, sf_dir), queries, table(spark, sf_dir, "documents"))


def _models(spark, sf_dir):
    """A profile a passage."""
    aligned = _passages(spark, sf_dir).select(F.col("item_id").alias("family"), F.lit(0).alias("member"), F.col("s").alias("aligned")).where("aligned <> ''")
    return profiles.calibrated(profiles.profiles(aligned), aligned, decoys=50)


@query()
def profile_search(spark, sf_dir):
    found = search.hits(search.profile_search(_models(spark, sf_dir), _database(spark, sf_dir), K, lambda s: s, keep=None, limit=None))
    return found.select("query", "target", "place", rounded(F.col("z"), 4).alias("z"), rounded(F.col("core_coverage")).alias("core_coverage"), "alignment.q_start", "alignment.q_end")


@query()
def profile_scan(spark, sf_dir):
    found = search.hits(search.profile_search(_models(spark, sf_dir), _database(spark, sf_dir), K, lambda s: s, least_z=5.0, align=False, keep=None, limit=None))
    return found.select("query", "target", rounded(F.col("z"), 4).alias("z"), rounded(F.col("raw"), 4).alias("raw"))


def _names(spark, sf_dir):
    """Distinct names of parts, three times over: short sequences of a few families."""
    name = S.text_as_protein(F.col("p_name"))
    return table(spark, sf_dir, "part").groupBy(F.repeat(name, F.lit(3)).alias("sequence")).agg(F.min("p_partkey").alias("id"), F.min("p_type").alias("family"))


@query()
def greedy_clusters(spark, sf_dir):
    return clusters.greedy_clusters(_names(spark, sf_dir), identity=0.5, coverage=0.5)


@query()
def family_bootstrap(spark, sf_dir):
    names = _names(spark, sf_dir)
    seeds = names.groupBy("family").agg(F.min_by(F.struct(F.col("id").cast("string").alias("member"), "sequence"), "id").alias("x")).select("family", "x.*")
    _, members = search.bootstrapped(seeds, names.select(F.col("id").cast("string").alias("target"), F.col("sequence").alias("t_seq")), rounds=1, first_evalue=1e-3)
    return members.select("family", "member")


@query("""WITH s AS (SELECT l_orderkey AS gene, l_returnflag AS family, sum(l_quantity) AS z, count(*) / sum(count(*)) OVER (PARTITION BY l_orderkey) AS coverage FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS place, lead(family) OVER w AS runner_up, lead(z) OVER w AS runner_up_z FROM s WINDOW w AS (PARTITION BY gene ORDER BY z DESC, family))
SELECT gene, CASE WHEN z >= 60 AND coverage >= 0.5 THEN family ELSE 'unk' END AS label, family AS best, z, round(coverage, 6) AS coverage, runner_up, runner_up_z FROM r WHERE place = 1""")
def label_best_runner_up(spark, sf_dir):
    """Each order's flag with the greatest quantity, called where it is large and of half the lines."""
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("gene"), F.col("l_returnflag").alias("family")).agg(F.sum("l_quantity").alias("z"), F.count("*").alias("n"))
    total = own.groupBy("gene").agg(F.sum("n").alias("total"))
    scores = own.join(total, "gene").select("gene", "family", "z", (F.col("n") / F.col("total")).alias("coverage"))
    return search.called(scores, 60.0, 0.5).withColumn("coverage", rounded(F.col("coverage")))
