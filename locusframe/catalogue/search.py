"""Similarity search: benchmark passages against documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusframe.functions import sequence as S
from locusframe.operators import codes, similarity

from .base import PROTEIN_SQL, registry, rounded, table, texts

QUERIES, ORACLES, query = registry()
K, LEAST, TOP = 12, 20, 5

_K = f"""WITH q AS (SELECT item_id, {PROTEIN_SQL} AS s FROM benchmark), t AS (SELECT doc_id, {PROTEIN_SQL} AS s FROM documents),
qk AS (SELECT * FROM (SELECT item_id, i AS q_pos, substr(s, i + 1, {K}) AS kmer FROM q, unnest(range(0, greatest(length(s) - {K} + 1, 0))) u(i)) WHERE NOT contains(kmer, 'X')),
tk AS (SELECT * FROM (SELECT doc_id, i AS t_pos, substr(s, i + 1, {K}) AS kmer FROM t, unnest(range(0, greatest(length(s) - {K} + 1, 0))) u(i)) WHERE NOT contains(kmer, 'X')),
d AS (SELECT item_id, doc_id, t_pos - q_pos AS diagonal, count(*) AS n FROM qk JOIN tk USING (kmer) GROUP BY ALL)"""


def _sides(spark, sf_dir):
    q = texts(spark, sf_dir, "benchmark", "item_id").select("item_id", S.text_as_protein(F.col("text")).alias("s"))
    t = texts(spark, sf_dir).select("doc_id", S.text_as_protein(F.col("text")).alias("s"))
    return q, t


def _diagonals(spark, sf_dir):
    q, t = _sides(spark, sf_dir)
    return similarity.diagonals(similarity.index(q, "item_id", F.col("s"), K), similarity.index(t, "doc_id", F.col("s"), K), "item_id", "doc_id")


@query(f"{_K} SELECT * FROM d WHERE n >= {LEAST}")
def kmer_diagonal_hits(spark, sf_dir):
    """Which documents contain passages of the benchmark."""
    return _diagonals(spark, sf_dir).where(F.col("n") >= LEAST)


@query(f"{_K}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY n DESC, diagonal) AS place FROM d) SELECT item_id, doc_id, diagonal, n, place::int AS place FROM r WHERE place <= 3")
def top_diagonals(spark, sf_dir):
    return similarity.top_diagonals(_diagonals(spark, sf_dir), "item_id", "doc_id")


@query(f"{_K}, b AS (SELECT item_id, doc_id, max(n) AS best FROM d GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY best DESC, doc_id) AS place FROM b) SELECT item_id, doc_id, best, place::int AS place FROM r WHERE place <= {TOP}")
def seed_hits_topk(spark, sf_dir):
    """The documents with the fullest diagonal of each passage."""
    best = _diagonals(spark, sf_dir).groupBy("item_id", "doc_id").agg(F.max("n").alias("best"))
    return similarity.best_hits(best, "item_id", "doc_id", "best", TOP)


@query(f"""{_K}, b AS (SELECT item_id, doc_id, max(n) AS best FROM d GROUP BY ALL),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY best DESC, doc_id) AS p FROM b) WHERE p = 1), r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY best DESC, item_id) AS p FROM b) WHERE p = 1)
SELECT f.item_id, f.doc_id, f.best FROM f JOIN r USING (item_id, doc_id)""")
def reciprocal_best(spark, sf_dir):
    best = _diagonals(spark, sf_dir).groupBy("item_id", "doc_id").agg(F.max("n").alias("best"))
    return similarity.reciprocal_best(best, "item_id", "doc_id", "best")


@query(f"""{_K}, h AS (SELECT d.*, q.s AS x, t.s AS y, greatest(0, -diagonal) AS a FROM d JOIN q USING (item_id) JOIN t USING (doc_id) WHERE n >= {LEAST}),
c AS (SELECT item_id, doc_id, diagonal, i, CASE WHEN substr(x, a + i, 1) = substr(y, a + diagonal + i, 1) THEN 1 ELSE -1 END AS v FROM h, unnest(range(1, least(length(x) - a, length(y) - a - diagonal) + 1)) u(i)),
p AS (SELECT *, sum(v) OVER (PARTITION BY item_id, doc_id, diagonal ORDER BY i) AS upto FROM c),
m AS (SELECT *, coalesce(min(upto) OVER (PARTITION BY item_id, doc_id, diagonal ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM p)
SELECT item_id, doc_id, diagonal, max(upto - least(low, 0))::double AS segment FROM m GROUP BY ALL""")
def ungapped_best_segment(spark, sf_dir):
    q, t = _sides(spark, sf_dir)
    hits = kmer_diagonal_hits(spark, sf_dir).join(q.withColumnRenamed("s", "x"), "item_id").join(t.withColumnRenamed("s", "y"), "doc_id")
    return hits.select("item_id", "doc_id", "diagonal", similarity.best_segment(F.col("x"), F.col("y"), F.col("diagonal")).alias("segment"))


@query(f"""WITH n AS (SELECT sum(length({PROTEIN_SQL})) AS total FROM documents),
q AS (SELECT item_id, greatest(length({PROTEIN_SQL}), 1) AS len FROM benchmark), b AS (SELECT *, (0.267 * len - ln(0.041)) / ln(2) AS bits FROM q)
SELECT item_id, round(bits, 6) AS bits, round(log10(len * total * 2 ** (-least(bits, 1000.0))), 4) AS log_evalue FROM b, n""")
def bits_evalue(spark, sf_dir):
    """Bits and E-values against all documents of scores as high as the passages' lengths."""
    q, t = _sides(spark, sf_dir)
    total = t.agg(F.sum(F.length("s")).alias("total"))
    rows = q.select("item_id", F.greatest(F.length("s"), F.lit(1)).alias("len")).crossJoin(F.broadcast(total))  # one row
    b = similarity.bits(F.col("len"))
    return rows.select("item_id", rounded(b).alias("bits"), rounded(F.log10(similarity.evalue(b, F.col("len"), F.col("total"))), 4).alias("log_evalue"))


@query(f"""WITH a AS (SELECT DISTINCT item_id, substr(s, i + 1, 4) AS kmer FROM (SELECT item_id, translate({PROTEIN_SQL}, 'LVIMCAGSTPFYWEDNQKRH', 'LLLLCAGSSPFFFEEEEKKH') AS s FROM benchmark), unnest(range(0, greatest(length(s) - 3, 0))) u(i)),
b AS (SELECT DISTINCT doc_id, substr(s, i + 1, 4) AS kmer FROM (SELECT doc_id, translate({PROTEIN_SQL}, 'LVIMCAGSTPFYWEDNQKRH', 'LLLLCAGSSPFFFEEEEKKH') AS s FROM documents), unnest(range(0, greatest(length(s) - 3, 0))) u(i)),
qa AS (SELECT * FROM a WHERE NOT contains(kmer, 'X')), tb AS (SELECT * FROM b WHERE NOT contains(kmer, 'X')),
x AS (SELECT item_id, doc_id, count(*) AS shared FROM qa JOIN tb USING (kmer) GROUP BY ALL)
SELECT item_id, doc_id, shared, round(shared / (nq + nt - shared), 6) AS jaccard FROM x JOIN (SELECT item_id, count(*) AS nq FROM qa GROUP BY 1) USING (item_id) JOIN (SELECT doc_id, count(*) AS nt FROM tb GROUP BY 1) USING (doc_id)
WHERE shared / (nq + nt - shared) >= 0.2""")
def kmer_set_jaccard(spark, sf_dir):
    q, t = _sides(spark, sf_dir)
    sets = [codes.bitmaps(df, key, F.col("s")) for df, key in ((q, "item_id"), (t, "doc_id"))]
    found = similarity.shared_bitmaps(*sets, "item_id", "doc_id", 0.2)
    return found.withColumn("jaccard", rounded(F.col("jaccard")))


@query("""SELECT substr(sha256(concat_ws('|', role, coalesce(text, ''))), 1, 16) AS fingerprint, count(*) AS n_sessions, min(conv_id * 100000 + turn) AS first_session FROM conversations GROUP BY 1""")
def session_dedup(spark, sf_dir):
    """Sessions of equal content by fingerprint: one of each is evaluated."""
    rows = table(spark, sf_dir, "conversations").select(F.substring(F.sha2(F.concat_ws("|", "role", F.coalesce("text", F.lit(""))), 256), 1, 16).alias("fingerprint"), (F.col("conv_id") * 100000 + F.col("turn")).alias("session"))
    return rows.groupBy("fingerprint").agg(F.count("*").alias("n_sessions"), F.min("session").alias("first_session"))
