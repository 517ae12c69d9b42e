"""Repeat arrays, motif sets and loci with arrays. Letters of documents stand in for bases; error events for arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusframe.functions import motifs
from locusframe.functions import sequence as S
from locusframe.operators import locus, motif_sets, repeats
from locusframe.plans import survey

from . import loci
from .base import DNA_SQL, PROTEIN_SQL, registry, rounded, table, texts

QUERIES, ORACLES, query = registry()


def _contigs(spark, sf_dir):
    return texts(spark, sf_dir).select(F.col("doc_id").alias("contig_id"), S.text_as_dna(F.col("text")).alias("dna"))


@query(f"""WITH p AS (SELECT doc_id, {DNA_SQL} AS s FROM documents), b AS (SELECT doc_id, 1 AS strand, s FROM p UNION ALL SELECT doc_id, -1, reverse(translate(s, 'ACGT', 'TGCA')) FROM p),
k AS (SELECT doc_id, strand, i AS pos, substr(s, i::int + 1, 14) AS kmer FROM b, unnest(range(0, greatest(length(s) - 13, 0))) u(i))
SELECT doc_id AS contig_id, strand, kmer, count(*) AS n, min(pos) AS first FROM k GROUP BY ALL HAVING count(*) >= 3""")
def repeat_seed_positions(spark, sf_dir):
    return repeats.seed_positions(_contigs(spark, sf_dir)).withColumn("first", F.col("first").cast("long"))


@query()
def repeat_arrays(spark, sf_dir):
    out = repeats.repeat_arrays(_contigs(spark, sf_dir))
    numbers = {c: rounded(F.col(c)) for c in ("repeat_identity", "spacer_identity", "regularity")}
    return out.select("contig_id", "place", "start", "end", "strand", "repeat_consensus", "copy_number", "repeat_length", "class", *[v.alias(k) for k, v in numbers.items()])


@query()
def dna_shuffle_control(spark, sf_dir):
    """Whether shuffled documents, as contigs, show regular arrays: none should."""
    return survey.dna_control(_contigs(spark, sf_dir)).select("n", "n_found", "rate", "passed")


@query("""WITH o AS (SELECT l_orderkey AS array_id, list(l_quantity::int ORDER BY l_linenumber) AS spacers, count(*) + 1 AS copies, round(avg(l_discount) * 12, 6) AS alike FROM lineitem GROUP BY 1),
r AS (SELECT *, CASE WHEN len(spacers) < 2 OR list_avg(spacers) = 0 THEN 0.0 ELSE greatest(0.0, 1 - list_stddev_pop(spacers) / list_avg(spacers)) END AS regularity FROM o)
SELECT array_id, round(regularity, 6) AS regularity, CASE WHEN alike > 0.6 THEN 'tandem-repeat' WHEN copies >= 3 AND regularity > 0.75 THEN 'spacer-array' ELSE 'irregular-repeat' END AS class,
CASE WHEN alike > 0.6 THEN 'tandem-repeat (near-identical spacers; likely structural or VNTR)' WHEN list_avg(spacers) BETWEEN 25 AND 50 AND copies >= 3 AND regularity > 0.8 THEN 'CRISPR-like (repeat-spacer array with distinct spacers)' WHEN copies >= 3 AND regularity > 0.75 THEN 'regularly spaced non-coding array' ELSE 'irregular repeat cluster' END AS described,
round((0.45 * least(1.0, copies / 8) + 0.30 * regularity + 0.25 * greatest(0.0, 1 - alike / 0.6)) * CASE WHEN alike > 0.6 THEN 0.15 ELSE 1.0 END, 9) AS quality FROM r""")
def array_classes(spark, sf_dir):
    """Orders' quantities as the spacers of an array."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("array_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q")))).alias("x"), F.round(F.avg("l_discount") * 12, 6).alias("alike"))  # lines of an order
    rows = lines.select("array_id", F.col("x.q").alias("spacers"), (F.size("x") + 1).alias("copies"), "alike").withColumn("regularity", repeats.regularity(F.col("spacers")))
    copies, regular, alike = F.col("copies"), F.col("regularity"), F.col("alike")
    return rows.select("array_id", rounded(regular).alias("regularity"), repeats.array_class(copies, regular, alike).alias("class"), repeats.described(copies, F.lit(30), F.col("spacers"), regular, alike).alias("described"), rounded(repeats.quality(copies, regular, alike), 9).alias("quality"))


@query("""WITH c AS (SELECT user_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + 600 AS e FROM events), g AS (SELECT *, s - lag(e) OVER w AS gap FROM c WINDOW w AS (PARTITION BY user_id ORDER BY s, e)),
r AS (SELECT *, sum((gap IS NOT NULL AND NOT gap BETWEEN 3600 AND 43200)::int) OVER (PARTITION BY user_id ORDER BY s, e) AS run FROM g), n AS (SELECT user_id, run, min(s) AS s, max(e) AS e, count(*) AS copies FROM r GROUP BY 1, 2)
SELECT user_id, s AS start, e AS "end", copies FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY copies DESC, s) AS p FROM n) WHERE p = 1""")
def longest_spaced_run(spark, sf_dir):
    """Each user's longest run of events that follow each other after one to twelve hours."""
    start = F.unix_seconds(F.col("ts").cast("timestamp"))
    return repeats.longest_runs(table(spark, sf_dir, "events").select("user_id", start.alias("start"), (start + loci.LONG).alias("end")), "user_id", (3600, 43_200))


# The palm's motifs A and C as regular expressions.
_A_SQL, _C_SQL = "[LIVMF].[DN][LIVMFYAG]", "[YF].[DN][DN]"


@query(f"""WITH p AS (SELECT doc_id, {PROTEIN_SQL} AS s FROM documents), w AS (SELECT doc_id, i AS start, substr(s, i::int + 1, 4) AS m FROM p, unnest(range(0, greatest(length(s) - 3, 0))) u(i)),
a AS (SELECT * FROM w WHERE regexp_full_match(m, '{_A_SQL}')), c AS (SELECT * FROM w WHERE regexp_full_match(m, '{_C_SQL}')),
j AS (SELECT a.doc_id, bool_or(length(replace(c.m, 'D', '')) <= 2 AND length(replace(a.m, 'D', '')) <= 3) AS good FROM a JOIN c ON a.doc_id = c.doc_id AND c.start - a.start - 4 BETWEEN 40 AND 180 GROUP BY 1)
SELECT p.doc_id, coalesce(good, false) AS intact FROM p LEFT JOIN j USING (doc_id)""")
def catalytic_triad(spark, sf_dir):
    p = texts(spark, sf_dir).select("doc_id", S.text_as_protein(F.col("text")).alias("s"))
    return motif_sets.triad(p, "doc_id", F.col("s")).select("doc_id", "intact")


@query()
def motif_set_scan(spark, sf_dir):
    p = texts(spark, sf_dir, "benchmark", "item_id").select("item_id", S.text_as_protein(F.col("text")).alias("s"))
    return motif_sets.scan(p, "s").select("item_id", F.size("placed").alias("n_placed"), F.array_join("missing", ",").alias("missing"), "intact", rounded(F.col("completeness")).alias("completeness"), motif_sets.summary().alias("summary"))


_CLASSES = {a: "".join(b for b, c in zip(*S.REDUCED, strict=True) if c == rep) for a, rep in zip(*S.REDUCED, strict=True)}


@query(f"""WITH p AS (SELECT item_id, {PROTEIN_SQL} AS s FROM benchmark), l AS (SELECT item_id, i, substr(s, i::int, 1) AS a FROM p, unnest(range(1, 9)) u(i) WHERE i <= length(s)),
c(a, n, element) AS (VALUES {", ".join(f"('{a}', {len(c)}, '{c if len(c) == 1 else '[' + c + ']'}')" for a, c in _CLASSES.items())}, ('X', 20, 'x'))
SELECT item_id, string_agg(element, '-' ORDER BY i) AS pattern, round(sum(log2(20.0 / n)), 6) AS information FROM l JOIN c USING (a) GROUP BY 1""")
def motif_information(spark, sf_dir):
    """Each passage's first eight residues as a motif of residue classes, and what it tells."""
    elements = F.create_map(*[F.lit(x) for a, c in {**_CLASSES, "X": "x"}.items() for x in (a, c if len(c) == 1 else f"[{c}]")])
    p = texts(spark, sf_dir, "benchmark", "item_id").select("item_id", F.substring(S.text_as_protein(F.col("text")), 1, 8).alias("s")).where("s <> ''")
    rows = p.select("item_id", F.array_join(F.transform(F.split("s", ""), lambda a: elements[a]), "-").alias("pattern"))
    return rows.select("item_id", "pattern", rounded(motifs.information_of("pattern")).alias("information"))



_ARRAYS_SQL = "x AS (SELECT user_id AS contig_id, epoch_us(ts) // 1000000 AS xs, epoch_us(ts) // 1000000 + 600 AS xe, (3 + event_id % 3)::int AS copies, (20 + event_id % 30)::int AS repeat_length, CASE WHEN event_id % 2 = 0 THEN 'spacer-array' ELSE 'tandem-repeat' END AS class FROM events WHERE event_type = 'error')"


def _arrays(spark, sf_dir):
    """Error events as repeat arrays."""
    start = F.unix_seconds(F.col("ts").cast("timestamp"))
    kind = F.when(F.col("event_id") % 2 == 0, "spacer-array").otherwise("tandem-repeat")
    rows = table(spark, sf_dir, "events").where("event_type = 'error'")
    return rows.select(F.col("user_id").alias("contig_id"), start.alias("start"), (start + loci.LONG).alias("end"), (3 + F.col("event_id") % 3).cast("int").alias("copy_number"), (20 + F.col("event_id") % 30).cast("int").alias("repeat_length"), kind.alias("class"))


def _with_arrays(spark, sf_dir):
    return locus.with_arrays(loci._loci(spark, sf_dir), _arrays(spark, sf_dir)).withColumn("anchor_id", F.col("anchor.gene_id"))


_SPANS = f"""{loci._l()}, {_ARRAYS_SQL}, l AS (SELECT contig_id, anchor_id, any_value(a_strand) AS a_strand, any_value(a_aa) AS aa, min(s) - 500 AS span_start, max(e) + 500 AS span_end, min(s) FILTER (in_operon) AS lo, max(e) FILTER (in_operon) AS hi, list(label) FILTER (in_operon) AS inside, list(label) AS near FROM around GROUP BY contig_id, anchor_id),
m AS (SELECT l.contig_id, l.anchor_id, xs, xe, copies, repeat_length, class, greatest(xs - hi, lo - xe, 0) AS far FROM l JOIN x ON l.contig_id = x.contig_id AND xs < span_end AND span_start < xe)"""


@query(f"""{_SPANS} SELECT l.contig_id, l.anchor_id, count(xs) AS n_arrays, coalesce(min(far), 1000000000)::bigint AS distance FROM l LEFT JOIN m ON l.contig_id = m.contig_id AND l.anchor_id = m.anchor_id GROUP BY ALL""")
def operon_array_distance(spark, sf_dir):
    rows = _with_arrays(spark, sf_dir)
    return rows.select("contig_id", "anchor_id", F.size("arrays").cast("long").alias("n_arrays"), locus.array_distance(F.col("operon"), F.col("arrays")).cast("long").alias("distance"))


@query(f"""{_SPANS}, t AS (SELECT contig_id, anchor_id, s AS pos, 0 AS rank, label || CASE WHEN strand = a_strand THEN '(+)' ELSE '(-)' END AS text, label || CASE WHEN strand = a_strand THEN '(+)' ELSE '(-)' END AS brief FROM around WHERE in_operon
UNION ALL SELECT contig_id, anchor_id, xs, 1, 'array[' || copies || 'x' || repeat_length || ']', 'array[' || class || ']' FROM m),
o AS (SELECT contig_id, anchor_id, list(text ORDER BY pos, rank, text) AS full_, list(brief ORDER BY pos, rank, brief) AS brief FROM t GROUP BY ALL),
d AS (SELECT contig_id, anchor_id, CASE WHEN a_strand = -1 THEN list_reverse(full_) ELSE full_ END AS full_, CASE WHEN a_strand = -1 THEN list_reverse(brief) ELSE brief END AS brief FROM o JOIN l USING (contig_id, anchor_id))
SELECT contig_id, anchor_id, array_to_string(full_, '-') AS architecture, array_to_string(list_filter(brief, lambda b, i: NOT (i > 1 AND starts_with(b, 'array[') AND brief[i - 1] = b)), '-') AS signature FROM d""")
def array_architecture(spark, sf_dir):
    """Operons with arrays: each array by its numbers, and by class with equal neighbours folded."""
    of = lambda detail: locus.architecture(F.col("operon"), F.col("arrays"), F.col("anchor"), detail)
    return _with_arrays(spark, sf_dir).select("contig_id", "anchor_id", of("full").alias("architecture"), of("class").alias("signature"))


SYSTEMS = [
    locus.System("spaced", "visit with an array", ("view",), optional=("error",), requires_array=True, array_repeat_range=(30, 40)),
    locus.System("plain", "visit without an array", ("view", "click"), forbidden=("error",), forbids_array=True),
]


@query(f"""{_SPANS}, r AS (SELECT l.contig_id, l.anchor_id, any_value(inside) AS inside, any_value(near) AS near, count(xs) AS n, coalesce(bool_or(repeat_length BETWEEN 30 AND 40), false) AS fits FROM l LEFT JOIN m ON l.contig_id = m.contig_id AND l.anchor_id = m.anchor_id GROUP BY ALL),
v AS (SELECT contig_id, anchor_id, 'spaced' AS system_id, CASE WHEN list_contains(inside, 'view') THEN 1.0 WHEN list_contains(near, 'view') THEN 0.5 ELSE 0.0 END AS score, (n = 0)::int + (n > 0 AND NOT fits)::int AS n_violations FROM r
UNION ALL SELECT contig_id, anchor_id, 'plain', (CASE WHEN list_contains(inside, 'view') THEN 1.0 WHEN list_contains(near, 'view') THEN 0.5 ELSE 0.0 END + CASE WHEN list_contains(inside, 'click') THEN 1.0 WHEN list_contains(near, 'click') THEN 0.5 ELSE 0.0 END) / 2, list_contains(inside, 'error')::int + (n > 0)::int FROM r)
SELECT contig_id, anchor_id, system_id, round(score::double, 6) AS score, n_violations::int AS n_violations, score >= 0.85 AND n_violations = 0 AS is_match FROM v""")
def array_catalogue_match(spark, sf_dir):
    found = [locus.match(s) for s in SYSTEMS]
    rows = _with_arrays(spark, sf_dir).select("contig_id", "anchor_id", F.stack(F.lit(len(found)), *[c for m in found for c in (m["system_id"], m["score"], F.size(m["violations"]))]).alias("system_id", "score", "n_violations"))
    return rows.select("contig_id", "anchor_id", "system_id", rounded(F.col("score")).alias("score"), "n_violations", ((F.col("score") >= locus.MATCH_SCORE) & (F.col("n_violations") == 0)).alias("is_match"))
