"""Rubrics over candidates: parts' and documents' numbers stand in for measured metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusframe.plans import bench, outcomes, revision
from locusframe.plans import rubric as R

from .base import registry, rounded, table

QUERIES, ORACLES, query = registry()

# Metrics of a candidate by its number, as SQL that Spark and DuckDB read alike.
METRICS = {
    "triad_intact": "k % 7 <> 0", "core_coverage": "(k % 11) / 10.0", "aligned_fraction": "(k % 5) / 4.0", "low_complexity": "(k % 13) / 30.0", "evalue": "power(10.0, -(k % 17))", "profile_z": "(k % 31) * 1.0",
    "novelty": "(k % 9) / 8.0", "partner_known_neglog_e": "(k % 19) / 5.0", "n_independent_loci": "k % 10", "partner_conservation": "(k % 6) / 5.0", "array_quality": "(k % 8) / 7.0", "array_operon_gap_bp": "(k % 23) * 200",
    "n_clusters": "k % 8", "association_neglog_p": "(k % 14) * 0.75", "n_phyla": "k % 5", "clade_restricted": "k % 3 = 0", "n_predictions": "k % 4",
}
_BAGS = "SELECT k, " + ", ".join(f"CAST({v} AS {'BOOLEAN' if k in ('triad_intact', 'clade_restricted') else 'DOUBLE'}) AS {k}" for k, v in METRICS.items())
_M = f"WITH m AS ({_BAGS} FROM (SELECT p_partkey AS k FROM part))"
_CLAMP = "least(greatest({}, 0.0), 1.0)"
_GATES = {
    "catalytic_core": "triad_intact",
    "domain_coverage": "core_coverage >= 0.7 AND aligned_fraction >= 0.35",
    "not_low_complexity": "low_complexity <= 0.3",
    "significance": "evalue <= 1e-5 AND profile_z >= 8",
    "novelty": "novelty >= 0.35",
    "partner_is_not_known": "partner_known_neglog_e < 3.0",
    "reproducible_association": "n_independent_loci >= 3 AND partner_conservation >= 0.5",
    "has_testable_component": "partner_conservation >= 0.5 OR array_quality >= 0.4 AND array_operon_gap_bp <= 3000",
    "not_redundant": "n_clusters >= 3",
}
_PRIORITY = (
    f"(2.0 * {_CLAMP.format('novelty')} + 2.0 * {_CLAMP.format('partner_conservation')} + 1.5 * {_CLAMP.format('association_neglog_p / 6.0')}"
    f" + 1.0 * {_CLAMP.format('n_phyla / 3.0')} * (CASE WHEN clade_restricted THEN 0.4 ELSE 1.0 END) + 1.5 * {_CLAMP.format('array_quality')} + 1.0 * {_CLAMP.format('n_predictions / 3.0')}) / 9.0"
)
_FAILED = "list_filter([" + ", ".join(f"CASE WHEN NOT ({e}) THEN '{g}' END" for g, e in _GATES.items()) + "], lambda x: x IS NOT NULL)"
_V = f"{_M}, v AS (SELECT k, {_FAILED} AS failed, {_PRIORITY} AS priority FROM m)"


def metrics(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).selectExpr("k", *[f"CAST({v} AS {'BOOLEAN' if k in ('triad_intact', 'clade_restricted') else 'DOUBLE'}) AS {k}" for k, v in METRICS.items()])


def _applied(spark, sf_dir):
    return R.default_rubric().apply(metrics(spark, sf_dir))


@query(f"""{_V} SELECT k, array_to_string(failed, ',') AS failed_gates, round(priority, 5) AS priority, CASE WHEN len(failed) > 0 THEN 'eliminate' WHEN priority >= 0.55 THEN 'promote' WHEN priority >= 0.35 THEN 'hold' ELSE 'eliminate' END AS disposition FROM v""")
def rubric_disposition(spark, sf_dir):
    return _applied(spark, sf_dir).select("k", F.array_join("failed_gates", ",").alias("failed_gates"), rounded(F.col("priority"), 5).alias("priority"), "disposition")


@query(f"""{_M}, n AS (SELECT * REPLACE (CASE WHEN k % 10 > 0 THEN novelty END AS novelty, CASE WHEN k % 15 > 0 THEN n_phyla END AS n_phyla) FROM m)
SELECT k, CASE WHEN novelty IS NULL OR n_phyla IS NULL THEN 'hold' WHEN len({_FAILED}) > 0 THEN 'eliminate' WHEN {_PRIORITY} >= 0.55 THEN 'promote' WHEN {_PRIORITY} >= 0.35 THEN 'hold' ELSE 'eliminate' END AS disposition,
CASE WHEN novelty IS NULL OR n_phyla IS NULL THEN 'no value of ' || concat_ws(', ', CASE WHEN n_phyla IS NULL THEN 'n_phyla' END, CASE WHEN novelty IS NULL THEN 'novelty' END) END AS error, round(CASE WHEN n_clusters > 0 THEN novelty / n_clusters ELSE 0.0 END, 6) AS per_cluster FROM n""")
def rubric_missing_values(spark, sf_dir):
    """Candidates without some metric are held and say which; a rule guards its quotient."""
    m = metrics(spark, sf_dir).withColumn("novelty", F.when(F.col("k") % 10 > 0, F.col("novelty"))).withColumn("n_phyla", F.when(F.col("k") % 15 > 0, F.col("n_phyla")))
    return R.default_rubric().apply(m).select("k", "disposition", "error", rounded(R.rule("novelty / n_clusters if n_clusters > 0 else 0.0", m)).alias("per_cluster"))


@query(f"""{_V}, g AS (SELECT unnest([{', '.join(f"'{g}'" for g in _GATES)}]) AS gate_id), c AS (SELECT unnest(failed) AS gate_id, count(*) AS fired FROM v GROUP BY 1), t AS (SELECT count(*) AS total FROM v)
SELECT gate_id, coalesce(fired, 0) AS fired, total, coalesce(fired, 0) = 0 AS inert, coalesce(fired, 0) = total AS saturated FROM g LEFT JOIN c USING (gate_id), t""")
def gate_activity(spark, sf_dir):
    return R.default_rubric().gate_activity(_applied(spark, sf_dir))


@query(f"""{_M} SELECT k, CASE WHEN triad_intact AND (1 < n_phyla AND n_phyla <= 4) THEN 1.0 ELSE 0.5 END::double AS a, round(abs(novelty - partner_conservation) + (k % 3) + (k // 4), 6) AS b, k IN (1, 2, 3) OR NOT clade_restricted AS c FROM m""")
def rule_values(spark, sf_dir):
    """Values of rules with conditions, chains, remainders and membership."""
    m = metrics(spark, sf_dir)
    return m.select(
        "k", R.rule("1.0 if triad_intact and 1 < n_phyla <= 4 else 0.5", m).alias("a"), rounded(R.rule("abs(novelty - partner_conservation) + k % 3 + int(k / 4)", m).cast("double")).alias("b"), R.condition("k in [1, 2, 3] or not clade_restricted", m).alias("c")
    )


_SUPPORT = """CASE key WHEN 'catalytic_core' THEN CASE WHEN triad_intact THEN 'direct' ELSE 'absent' END WHEN 'family_membership' THEN CASE WHEN profile_z >= 20 AND core_coverage >= 0.8 THEN 'direct' WHEN profile_z >= 10 THEN 'strong' ELSE 'suggestive' END
WHEN 'partner_association' THEN CASE WHEN association_neglog_p >= 6 AND n_independent_loci >= 8 AND partner_conservation >= 0.8 THEN 'strong' WHEN association_neglog_p >= 3 AND n_independent_loci >= 3 THEN 'suggestive' ELSE 'weak' END
WHEN 'noncoding_component' THEN CASE WHEN array_quality <= 0 THEN 'absent' WHEN array_operon_gap_bp > 3000 THEN 'weak' WHEN array_quality >= 0.7 THEN 'strong' WHEN array_quality >= 0.4 THEN 'suggestive' ELSE 'weak' END
WHEN 'taxonomic_spread' THEN CASE WHEN clade_restricted THEN 'weak' WHEN n_phyla >= 3 THEN 'strong' ELSE 'suggestive' END WHEN 'architecture' THEN CASE WHEN novelty >= 0.6 THEN 'strong' ELSE 'suggestive' END END"""
_KEYS = ("catalytic_core", "family_membership", "partner_association", "noncoding_component", "taxonomic_spread", "architecture", "other")
_RANK = "CASE {} WHEN 'absent' THEN 0 WHEN 'weak' THEN 1 WHEN 'suggestive' THEN 2 WHEN 'strong' THEN 3 WHEN 'direct' THEN 4 END"


def _claims(spark, sf_dir):
    claimed = F.element_at(F.array(*[F.lit(s) for s in R.RANKS]), (F.col("k") % 5 + 1).cast("int"))
    return metrics(spark, sf_dir).withColumn("evidence_key", F.explode(F.array(*map(F.lit, _KEYS)))).withColumn("strength", claimed)


_C = f"{_M}, c AS (SELECT m.*, key, list_extract(['absent', 'weak', 'suggestive', 'strong', 'direct'], (k % 5 + 1)::int) AS claimed FROM m, (SELECT unnest({list(_KEYS)}) AS key)), s AS (SELECT k, key AS evidence_key, claimed, {_SUPPORT} AS supported FROM c)"


@query(f"{_C} SELECT k, evidence_key, supported FROM s")
def evidence_strength(spark, sf_dir):
    return _claims(spark, sf_dir).select("k", "evidence_key", R.strength_for(F.col("evidence_key")).alias("supported"))


@query(f"{_C} SELECT k, evidence_key, claimed AS strength, supported FROM s WHERE {_RANK.format('claimed')} > {_RANK.format('supported')}")
def overclaims(spark, sf_dir):
    return R.overclaims(_claims(spark, sf_dir)).select("k", "evidence_key", "strength", "supported")


_EVIDENCE = "[" + ", ".join(f"{{'key': '{k}', 'metric': '{m}', 'measured': {m}::double, 'least': {least if least is not None else 'NULL'}::double}}" for k, (m, least) in R.EVIDENCE.items()) + "]"
_E = f"""{_M}, x AS (SELECT m.*, unnest({_EVIDENCE}) AS e FROM m), y AS (SELECT *, e.key AS key FROM x WHERE (e.key <> 'array_placement' OR array_quality > 0) AND (e.key <> 'partner_is_known' OR partner_known_neglog_e >= 3)),
v AS (SELECT k, key AS evidence_key, e.metric AS metric, e.measured AS measured, CASE WHEN key IN ('array_placement', 'partner_is_known') THEN 'strong' ELSE coalesce({_SUPPORT}, 'suggestive') END AS strength,
CASE key WHEN 'array_placement' THEN e.measured <= 3000 WHEN 'partner_is_known' THEN false ELSE e.measured >= e.least END AS supports FROM y)"""


@query(f"{_E} SELECT k, evidence_key, metric, round(measured, 6) AS measured, strength, supports FROM v")
def evidence_rows(spark, sf_dir):
    """The evidence of each candidate, a row a kind."""
    return R.evidence(metrics(spark, sf_dir), "k").withColumn("measured", rounded(F.col("measured")))


@query(f"""{_E}, c AS (SELECT k, unnest(['catalytic_core', 'noncoding_component', 'array_placement', 'partner_is_known']) AS evidence_key, list_extract(['absent', 'weak', 'suggestive', 'strong', 'direct'], (k % 5 + 1)::int) AS asserted FROM m),
h AS (SELECT c.*, coalesce(strength, 'absent') AS held FROM c LEFT JOIN v USING (k, evidence_key)) SELECT k, evidence_key, asserted, held FROM h WHERE {_RANK.format('asserted')} > {_RANK.format('held')}""")
def asserted_beyond_evidence(spark, sf_dir):
    """Claims that go beyond the evidence rows, or have none."""
    m = metrics(spark, sf_dir)
    keys = F.array(*map(F.lit, ("catalytic_core", "noncoding_component", "array_placement", "partner_is_known")))
    claims = m.select("k", F.explode(keys).alias("evidence_key"), F.element_at(F.array(*map(F.lit, R.RANKS)), (F.col("k") % 5 + 1).cast("int")).alias("asserted"))
    return R.asserted_beyond(R.evidence(m, "k"), claims, "k")


_COMPONENTS = "[" + ", ".join(f"{{'kind': '{c.kind}', 'i': {i}, 'name': '{c.name}', 'holds': {c.rule or 'true'}}}" for i, c in enumerate(bench.COMPONENTS)) + "]"


@query(f"""{_V}, p AS (SELECT k, (k % 20)::varchar AS signature, priority FROM v WHERE len(failed) = 0 AND priority >= 0.35), l AS (SELECT signature, arg_min(k, (-round(priority, 5), k)) AS k, count(*) AS n FROM p GROUP BY 1),
x AS (SELECT l.k, signature, n, unnest({_COMPONENTS}) AS c FROM l JOIN m USING (k))
SELECT k, signature, n, c.kind AS kind, row_number() OVER (PARTITION BY k, c.kind ORDER BY c.i)::int AS place, c.name AS name FROM x WHERE c.holds""")
def package_components(spark, sf_dir):
    """What the packages of candidates that pass all gates hand to the bench; the twentieth parts of the numbers stand in for architectures."""
    judged = _applied(spark, sf_dir).where("disposition in ('promote', 'hold')").select(F.col("k").alias("candidate_id"), F.lit("promote").alias("disposition"), rounded(F.col("priority"), 5).alias("priority"))
    cands = metrics(spark, sf_dir).withColumnRenamed("k", "candidate_id").withColumn("group_signature", (F.col("candidate_id") % 20).cast("string")).withColumn("core_architecture", F.lit(""))
    return bench.packages(cands, judged).select(F.col("candidate_id").alias("k"), "signature", "n", "kind", "place", "name")


# Metrics that no rule of the rubric names, and which ones are tried.
_UNNAMED = {"anchor_aa": "(k % 29) * 20.0", "free_share": "(28 - k % 29) / 28.0", "paired": "k % 29 >= 12"}
_TRIED = (*_UNNAMED, "novelty", "profile_z", "array_quality")
_OUTSIDE = "k % 29 >= 15"
_TRIED_SQL = "[" + ", ".join(f"{{'feature': '{f}', 'value': ({_UNNAMED.get(f, f)})::double}}" for f in _TRIED) + "]"


@query(f"""{_V}{_C[len(_M):]}, j AS (SELECT k, CASE WHEN k % 2 = 0 THEN {_OUTSIDE} ELSE len(failed) = 0 AND priority >= 0.55 END AS promoted FROM v), t AS (SELECT count(*) AS total FROM v),
l AS (SELECT promoted, unnest({_TRIED_SQL}) AS x FROM m JOIN j USING (k)), r AS (SELECT promoted, x.feature AS feature, x.value AS value, rank() OVER (PARTITION BY x.feature ORDER BY x.value) + (count(*) OVER (PARTITION BY x.feature, x.value) - 1) / 2.0 AS place FROM l),
a AS (SELECT feature, count(*) FILTER (promoted) AS p, count(*) FILTER (NOT promoted) AS n, sum(place) FILTER (promoted) AS ranks FROM r GROUP BY 1), b AS (SELECT feature, p + n AS n, round((ranks - p * (p + 1) / 2.0) / (p * n), 4) AS auroc FROM a WHERE p >= 2 AND n >= 2),
g AS (SELECT unnest([{', '.join(f"'{g}'" for g in _GATES)}]) AS gate), f AS (SELECT unnest(failed) AS gate, count(*) AS n FROM v GROUP BY 1), h AS (SELECT gate, coalesce(n, 0) AS n FROM g LEFT JOIN f USING (gate)),
o AS (SELECT evidence_key, count(*) AS n FROM s WHERE {_RANK.format('claimed')} > {_RANK.format('supported')} GROUP BY 1), q AS (SELECT evidence_key, n FROM o, t WHERE n >= greatest(2, total // 10) ORDER BY n DESC, evidence_key LIMIT 3)
SELECT CASE WHEN feature IN ({', '.join(f"'{f}'" for f in _UNNAMED)}) THEN 'add_score' ELSE 'reweight' END AS kind, feature AS target, 'external' AS basis, feature IN ({', '.join(f"'{f}'" for f in _UNNAMED)}) AND total >= 8 AS applied, auroc, n FROM b, t WHERE greatest(auroc, 1 - auroc) >= 0.7
UNION ALL SELECT CASE WHEN n = 0 THEN 'retire_gate' ELSE 'loosen_gate' END, gate, 'structural', false, NULL, n FROM h, t WHERE n = 0 OR n >= total UNION ALL SELECT 'guidance', evidence_key, 'structural', true, NULL, n FROM q""")
def rubric_revision(spark, sf_dir):
    """What to change in the rubric after a survey of all parts: half of them have labels from outside."""
    rubric = R.default_rubric()
    m = metrics(spark, sf_dir).selectExpr("*", *[f"{v} AS {c}" for c, v in _UNNAMED.items()])
    claimed = R.overclaims(_claims(spark, sf_dir)).groupBy("k").agg(F.collect_list(F.concat("evidence_key", F.lit(": asserted as "), "strength")).alias("overclaims"))
    judged = rubric.apply(m).join(claimed, "k", "left").withColumnRenamed("k", "candidate_id")
    label = F.when(F.expr(_OUTSIDE), "promote").otherwise("set_aside")
    labels = m.where("k % 2 = 0").select(F.col("k").alias("candidate_id"), label.alias("label"))
    cands, verdicts = judged.select("candidate_id", *_TRIED), judged.select("candidate_id", "disposition", "failed_gates", "overclaims")
    rows = outcomes.collected(cands, verdicts, labels)
    found = revision.proposed(rows, outcomes.separation(rows, list(_TRIED), revision.known_metrics(rubric)), rubric, external=True)
    return found.select("kind", "target", "basis", "applied", "auroc", "n")
