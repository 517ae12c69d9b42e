"""The next version of a rubric, from what the outcomes of a survey say about it.

Counts and ranks over candidates are DataFrames; what reaches the driver is a row a metric, a row a gate and GUIDANCE rows at most.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import outcomes
from .rubric import Rubric, Score, names

#: Fewer candidates than this change no scores.
LEAST_ROWS = 8
#: Kinds of overclaim that become guidance, at most, and the weight of a score that is added.
GUIDANCE, WEIGHT = 3, 0.5


def proposed(rows: DataFrame, separated: DataFrame, rubric: Rubric, external: bool, least_rows: int = LEAST_ROWS, least_auroc: float = outcomes.LEAST_AUROC) -> DataFrame:
    """A row a proposal: kind, target, basis, applied, auroc, n (what it rests on), metric_kind and mean_promoted.

    rows: candidates with failed_gates and overclaims, as judged by the rubric; separated: see ``outcomes.separation``, rounded to four places here.
    Scores are added from ``least_rows`` candidates on. Weights and gates are only pointed at: a gate that never fires may be quiet because of what comes before it.
    Guidance is about what at least two candidates, and a tenth of all, claim too strongly. Nulls in overclaims or failed_gates count as none; an empty table proposes to look at every gate.
    """
    n_rows = rows.count()
    separated = separated.withColumns({c: F.round(c, 4) for c in ("auroc", "mean_promoted")})
    used = [g.gate_id for g in rubric.gates if g.enabled]
    gates = rubric.gate_activity(rows).where(F.col("gate_id").isin(used)).select(F.col("gate_id").alias("gate"), F.col("fired").alias("n"))
    found = outcomes.proposals(separated, gates, n_rows, external, least_auroc)
    facts = separated.select(F.lit(True).alias("of_metric"), F.col("feature").alias("target"), "auroc", (F.col("n_promoted") + F.col("n_set_aside")).alias("n"), F.col("kind").alias("metric_kind"), "mean_promoted")
    fired = gates.select(F.lit(False).alias("of_metric"), F.col("gate").alias("target"), F.lit(None).cast("double").alias("auroc"), "n", F.lit(None).cast("string").alias("metric_kind"), F.lit(None).cast("double").alias("mean_promoted"))
    found = found.withColumn("of_metric", F.col("kind").isin("add_score", "reweight")).join(facts.union(fired), ["of_metric", "target"])
    out = found.select("kind", "target", "basis", ((F.col("kind") == "add_score") & F.lit(n_rows >= least_rows)).alias("applied"), "auroc", "n", "metric_kind", "mean_promoted")
    often = outcomes.overclaim_patterns(rows).where(F.col("n") >= max(2, n_rows // 10)).orderBy(F.desc("n"), "key").limit(GUIDANCE)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("metric_kind", "string"), ("mean_promoted", "double"))]
    return out.union(often.select(F.lit("guidance"), F.col("key"), F.lit("structural"), F.lit(True), F.lit(None).cast("double"), "n", *none))


def learned(metric: str, metric_kind: str, auroc: float, mean_promoted: float) -> Score:
    """A score between 0 and 1 that grows with what promoted candidates have: the metric itself where it is a share, else in units of their mean."""
    if metric_kind == "boolean":
        rule = metric
    elif 0.0 <= mean_promoted <= 1.0:
        rule = f"clamp({metric})"
    else:
        rule = f"clamp({metric} / {max(abs(mean_promoted), 1e-6):.6g})"
    return Score(f"learned_{metric}", f"Is {metric} like that of promoted candidates? (AUROC {auroc:.2f})", rule if auroc >= 0.5 else f"1.0 - ({rule})", WEIGHT)


def advice(key: str, n: int, version: int) -> str:
    return f"Say of {key} no more than its measurement does: {n} reports by version {version} said more."


def next_version(rubric: Rubric, proposals: DataFrame, source: str = "verdicts") -> Rubric:
    """The rubric with what is applied of its proposals, a version later; the same rubric where nothing is. A score or advice that it has is not added again."""
    made = proposals.where("applied").orderBy("kind", "target").collect()
    if not made:
        return rubric
    have = {s.score_id for s in rubric.scores}
    scores = [learned(p.target, p.metric_kind, p.auroc, p.mean_promoted) for p in made if p.kind == "add_score"]
    guidance = [advice(p.target, p.n, rubric.version) for p in made if p.kind == "guidance"]
    did = "; ".join(f"{p.kind} {p.target} ({p.basis})" for p in made)
    return replace(
        rubric, version=rubric.version + 1, scores=(*rubric.scores, *[s for s in scores if s.score_id not in have]), guidance=(*rubric.guidance, *[g for g in guidance if g not in rubric.guidance]),
        history=(*rubric.history, f"from version {rubric.version}, labels of {source}: {did}"),
    )


def known_metrics(rubric: Rubric) -> list[str]:
    """What the rubric's gates and scores read."""
    rules = [*(g.expr for g in rubric.gates), *(s.expr for s in rubric.scores)]
    return sorted({n for r in rules for n in names(r)})
