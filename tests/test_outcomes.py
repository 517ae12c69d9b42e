"""Small pieces of the stages: partners without a label, proposals, outcomes with labels, rubrics as text, controls and packages."""

import random

import pytest
from pyspark.sql import functions as F

from locusframe.functions.sequence import AMINO
from locusframe.operators import clusters
from locusframe.plans import bench, outcomes, rubric, survey


def test_numbers_follow_the_order_over_ranges(spark):
    draw = random.Random(1)
    rows = [(draw.randint(0, 9), f"r{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "n long, representative string")
    want = {r: i for i, (_, r) in enumerate(sorted(rows, key=lambda x: (-x[0], x[1])), 1)}
    out = clusters.numbered(df, F.desc("n"), F.asc("representative"))
    assert {r.representative: r.number for r in out.collect()} == want
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString().split("Scan")[0].replace("BroadcastExchange", "")
    assert clusters.numbered(df.limit(0), F.desc("n")).count() == 0


def test_unknown_partners_are_families_of_the_longest_neighbours(spark):
    draw = random.Random(2)
    one, two = ("".join(draw.choices(AMINO, k=n)) for n in (120, 90))
    alike = lambda s: "".join(draw.choice(AMINO) if draw.random() < 0.1 else c for c in s)
    proteins, loci = [], []
    gene = "struct<gene_id:string,label:string,aa_length:int,start:long>"
    for i in range(5):
        own = alike(one if i < 3 else two)
        genes = [(f"a{i}", "RT", 300, 0), (f"u{i}", "unk", len(own), 900), (f"s{i}", "unk", 30, 1500), (f"k{i}", "EFF", 400, 2000)]
        proteins += [(g[0], own if g[0][0] == "u" else "M" * g[2]) for g in genes]
        loci.append((f"c{i}", genes[0], genes))
    loci.append(("none", ("a9", "RT", 300, 0), [("a9", "RT", 300, 0), ("k9", "EFF", 10, 50)]))
    located = spark.createDataFrame(loci, f"contig_id string, anchor {gene}, operon array<{gene}>")
    got = {r.contig_id: (r.gene_id, r.family) for r in clusters.unknown_partners(located, spark.createDataFrame(proteins, "gene_id string, protein string")).collect()}
    assert got == {f"c{i}": (f"u{i}", "unkfam01" if i < 3 else "unkfam02") for i in range(5)}


def test_a_row_that_cannot_be_evaluated_fails_alone(spark):
    rows = outcomes.isolated(spark.createDataFrame([("1",), ("x",), (None,)], "v string"), F.expr("try_cast(v as int)")).collect()
    assert [(r.output, r.failed) for r in rows] == [(1, False), (None, True), (None, True)]


def test_collected_takes_outside_labels_first(spark):
    cands = spark.createDataFrame([(i, i * 1.0) for i in range(4)], "candidate_id int, x double")
    verdicts = spark.createDataFrame([(0, "promote"), (1, "hold"), (2, "promote")], "candidate_id int, disposition string")
    labels = spark.createDataFrame([(0, "set_aside"), (1, "promote")], "candidate_id int, label string")
    of = lambda df: {r.candidate_id: (r.promoted, r.external) for r in df.collect()}
    assert of(outcomes.collected(cands, verdicts)) == {0: (True, False), 1: (False, False), 2: (True, False)}
    assert of(outcomes.collected(cands, verdicts, labels)) == {0: (False, True), 1: (True, True), 2: (True, False)}


def test_proposals_say_on_what_they_rest(spark):
    separated = spark.createDataFrame([("a", 0.9, False), ("b", 0.1, True), ("c", 0.6, False)], "feature string, auroc double, in_rubric boolean")
    gates = spark.createDataFrame([("never", 0), ("always", 10), ("some", 4)], "gate string, n long")
    got = {tuple(r) for r in outcomes.proposals(separated, gates, 10, True).collect()}
    assert got == {("add_score", "a", "external"), ("reweight", "b", "external"), ("retire_gate", "never", "structural"), ("loosen_gate", "always", "structural")}
    assert {r.basis for r in outcomes.proposals(separated, gates, 10, False).collect()} == {"circular", "structural"}


def test_overclaim_patterns(spark):
    verdicts = spark.createDataFrame([(["novelty: asserted as direct", "array : asserted as strong"],), (["novelty: asserted as strong"],), ([],)], "overclaims array<string>")
    assert {tuple(r) for r in outcomes.overclaim_patterns(verdicts).collect()} == {("novelty", 2), ("array", 1)}


def test_rubrics_as_text_and_back():
    own = rubric.default_rubric()
    assert rubric.Rubric.from_dict(own.to_dict()) == own
    more = own.with_score(rubric.Score("length", "Is it long?", "clamp(anchor_aa / 400.0)", 0.5), "long ones were promoted")
    assert more.version == own.version + 1 and more.scores[:-1] == own.scores and more.history[-1] == "long ones were promoted"
    text = more.as_prompt()
    assert f"Rubric version {more.version}" in text and all(g.gate_id in text and g.expr in text for g in own.gates) and "- length (weight 0.5): Is it long? [clamp(anchor_aa / 400.0)]" in text


@pytest.mark.parametrize("planted", [False, True])
def test_shuffled_contigs_show_no_arrays(spark, planted):
    draw = random.Random(3)
    dna = lambda n: "".join(draw.choices("ACGT", k=n))
    unit = dna(30)
    rows = [(f"c{i}", dna(300) + "".join(unit + dna(35) for _ in range(9)) + dna(300)) for i in range(30)]
    control = survey.dna_control(spark.createDataFrame(rows, "contig_id string, dna string")).first()
    assert (control.n, control.n_found, control.passed) == (25, 0, True)
    if planted:  # a control that fails closes the gate
        from locusframe.operators import repeats

        same = spark.createDataFrame([(c, s) for c, s in rows], "control string, sequence string")
        found = repeats.repeat_arrays(same.selectExpr("control as contig_id", "sequence as dna")).select(F.col("contig_id").alias("control"))
        failed = outcomes.false_positive_rate(same, found, 0.04)
        systems = spark.createDataFrame([("x", True)], "system_id string, passed boolean")
        assert failed.first().rate == 1.0 and not survey.gate(systems, failed).first().passed and survey.gate(systems, survey.dna_control(same.selectExpr("control as contig_id", "sequence as dna"))).first().passed


def test_evidence_and_what_goes_beyond_it(spark):
    cand = dict(candidate_id="a", triad_intact=True, profile_z=25.0, core_coverage=0.9, novelty=0.7, partner_conservation=0.2, association_neglog_p=1.0, n_independent_loci=2, n_phyla=3, clade_restricted=False, array_quality=0.0, array_operon_gap_bp=9000, partner_known_neglog_e=5.0)
    df = spark.createDataFrame([cand])
    got = {r.evidence_key: (r.strength, r.supports) for r in rubric.evidence(df).collect()}
    assert got == {"catalytic_core": ("direct", True), "family_membership": ("direct", True), "architecture": ("strong", True), "partner_association": ("weak", False), "taxonomic_spread": ("strong", True), "noncoding_component": ("absent", False), "partner_is_known": ("strong", False)}
    claims = spark.createDataFrame([("a", "partner_association", "strong"), ("a", "catalytic_core", "direct"), ("a", "array_placement", "weak"), ("a", "noncoding_component", "absent")], "candidate_id string, evidence_key string, asserted string")
    assert {(r.evidence_key, r.held) for r in rubric.asserted_beyond(rubric.evidence(df), claims).collect()} == {("partner_association", "weak"), ("array_placement", "absent")}


def test_evidence_of_many_candidates_is_not_broadcast(spark, tmp_path):
    from locusframe.catalogue import rules

    spark.range(40_000).selectExpr("id AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    plan = rules.asserted_beyond_evidence(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_packages_have_what_their_metrics_ask_for(spark):
    rows = [("a", "x", 0.9, 0.9), ("b", "x", 0.1, 0.0), ("c", "y", 0.4, None), ("d", "z", 0.0, 0.0)]
    cands = spark.createDataFrame(rows, "candidate_id string, group_signature string, partner_conservation double, array_quality double").withColumn("core_architecture", F.lit(""))
    verdicts = spark.createDataFrame([("a", "promote", 0.9), ("b", "promote", 0.5), ("c", "promote", 0.1), ("d", "hold", 0.9)], "candidate_id string, disposition string, priority double")
    found = bench.packages(cands, verdicts).collect()
    names = {c: [r.name for r in sorted(found, key=lambda r: (r.kind, r.place)) if r.candidate_id == c] for c in "abcd"}
    assert len(names["a"]) == len(bench.COMPONENTS) and not names["b"] and not names["d"]
    assert set(names["c"]) == {c.name for c in bench.COMPONENTS if c.rule in ("", "partner_conservation >= 0.4")} and {r.n for r in found if r.candidate_id == "a"} == {2}
    places = sorted(r.place for r in found if r.candidate_id == "c" and r.kind == "control")
    assert places == [1, 2, 3, 4]
