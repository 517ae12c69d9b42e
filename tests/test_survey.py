"""A survey of a small made-up corpus from end to end."""

import random

from pyspark.sql import functions as F

from locusframe.functions.sequence import AMINO
from locusframe.operators.locus import System
from locusframe.plans import outcomes, report, rubric, survey
from locusframe.sources.corpus import Corpus, discriminating_features, systems

MOTIF_A, MOTIF_C = "LADL", "YADD"


def corpus(spark):
    draw = random.Random(12)
    protein = lambda n: "".join(draw.choices(AMINO, k=n))
    near = lambda s, rate=0.2: "".join(draw.choice(AMINO) if draw.random() < rate else c for c in s)
    head, middle, tail = protein(30), protein(70), protein(30)
    anchor = lambda: near(head) + MOTIF_A + near(middle) + MOTIF_C + near(tail)
    effector, partner = protein(120), protein(110)
    contigs, genes, truth = [], [], []

    def contig(name, lineage, *proteins):
        at = 1000
        for i, p in enumerate(proteins):
            genes.append((f"{name}.{i}", name, at, at + 3 * len(p), 1, p))
            at += 3 * len(p) + 40
        contigs.append((name, "".join(draw.choices("ACGT", k=500)), lineage))

    for i in range(6):
        contig(f"new{i}", f"Bacteria;P{i % 3};x{i}", anchor(), near(partner), protein(90))
        truth.append((f"new{i}.0", "planted", True, ""))
    for i in range(4):
        contig(f"old{i}", f"Bacteria;P{i % 2};y{i}", anchor(), near(effector))
        truth.append((f"old{i}.0", "described", False, ""))
    for i in range(5):
        contig(f"back{i}", f"Bacteria;P{i % 2};z{i}", *(protein(80) for _ in range(3)))
    return Corpus(
        {
            "contigs": spark.createDataFrame(contigs, "contig_id string, dna string, lineage string"),
            "genes": spark.createDataFrame(genes, "gene_id string, contig_id string, start long, end long, strand int, protein string"),
            "references": spark.createDataFrame([("RT", anchor()), ("EFF", effector)], "family string, sequence string"),
            "truth": spark.createDataFrame(truth, "anchor_gene string, system_id string, is_novel boolean, kill_reason string"),
        }
    )


def test_survey_from_end_to_end(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    made = corpus(spark)
    made.write(str(tmp_path / "corpus"), with_truth=False)
    given = Corpus.read(spark, str(tmp_path / "corpus"), ("contigs", "genes", "references"))
    assert not (tmp_path / "corpus" / "truth").exists() and given.protein("new0.0").count() == 1 and given.contig_dna("new0").count() == 1
    state = survey.survey(given, rounds=1)
    labels = {r.gene_id: r.label for r in state.genes.collect()}
    assert all(labels[f"new{i}.0"] == "RT" and labels[f"new{i}.1"] == "unk" for i in range(6)) and all(labels[f"old{i}.0"] == "RT" and labels[f"old{i}.1"] == "EFF" for i in range(4))
    assert not any(v != "unk" for k, v in labels.items() if k.startswith("back"))
    described = systems([{"system_id": "described", "name": "described pair", "required": ["RT", "EFF"]}])
    loci = survey.located(given, state.genes, F.col("label") == "RT", described)
    expected = made["truth"].select("system_id", F.col("anchor_gene").alias("gene_id")).where("system_id = 'described'")
    targets = spark.createDataFrame([("described", 0.9, 0.9)], "system_id string, min_recall double, min_precision double")
    again = survey.reproduced(loci, expected, targets)
    shuffled = outcomes.shuffle_controls(given["genes"].select(F.col("gene_id").alias("seq_id"), "protein"), 10, F.col("protein"))
    false = survey.labelled(shuffled.select(F.col("control").alias("gene_id"), F.col("sequence").alias("protein")), state.models).where("label <> 'unk'").select(F.col("gene_id").alias("control"))
    control = outcomes.false_positive_rate(shuffled, false, 0.01)
    assert survey.gate(again, control).first().passed and again.first().recall == 1 and control.first().n == 10
    cands = survey.novel_candidates(given, state, "RT", described, background=10).checkpoint()
    rows = {r.anchor_protein: r for r in cands.collect()}
    assert set(rows) == {f"new{i}.0" for i in range(6)}
    one = rows["new0.0"]
    assert one.triad_intact and one.partner_conservation == 1.0 and one.n_independent_loci == 6 and one.n_phyla == 3 and one.array_quality == 0 and one.novelty >= 0.35 and one.n_clusters == 6
    found = report.reports(rubric.default_rubric().apply(cands.withColumn("n_predictions", F.lit(0))).withColumn("overclaims", F.array().cast("array<string>"))).checkpoint()
    r = found.first()
    assert r.n_predictions == len(r.predictions) >= 2 and 0 <= r.confidence <= 1 and r.function == "enzyme with a steady partner"
    verdicts = found.select("candidate_id", "disposition", "priority", "failed_gates", "overclaims")
    scores = {r.system_id: r for r in outcomes.system_scores(made["truth"], cands, verdicts).collect()}
    assert scores["planted"].planted == scores["planted"].reached == 6 and scores["described"].reached == 0 and scores["planted"].kind == "novel"
    packages = outcomes.bench_packages(cands.select("candidate_id", F.col("signature").alias("group_signature"), F.lit("").alias("core_architecture")), verdicts.withColumn("disposition", F.lit("promote")))
    assert packages.where("role = 'lead'").count() == 1 and packages.count() == 6


def test_transcripts_and_features(spark, tmp_path):
    rows = spark.createDataFrame([("s1", "f1", "judge", "x"), ("s2", "f2", "judge", "y")], "session_id string, fingerprint string, role string, output string")
    report.record(rows, str(tmp_path / "t"))
    report.record(rows.limit(1).withColumn("session_id", F.lit("s3")), str(tmp_path / "t"))
    known = report.recorded(spark, str(tmp_path / "t"))
    assert known.count() == 3
    asked = spark.createDataFrame([("s1", "f1"), ("s2", "other"), ("s9", "f2"), ("s8", "none")], "session_id string, fingerprint string")
    got = {r.session_id: (r.output, r.mismatch) for r in outcomes.replayed(asked, known).collect()}
    assert got == {"s1": ("x", False), "s2": (None, True), "s9": ("y", False), "s8": (None, False)}
    text = discriminating_features(System("a", "A", ("X",), forbidden=("Y",), requires_array=True, array_repeat_range=(20, 30)))
    assert text == "A: has X; lacks Y; with a repeat array; repeats of 20 to 30 bp"
