"""The stages of a survey over a corpus: family models and labels, the reproduction of described systems, and the search for novel loci.

Each stage is a composition of operators on tables; what a stage hands on are DataFrames.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.functions import spread
from locusframe.operators import clusters, locus, repeats, search
from locusframe.operators.checkpoints import checkpointed
from locusframe.sources.corpus import Corpus

from . import outcomes

LEAST_Z, LEAST_COVERAGE, LEAST_NOVELTY = 8.0, 0.5, 0.35
#: Shuffled contigs of a control, and the share of them that may show an array.
DNA_SHUFFLES, DNA_RATE = 25, 0.04


@dataclass(frozen=True)
class Survey:
    models: DataFrame
    members: DataFrame
    #: genes with their family as label, ``unk`` without one
    genes: DataFrame


def labelled(genes: DataFrame, models: DataFrame, least_z: float = LEAST_Z, least_coverage: float = LEAST_COVERAGE) -> DataFrame:
    """genes (gene_id, protein, ...) with label, z, runner_up: the best of the families' profiles, or ``unk``. Proteins that no model was made from are labelled alike."""
    targets = genes.select(F.col("gene_id").alias("target"), F.col("protein").alias("t_seq")).where("protein is not null and protein <> ''")
    found = search.hits(search.profile_search(models, targets, least_z=least_z, least_core=0.0, max_evalue=float("inf")))
    scores = found.select(F.col("target").alias("gene"), F.col("query").alias("family"), "z", F.col("core_coverage").alias("coverage"))
    calls = search.called(scores, least_z, least_coverage).select(F.col("gene").alias("gene_id"), "label", "z", "runner_up")
    return genes.drop("label").join(calls, "gene_id", "left").withColumn("label", F.coalesce("label", F.lit("unk")))


def survey(corpus: Corpus, rounds: int = 2) -> Survey:
    """Models of all described families from one reference each, and all genes labelled by them."""
    proteins = corpus["genes"].select(F.col("gene_id").alias("target"), F.col("protein").alias("t_seq"))
    seeds = corpus["references"].select("family", F.lit("reference").alias("member"), "sequence")
    models, members = search.bootstrapped(seeds, proteins, rounds)
    return Survey(models, members, checkpointed(labelled(corpus["genes"], models)))


def located(corpus: Corpus, genes: DataFrame, is_anchor, systems: list[locus.System]) -> DataFrame:
    """Loci of labelled genes with operon, arrays, matches with the described systems and novelty."""
    own = genes.withColumn("aa_length", F.length("protein"))
    found = locus.with_arrays(locus.with_operon(locus.loci(own, is_anchor)), corpus.arrays())
    return checkpointed(locus.with_novelty(locus.with_matches(found, systems)))


def reproduced(loci: DataFrame, expected: DataFrame, targets: DataFrame) -> DataFrame:
    """system_id, recall, precision and passed of described systems: the loci that match each (the best match alone) against the expected (system_id, gene_id); targets: least recall and precision of a system."""
    recovered = loci.where(locus.is_match(F.col("best"))).select(F.col("best.system_id").alias("system_id"), F.col("anchor.gene_id").alias("gene_id"))
    both = spread.recall_precision(expected.select("system_id", "gene_id"), recovered, "gene_id", ["system_id"])
    out = targets.join(both, "system_id", "left")
    passed = (F.coalesce("recall", F.lit(0.0)) >= F.col("min_recall")) & (F.coalesce("precision", F.lit(0.0)) >= F.col("min_precision"))
    return out.withColumn("passed", passed)


def dna_control(contigs: DataFrame, n: int = DNA_SHUFFLES, most: float = DNA_RATE) -> DataFrame:
    """One row for the gate: n shuffled contigs (contig_id, dna), how many show a regular array, the rate, and whether it is low enough.

    A contig's letters are put in an order drawn by a hash, so that its composition stays and every run shuffles alike. n is the control's size.
    """
    controls = checkpointed(outcomes.shuffle_controls(contigs.withColumnRenamed("contig_id", "seq_id"), n, F.upper("dna")))
    found = repeats.repeat_arrays(controls.select(F.col("control").alias("contig_id"), F.col("sequence").alias("dna"))).where((F.col("copy_number") >= repeats.COPIES) & (F.col("regularity") > repeats.REGULAR))
    return outcomes.false_positive_rate(controls, found.select(F.col("contig_id").alias("control")), most)


def gate(reproduced_systems: DataFrame, *controls: DataFrame) -> DataFrame:
    """One row: passed, where at least one system was tried, all of them passed, and so did all controls (rows with passed)."""
    systems = reproduced_systems.agg(F.count("*").alias("n_systems"), F.coalesce(F.bool_and("passed"), F.lit(False)).alias("passed"))
    for i, control in enumerate(controls):
        systems = systems.crossJoin(F.broadcast(control.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias(f"control_{i}"))))  # one row
    good = F.col("passed") & (F.col("n_systems") > 0)
    for i in range(len(controls)):
        good = good & F.col(f"control_{i}")
    return systems.select("n_systems", good.alias("passed"))


def novel_candidates(corpus: Corpus, state: Survey, anchor_family: str, systems: list[locus.System], background: int = 250, seed: int = 7, least_novelty: float = LEAST_NOVELTY, most: int = 60) -> DataFrame:
    """The candidates of a survey: novel loci of the anchor family, measured against each other and against background loci of drawn genes."""
    found = located(corpus, state.genes, F.col("label") == anchor_family, systems).where(F.col("novelty") >= least_novelty)
    draw = state.genes.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "gene_id")), "gene_id").limit(background).select("gene_id")
    marked = state.genes.join(draw.withColumn("drawn", F.lit(True)), "gene_id", "left")
    others = located(corpus, marked, F.coalesce("drawn", F.lit(False)), systems)
    proteins = corpus["genes"].select("gene_id", "protein")
    records = found.select(F.col("anchor.gene_id").alias("gene_id")).join(proteins, "gene_id").select(F.col("gene_id").alias("id"), F.col("protein").alias("sequence"))
    groups = outcomes.group_metrics(found, others, corpus["contigs"].select("contig_id", "lineage"), clusters.greedy_clusters(records))
    partners = found.select(F.col("anchor.gene_id").alias("candidate_id"), F.explode(F.filter("operon", lambda g: g["gene_id"] != F.col("anchor.gene_id"))).alias("g"))
    partners = partners.select("candidate_id", F.col("g.gene_id").alias("gene_id")).join(proteins, "gene_id")
    homology = outcomes.partner_homology(partners, corpus["references"], anchor_family)
    anchors = found.select(F.col("anchor.gene_id").alias("gene_id")).join(proteins, "gene_id").select(F.col("gene_id").alias("target"), F.col("protein").alias("t_seq"))
    model = state.models.where(F.col("family") == anchor_family)
    hits = search.hits(search.profile_search(model, anchors, least_z=LEAST_Z, least_core=0.0, max_evalue=float("inf")))
    length = model.select(F.size("pssm")).first()
    return outcomes.top_candidates(outcomes.candidates(found, hits, groups, homology, length[0] if length else 1, proteins), most)
