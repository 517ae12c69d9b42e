"""What comes of a survey: candidates with their metrics, packages for the bench, scores against planted truth, and what separates outcomes.

Tables: ``candidates`` (candidate_id, anchor_protein, group_signature, core_architecture, metrics as columns), ``verdicts``
(candidate_id, disposition, priority, failed_gates, overclaims), ``truth`` (anchor_gene, system_id, is_novel, kill_reason).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions import sequence, spread, stats, windows
from locusframe.operators import locus, motif_sets, repeats, search
from locusframe.operators.profiles import shuffled

DECOY, LEAST_AUROC, KNOWN_EVALUE = "decoy:", 0.7, 1.0


# ---- candidates


def group_metrics(located: DataFrame, background: DataFrame, lineages: DataFrame, clustered: DataFrame, alpha: float = 0.05) -> DataFrame:
    """A row an architecture (signature) of loci with operon and arrays: its size, clusters, taxa, and each partner label's conservation and enrichment over background loci.

    lineages: contig_id and lineage; clustered: id and representative of the anchors' proteins.
    """
    of = located.withColumn("signature", locus.architecture(F.col("operon"), F.col("arrays"), F.col("anchor"), "class"))
    sizes = of.groupBy("signature").agg(F.count("*").alias("n_independent_loci"))
    taxa = spread.taxonomic_spread(of.select("signature", "contig_id").join(lineages, "contig_id"), ["signature"], "lineage")
    kinds = of.select("signature", F.col("anchor.gene_id").alias("id")).join(clustered, "id").groupBy("signature").agg(F.count_distinct("representative").alias("n_clusters"))
    here = locus.conservation(of, ["signature"])
    there = locus.conservation(background).select("label", F.col("n_loci").alias("c"))
    total = background.agg(F.count("*").alias("n_background"))
    cells = here.join(sizes, "signature").join(there, "label", "left").crossJoin(F.broadcast(total))  # one row
    cells = cells.select("signature", "label", "rate", F.col("n_loci").alias("a"), (F.col("n_independent_loci") - F.col("n_loci")).alias("b"), F.coalesce("c", F.lit(0)).alias("c"), (F.col("n_background") - F.coalesce("c", F.lit(0))).alias("d"))
    tested = cells.withColumn("p_value", stats.fisher_p(*[F.col(x) for x in "abcd"])).withColumn("key", F.concat_ws("\u001f", "signature", "label"))
    flagged = stats.benjamini_hochberg(tested.select("key", "p_value"), "p_value", alpha=alpha).select("key", "rejected")
    partners = tested.join(flagged, "key").groupBy("signature").agg(F.map_from_entries(F.collect_list(F.struct("label", F.struct("rate", "p_value", F.col("rejected").alias("significant"))))).alias("partners"))
    return sizes.join(taxa, "signature").join(kinds, "signature").join(partners, "signature", "left")


def partner_homology(partners: DataFrame, references: DataFrame, anchor_family: str) -> DataFrame:
    """candidate_id, known_neglog_e and known_bits: the best sensitive hit of a candidate's partners (candidate_id, gene_id, protein) among the described families but the anchor's own."""
    targets = references.where(F.col("family") != anchor_family).select(F.col("family").alias("target"), F.col("sequence").alias("t_seq"))
    queries = partners.where("protein <> ''").select(F.col("gene_id").alias("query"), F.col("protein").alias("q_seq")).dropDuplicates(["query"])
    found = search.hits(search.sequence_search(queries, targets, max_evalue=KNOWN_EVALUE, limit=1)).select(F.col("query").alias("gene_id"), "evalue", "bits")
    best = partners.join(found, "gene_id").groupBy("candidate_id").agg(F.min_by(F.struct("evalue", "bits"), "evalue").alias("x"))
    own = partners.select("candidate_id").distinct().join(best, "candidate_id", "left")
    known = F.when(F.col("x").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), stats.neglog(F.col("x.evalue"))))
    return own.select("candidate_id", known.alias("known_neglog_e"), F.coalesce("x.bits", F.lit(0.0)).alias("known_bits"))


def candidates(located: DataFrame, hits: DataFrame, groups: DataFrame, homology: DataFrame, profile_length: int, proteins: DataFrame, unknown: str = "unk") -> DataFrame:
    """One wide row of metrics a novel locus. located: with operon, arrays, best and novelty; hits: query's profile search by target; proteins: gene_id and protein."""
    of = located.withColumn("signature", locus.architecture(F.col("operon"), F.col("arrays"), F.col("anchor"), "class")).withColumn("gene_id", F.col("anchor.gene_id"))
    anchors = of.join(proteins, "gene_id")
    triads = motif_sets.triad(anchors, "gene_id", sequence.clean_protein(F.col("protein")))
    found = hits.select(F.col("target").alias("gene_id"), "z", "evalue", "core_coverage", F.col("alignment.aligned_len").alias("aligned_len"))
    rows = anchors.join(triads, "gene_id").join(found, "gene_id").join(groups, "signature").join(homology.withColumnRenamed("candidate_id", "gene_id"), "gene_id", "left")
    labels = F.transform(F.filter("operon", lambda g: g["gene_id"] != F.col("gene_id")), lambda g: g["label"])
    rate = F.coalesce(F.array_max(F.transform(labels, lambda x: F.coalesce(F.try_element_at("partners", x)["rate"], F.lit(0.0)))), F.lit(0.0))
    known = F.get(F.filter(labels, lambda x: x != unknown), 0)
    tested = F.coalesce(F.try_element_at("partners", F.lit(unknown)), F.try_element_at("partners", F.coalesce(known, F.lit(unknown))))
    good = F.filter("arrays", lambda a: a["copy_number"] >= repeats.COPIES)
    best = F.array_max(F.transform(good, lambda a: F.struct(F.coalesce(a["quality"], F.lit(0.0)).alias("q"), (-a["start"]).alias("s"), a.alias("a"))))
    rows = rows.withColumn("best_array", best)
    only = F.when(F.col("best_array").isNotNull(), F.array(F.col("best_array.a"))).otherwise(F.array().cast(locus.ARRAYS))
    return rows.select(
        F.concat(F.lit("cand-"), "gene_id").alias("candidate_id"), F.col("gene_id").alias("anchor_protein"), "contig_id", "signature", F.col("intact").alias("triad_intact"), "reason",
        "core_coverage", (F.col("aligned_len") / F.greatest(F.lit(profile_length), F.lit(1))).alias("aligned_fraction"), windows.low_complexity_fraction("protein").alias("low_complexity"), "evalue", F.col("z").alias("profile_z"),
        "novelty", rate.alias("partner_conservation"), F.coalesce("known_neglog_e", F.lit(0.0)).alias("partner_known_neglog_e"), "n_independent_loci", "n_clusters", "n_taxa", "n_phyla", "clade_restricted",
        F.coalesce(stats.neglog(tested["p_value"]), F.lit(0.0)).alias("association_neglog_p"), F.coalesce(tested["significant"], F.lit(False)).alias("association_significant"),
        F.coalesce("best_array.q", F.lit(0.0)).alias("array_quality"), F.coalesce("best_array.a.copy_number", F.lit(0)).alias("array_copies"), locus.array_distance(F.col("operon"), only).alias("array_operon_gap_bp"), F.length("protein").alias("anchor_aa"),
    )


# ---- outcomes


def collected(cands: DataFrame, verdicts: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """cands with verdict columns and ``promoted``, by an outside label (candidate_id, label) where there is one; ``external`` says so. Candidates without a verdict are left out."""
    rows = cands.join(verdicts, "candidate_id")
    if labels is None:
        return rows.withColumn("promoted", F.col("disposition") == "promote").withColumn("external", F.lit(False))
    rows = rows.join(labels.withColumnRenamed("label", "given_"), "candidate_id", "left")
    return rows.withColumn("promoted", F.coalesce("given_", "disposition") == "promote").withColumn("external", F.col("given_").isNotNull()).drop("given_")


def separation(rows: DataFrame, metrics: list[str], known: list[str] = (), least: int = 2) -> DataFrame:
    """How well each metric separates the promoted from the rest: auroc, counts, means, kind, and whether the rubric knows it. Metrics with fewer than ``least`` values of a class have no row."""
    long = rows.select("promoted", *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(["promoted"], metrics, "feature", "value").where("value is not null")
    mean = lambda of: F.avg(F.when(of, F.col("value")))
    about = long.groupBy("feature").agg(
        F.sum(F.col("promoted").cast("long")).alias("n_promoted"), F.sum((~F.col("promoted")).cast("long")).alias("n_set_aside"), mean(F.col("promoted")).alias("mean_promoted"), mean(~F.col("promoted")).alias("mean_set_aside"),
        F.bool_and(F.col("value").isin(0.0, 1.0)).alias("boolean"),
    )
    enough = about.where((F.col("n_promoted") >= least) & (F.col("n_set_aside") >= least))
    ranks = stats.auroc(long, "feature", "value", "promoted").select("feature", "auroc")
    kind = F.when(F.col("boolean"), "boolean").otherwise("numeric")
    out = enough.join(ranks, "feature").withColumn("kind", kind).withColumn("in_rubric", F.col("feature").isin(*known) if known else F.lit(False))
    return out.withColumn("strength", F.abs(F.col("auroc") - 0.5)).drop("boolean")


def proposals(separated: DataFrame, gates: DataFrame, n_rows: int, external: bool, least_auroc: float = LEAST_AUROC) -> DataFrame:
    """What to change in a rubric: kind, target and basis. Metrics that separate and are not in it are to be added, gates (gate, n) that never or always fire looked at.

    The basis is ``external`` where outside labels were used, ``structural`` for what follows from the gates or from a metric that no rule names, else ``circular``.
    """
    strong = F.greatest(F.col("auroc"), 1 - F.col("auroc")) >= least_auroc
    add = separated.where(strong & ~F.col("in_rubric")).select(F.lit("add_score").alias("kind"), F.col("feature").alias("target"), F.lit("external" if external else "structural").alias("basis"))
    weigh = separated.where(strong & F.col("in_rubric")).select(F.lit("reweight").alias("kind"), F.col("feature").alias("target"), F.lit("external" if external else "circular").alias("basis"))
    kind = F.when(F.col("n") == 0, "retire_gate").when(F.col("n") >= n_rows, "loosen_gate")
    return add.union(weigh).union(gates.select(kind.alias("kind"), F.col("gate").alias("target"), F.lit("structural").alias("basis")).where("kind is not null"))


def bench_packages(cands: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Promoted candidates, one package an architecture: signature, candidate_id, lead (of the highest priority the first id), role (lead or supporting), priority and n of the package."""
    rows = cands.join(verdicts.where("disposition = 'promote'").select("candidate_id", "priority"), "candidate_id")
    signature = F.when(F.coalesce("group_signature", F.lit("")) != "", F.col("group_signature")).otherwise(F.col("core_architecture"))
    rows = rows.select(signature.alias("signature"), "candidate_id", "priority")
    leads = rows.groupBy("signature").agg(F.min_by("candidate_id", F.struct(-F.col("priority"), "candidate_id")).alias("lead"), F.count("*").alias("n"))
    role = F.when(F.col("candidate_id") == F.col("lead"), "lead").otherwise("supporting")
    return rows.join(leads, "signature").select("signature", "candidate_id", "lead", role.alias("role"), "priority", "n")


def system_scores(truth: DataFrame, cands: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A row a planted system: planted loci, how many became candidates, how many were promoted or killed, and whether it is novel, a decoy or described."""
    reached = cands.select("candidate_id", F.col("anchor_protein").alias("anchor_gene")).join(verdicts.select("candidate_id", "disposition"), "candidate_id", "left")
    rows = truth.join(reached, "anchor_gene", "left")
    kind = F.when(F.startswith("system_id", F.lit(DECOY)), "decoy").when(F.bool_or("is_novel"), "novel").otherwise("described")
    promoted = F.sum((F.coalesce(F.col("disposition"), F.lit("")) == "promote").cast("long"))
    out = rows.groupBy("system_id").agg(kind.alias("kind"), F.count_distinct("anchor_gene").alias("planted"), F.count("candidate_id").alias("reached"), promoted.alias("promoted"), F.min("kill_reason").alias("kill_reason"))
    return out.withColumn("killed", F.col("reached") - F.col("promoted"))


def gates_by_system(truth: DataFrame, cands: DataFrame, verdicts: DataFrame) -> DataFrame:
    """system_id, gate and n: which gates stopped the candidates of planted decoys."""
    rows = truth.where(F.startswith("system_id", F.lit(DECOY))).join(cands.select("candidate_id", F.col("anchor_protein").alias("anchor_gene")), "anchor_gene").join(verdicts, "candidate_id")
    return rows.select("system_id", F.explode("failed_gates").alias("gate")).groupBy("system_id", "gate").agg(F.count("*").alias("n"))


def unexplained(truth: DataFrame, cands: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Promoted candidates whose anchor was not planted, or was planted as a described system (system_id)."""
    rows = verdicts.where("disposition = 'promote'").join(cands, "candidate_id").select("candidate_id", F.col("anchor_protein").alias("anchor_gene"))
    known = rows.join(truth, "anchor_gene", "left")
    return known.where("system_id is null or not (is_novel or startswith(system_id, 'decoy:'))").select("candidate_id", "system_id")


def overclaim_patterns(verdicts: DataFrame) -> DataFrame:
    """key and n of overclaims (``key: asserted as ...``)."""
    key = F.substring(F.trim(F.substring_index("text", ":", 1)), 1, 80)
    return verdicts.select(F.explode("overclaims").alias("text")).groupBy(key.alias("key")).agg(F.count("*").alias("n"))


# ---- controls


def shuffle_controls(sequences: DataFrame, n: int, letters: Column) -> DataFrame:
    """n shuffled sequences (control, sequence), each a given one's letters in an order drawn by a hash: what a search finds in them is chance."""
    drawn = sequences.withColumn("letters_", letters).where("letters_ <> ''").orderBy(F.md5(F.col("seq_id").cast("string")), "seq_id").limit(n)
    return drawn.select(F.col("seq_id").alias("control"), shuffled(F.col("letters_"), F.col("seq_id").cast("string")).alias("sequence"))


def false_positive_rate(controls: DataFrame, found: DataFrame, most: float) -> DataFrame:
    """One row: controls, false positives (found: control), their rate, and whether it is low enough."""
    rows = controls.select("control").distinct().join(found.select("control", F.lit(1).alias("hit")).distinct(), "control", "left")
    out = rows.agg(F.count("*").alias("n"), F.count("hit").alias("n_found"))
    rate = F.when(F.col("n") > 0, F.col("n_found") / F.col("n")).otherwise(0.0)
    return out.withColumn("rate", rate).withColumn("passed", F.col("rate") <= most)


def replayed(sessions: DataFrame, recorded: DataFrame) -> DataFrame:
    """sessions (session_id, fingerprint) with the recorded output (session_id, fingerprint, output) of their id if its fingerprint agrees, else of any session of their fingerprint; ``mismatch`` where the id was recorded with another content."""
    by_id = recorded.groupBy("session_id").agg(F.max_by(F.struct("fingerprint", "output"), "fingerprint").alias("own_"))
    by_print = recorded.groupBy("fingerprint").agg(F.min_by("output", "session_id").alias("other_"))
    rows = sessions.join(by_id, "session_id", "left").join(by_print, "fingerprint", "left")
    same = F.col("own_.fingerprint") == F.col("fingerprint")
    return rows.select("session_id", "fingerprint", F.when(same, F.col("own_.output")).otherwise(F.col("other_")).alias("output"), F.coalesce(~same, F.lit(False)).alias("mismatch"))


def isolated(rows: DataFrame, evaluate: Column) -> DataFrame:
    """rows with output and failed: a row whose evaluation gives null fails alone. evaluate should use try_ functions."""
    return rows.withColumn("output", evaluate).withColumn("failed", F.col("output").isNull())


def top_candidates(cands: DataFrame, most: int = 60) -> DataFrame:
    """The most novel candidates, most first."""
    return cands.orderBy(F.desc("novelty"), "candidate_id").limit(most)
