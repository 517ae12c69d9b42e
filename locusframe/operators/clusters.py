"""Greedy clusters: the longest sequence first, each joining the first earlier representative that it is like.

Likeness is found for pairs by joins; what is sequential in the greedy order is settled in rounds over all sequences at once. In a
round, a sequence without an earlier undecided or chosen neighbour becomes a representative, and one whose first
neighbours are decided up to a representative joins it. Rounds are as many as the longest chain of neighbours that decide each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions.sequence import kmer_set

from . import alignment, similarity
from .checkpoints import checkpointed

IDENTITY, COVERAGE, JACCARD = 0.9, 0.8, 0.35


def alike(records: DataFrame, identity: float = IDENTITY, coverage: float = COVERAGE, jaccard: float = JACCARD, k: int = 4) -> DataFrame:
    """a and b of the pairs (a before b: longer, or of equal length the smaller id) of records (id, sequence) that a cluster may hold together."""
    sized = records.withColumn("n", F.length("sequence"))
    sets = sized.select("id", F.explode(kmer_set(F.col("sequence"), k)).alias("kmer"))
    near = similarity.shared_sets(sets.withColumnRenamed("id", "a"), sets.withColumnRenamed("id", "b"), "a", "b", "kmer", jaccard)
    x, y = (sized.select(F.col("id").alias(c), F.col("sequence").alias(f"s_{c}"), F.col("n").alias(f"n_{c}")) for c in "ab")
    pairs = near.select("a", "b").join(x, "a").join(y, "b").where((F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b"))))
    found = pairs.withColumn("x", alignment.local_alignment("s_b", "s_a"))
    good = (F.col("x.identity") >= identity) & (F.col("x.aligned_len") >= coverage * F.greatest(F.least("n_a", "n_b"), F.lit(1)))
    return found.where(good).select("a", "n_a", "b")


def greedy(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """id and representative of records (id, sequence) by pairs of alike()."""
    pairs = checkpointed(pairs)
    state = checkpointed(records.select("id", F.lit(None).cast(records.schema["id"].dataType).alias("representative")))
    first = Window.partitionBy("b").orderBy(F.desc("n_a"), "a")
    while True:
        # the earlier neighbours of undecided sequences in order, as far as the first that is itself a representative or undecided
        known = state.select(F.col("id").alias("a"), F.col("representative").alias("of_a"))
        todo = state.where("representative is null").select(F.col("id").alias("b"))
        open_pairs = pairs.join(todo, "b").join(known, "a").where("of_a is null or of_a = a")
        ahead = open_pairs.withColumn("place", F.row_number().over(first)).where("place = 1").select(F.col("b").alias("id"), "a", "of_a")
        told = todo.select(F.col("b").alias("id")).join(ahead, "id", "left")
        new = told.select("id", F.when(F.col("a").isNull(), F.col("id")).when(F.col("of_a").isNotNull(), F.col("a")).alias("new")).where("new is not null")
        new = checkpointed(new)
        if new.isEmpty():
            return state
        state = checkpointed(state.join(new, "id", "left").select("id", F.coalesce("representative", "new").alias("representative")))


def greedy_clusters(records: DataFrame, identity: float = IDENTITY, coverage: float = COVERAGE, jaccard: float = JACCARD) -> DataFrame:
    """id and representative of each of records (id, sequence)."""
    return greedy(records, alike(records, identity, coverage, jaccard))


def non_redundant(clusters: DataFrame) -> DataFrame:
    """The representatives' ids."""
    return clusters.where("id = representative").select("id")


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with number, their places by order from 1.

    They are sorted in ranges; a row's number is its place in its range and the counts of the ranges before, an array with an entry a range. No task sees all.
    """
    placed = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id_", F.monotonically_increasing_id()))
    placed = placed.withColumn("range_", F.shiftright("id_", 33))
    counts = placed.groupBy("range_").agg(F.count("*").alias("n_")).agg(F.collect_list(F.struct("range_", "n_")).alias("counts_"))
    before = F.aggregate(F.filter("counts_", lambda x: x["range_"] < F.col("range_")), F.lit(0).cast("long"), lambda t, x: t + x["n_"])
    first = F.shiftleft("range_", 33)
    return placed.crossJoin(F.broadcast(counts)).withColumn("number", before + F.col("id_") - first + 1).drop("id_", "range_", "counts_")  # one row


def unknown_partners(located: DataFrame, proteins: DataFrame, unknown: str = "unk") -> DataFrame:
    """contig_id, anchor_id, gene_id and family of each locus' longest operon neighbour without a label; families are clusters of these, numbered by size, then representative."""
    others = located.select("contig_id", F.col("anchor.gene_id").alias("anchor_id"), F.explode(F.filter("operon", lambda g: (g["label"] == unknown) & (g["gene_id"] != F.col("anchor.gene_id")))).alias("g"))
    longest = others.groupBy("contig_id", "anchor_id").agg(F.max_by("g.gene_id", F.struct("g.aa_length", -F.col("g.start"))).alias("gene_id"))
    records = proteins.join(longest.select("gene_id").distinct(), "gene_id").select(F.col("gene_id").alias("id"), F.col("protein").alias("sequence"))
    found = greedy_clusters(records, identity=0.35, coverage=0.5, jaccard=0.15)
    sizes = found.groupBy("representative").agg(F.count("*").alias("n"))
    order = numbered(sizes, F.desc("n"), F.asc("representative")).select("representative", F.format_string("unkfam%02d", F.col("number")).alias("family"))
    return longest.join(found.withColumnRenamed("id", "gene_id"), "gene_id").join(order, "representative").select("contig_id", "anchor_id", "gene_id", "family")
