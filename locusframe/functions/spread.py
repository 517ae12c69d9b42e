"""How widely sets of sequences are spread over lineages, and how well sets agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESTRICTED = 0.8


def taxonomic_spread(df: DataFrame, by: list[str], lineage: str) -> DataFrame:
    """A row a group: n_sequences, n_taxa, n_phyla, largest_fraction (of a phylum) and clade_restricted.

    A lineage is ``domain;phylum;...``; its phylum is the second part, else the first, else "unknown". Phyla are counted before
    they are gathered, so a large group is a few rows.
    """
    parts = F.split(F.coalesce(lineage, F.lit("")), ";")
    part = lambda i: F.nullif(F.trim(F.try_element_at(parts, F.lit(i))), F.lit(""))
    phylum = F.coalesce(part(2), part(1), F.lit("unknown"))
    taxa = df.groupBy(*by, phylum.alias("phylum"), lineage).agg(F.count("*").alias("n"))
    phyla = taxa.groupBy(*by, "phylum").agg(F.sum("n").alias("n"), F.count("*").alias("taxa"))
    out = phyla.groupBy(*by).agg(F.sum("n").alias("n_sequences"), F.sum("taxa").alias("n_taxa"), F.count("*").alias("n_phyla"), (F.max("n") / F.sum("n")).alias("largest_fraction"))
    return out.withColumn("clade_restricted", (F.col("largest_fraction") > RESTRICTED) | (F.col("n_phyla") <= 1))


def recall_precision(expected: DataFrame, recovered: DataFrame, key: str, by: list[str]) -> DataFrame:
    """A row a group of two tables of distinct keys: n_expected, n_recovered, n_both, recall and precision (0 without any)."""
    joined = expected.withColumn("e", F.lit(1)).join(recovered.withColumn("r", F.lit(1)), [*by, key], "full")
    out = joined.groupBy(*by).agg(F.count("e").alias("n_expected"), F.count("r").alias("n_recovered"), F.count(F.when(F.col("e").isNotNull() & F.col("r").isNotNull(), 1)).alias("n_both"))
    share = lambda n: F.when(F.col(n) > 0, F.col("n_both") / F.col(n)).otherwise(0.0)
    return out.withColumns({"recall": share("n_expected"), "precision": share("n_recovered")})
