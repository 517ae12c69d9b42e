"""A corpus of contigs, genes and references as tables in a folder, and draws from it that every run repeats."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.functions import stats
from locusframe.operators import locus, repeats

TABLES = ("contigs", "genes", "references", "systems", "targets")
#: Known only to scoring: kept apart from the tables that stages read.
TRUTH = "truth"


@dataclass(frozen=True)
class Corpus:
    """Tables by name. ``contigs`` (contig_id, dna, lineage), ``genes`` (gene_id, contig_id, start, end, strand, protein, label), ``references`` (family, sequence), ``systems``, ``targets``."""

    tables: dict[str, DataFrame]

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def write(self, path: str, with_truth: bool = True) -> None:
        for name, table in self.tables.items():
            if name != TRUTH or with_truth:
                table.write.parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str, names: tuple[str, ...] = TABLES) -> Corpus:
        return cls({n: spark.read.parquet(f"{path}/{n}") for n in names})

    def proteins(self) -> DataFrame:
        """All genes with their contig's lineage."""
        return self["genes"].join(self["contigs"].select("contig_id", "lineage"), "contig_id", "left")

    def protein(self, gene_id: str) -> DataFrame:
        return self.proteins().where(F.col("gene_id") == gene_id)

    def contig_dna(self, contig_id: str) -> DataFrame:
        return self["contigs"].where(F.col("contig_id") == contig_id).select("dna")

    def arrays(self) -> DataFrame:
        return repeats.repeat_arrays(self["contigs"].select("contig_id", "dna"))

    def loci(self, is_anchor: Column) -> DataFrame:
        """Loci of anchor genes with operons and the repeat arrays found on their contigs."""
        genes = self["genes"].withColumn("aa_length", F.length("protein"))
        return locus.with_arrays(locus.with_operon(locus.loci(genes, is_anchor)), self.arrays())


def drawn(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows in an order drawn by a hash of the seed and the key."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key))), key).limit(n)


def family_seed(reference: DataFrame, members: DataFrame, step: int, limit: int) -> DataFrame:
    """A family's described sequence and every ``step``-th of its members by length, then member (family, member, sequence), ``limit`` of a family at most.

    Places are running counts of lengths and, within a length, of members: a family is not sorted in one task.
    """
    sized = members.withColumn("size_", F.length("sequence"))
    lengths = stats.running(sized.groupBy("family", "size_").agg(F.count("*").alias("n_")), ["family"], F.floor(F.log2(F.col("size_") + 1) * 8), "size_", {"upto_": "n_"})
    within = F.row_number().over(Window.partitionBy("family", "size_").orderBy("member"))
    place = sized.withColumn("within_", within).join(lengths, ["family", "size_"]).withColumn("place_", F.col("upto_") - F.col("n_") + F.col("within_") - 1)
    every = place.where((F.col("place_") % step == 0) & (F.col("place_") / step < limit - 1))
    return reference.select("family", F.lit("reference").alias("member"), "sequence").union(every.select("family", F.col("member").cast("string"), "sequence"))


def systems(described: list[dict]) -> list[locus.System]:
    """Described systems as the catalogue that loci are matched with; keys as locus.System's, lists or tuples, the rest left to its defaults."""
    tuples = ("required", "optional", "forbidden", "array_repeat_range", "anchor_aa")
    return [locus.System(**{k: tuple(v) if k in tuples and v is not None else v for k, v in d.items()}) for d in described]


def discriminating_features(system: locus.System) -> str:
    """A system's marks in words."""
    parts = ["has " + ", ".join(system.required)] if system.required else []
    parts += ["lacks " + ", ".join(system.forbidden)] if system.forbidden else []
    parts += ["with a repeat array"] if system.requires_array else ["without a repeat array"] if system.forbids_array else []
    parts += ["repeats of {} to {} bp".format(*system.array_repeat_range)] if system.array_repeat_range else []
    parts += ["anchor of {} to {} aa".format(*system.anchor_aa)] if system.anchor_aa else []
    return f"{system.name}: " + "; ".join(parts or ["no marks"])
