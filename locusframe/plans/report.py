"""Reports on candidates: what a candidate may be, what would show it to be wrong, and how sure its measurements make that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAILED_SHARE, DEAD_CONFIDENCE, FAR_ARRAY = 0.5, 0.05, 3000


def _listed(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def predictions() -> Column:
    """Experiments that can fail, of a candidate's metrics."""
    near = (F.col("array_quality") >= 0.4) & (F.col("array_operon_gap_bp") <= FAR_ARRAY)
    return _listed(
        F.when(F.col("triad_intact"), "mutating the catalytic residues abolishes activity"),
        F.when(F.col("partner_conservation") >= 0.5, "deleting the partner abolishes the phenotype of the locus"),
        F.when(near, "the array is transcribed and cut at its repeats"),
        F.when(F.col("n_phyla") >= 2, "the locus works in a host of another phylum"),
    )


def alternatives() -> Column:
    """Other readings of the same measurements."""
    return _listed(
        F.when(~F.col("triad_intact"), "a dead copy that is kept by drift"),
        F.when(F.col("clade_restricted"), "a neighbourhood kept by common descent alone"),
        F.when(F.col("partner_known_neglog_e") >= 3.0, "a diverged form of a described system"),
        F.when(F.col("array_operon_gap_bp") > FAR_ARRAY, "an array of another transcript"),
    )


def open_questions() -> Column:
    """What the measurements leave open."""
    return _listed(
        F.when(F.col("partner_known_neglog_e") < 3.0, "what the partner does"),
        F.when(F.col("association_neglog_p") < 3.0, "whether the partner is there by chance"),
        F.when(F.col("n_independent_loci") < 8, "whether further genomes repeat the locus"),
    )


def reports(applied: DataFrame) -> DataFrame:
    """Candidates to which a rubric was applied, with function, predictions, n_predictions, alternatives, open_questions and confidence (from 0 to 1)."""
    kind = F.when(~F.col("triad_intact"), "enzyme without its catalytic residues").when((F.col("array_quality") >= 0.4) & (F.col("array_operon_gap_bp") <= FAR_ARRAY), "enzyme with an array of repeats")
    function = F.coalesce(kind, F.when(F.col("partner_conservation") >= 0.5, "enzyme with a steady partner"), F.lit("enzyme alone"))
    confidence = F.when(~F.col("triad_intact"), DEAD_CONFIDENCE).when(F.size("failed_gates") > 0, F.col("priority") * FAILED_SHARE).otherwise(F.col("priority"))
    out = applied.withColumn("function", function).withColumn("predictions", predictions()).withColumn("alternatives", alternatives()).withColumn("open_questions", open_questions())
    return out.withColumn("n_predictions", F.size("predictions")).withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence)))


def record(sessions: DataFrame, path: str) -> None:
    """Appends transcripts (session_id, fingerprint, role, output) to the table at path."""
    sessions.select("session_id", "fingerprint", "role", "output").write.mode("append").partitionBy("role").parquet(path)


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """All transcripts."""
    return spark.read.schema("session_id string, fingerprint string, output string, role string").parquet(path)
