"""Profiles of families: position-specific scores from aligned members, their calibration, and families found from one member.

An alignment is rows (family, member, aligned); all counts are group-bys over its cells (family, member, col, residue), so that a
family may have any number of members. A profile is one row a family: pssm (an array of columns, each an array of scores by residue code,
unknown letters last), consensus, information and core (places of informative columns), decoy_mean and decoy_sd.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions.sequence import AMINO, BACKGROUND

from . import alignment

MAX_GAPS, PSEUDOCOUNT, CORE_BITS, DECOYS, UNKNOWN_SCORE = 0.5, 1.5, 1.5, 200, -1.0


def cells(aligned: DataFrame) -> DataFrame:
    """family, member, col (from 0) and residue of every cell; a gap is ``-``."""
    return aligned.select("family", "member", F.posexplode(F.split(F.upper("aligned"), "")).alias("col", "residue")).where("residue <> ''")


def kept_columns(found: DataFrame, max_gaps: float = MAX_GAPS) -> DataFrame:
    """The cells of columns with no larger share of gaps."""
    share = found.groupBy("family", "col").agg(F.avg((F.col("residue") == "-").cast("double")).alias("gaps"))
    return found.join(share.where(F.col("gaps") <= max_gaps).select("family", "col"), ["family", "col"])


def henikoff_weights(found: DataFrame) -> DataFrame:
    """family, member and weight: of each column a member gets 1 / (kinds of residues * members with its own), scaled to a mean of 1; 1 for all where nothing but gaps is left."""
    counts = found.where("residue <> '-'").groupBy("family", "col", "residue").agg(F.count("*").alias("n"))
    kinds = counts.groupBy("family", "col").agg(F.count("*").alias("kinds"))
    share = counts.join(kinds, ["family", "col"]).select("family", "col", "residue", (1 / (F.col("kinds") * F.col("n"))).alias("share"))
    own = found.join(share, ["family", "col", "residue"], "left").groupBy("family", "member").agg(F.coalesce(F.sum("share"), F.lit(0.0)).alias("weight"))
    total = own.groupBy("family").agg(F.sum("weight").alias("total"), F.count("*").alias("members"))
    scaled = F.when(F.col("total") > 0, F.col("weight") * F.col("members") / F.col("total")).otherwise(1.0)
    return own.join(total, "family").select("family", "member", scaled.alias("weight"))


def column_frequencies(found: DataFrame, weights: DataFrame, pseudocount: float = PSEUDOCOUNT) -> DataFrame:
    """family, col, residue, frequency and odds (log2 of frequency over background), a row for each of the twenty residues."""
    observed = found.join(weights, ["family", "member"]).groupBy("family", "col", "residue").agg(F.sum("weight").alias("w"))
    background = F.create_map(*[F.lit(x) for kv in BACKGROUND.items() for x in kv])
    residues = F.array(*map(F.lit, AMINO))
    own = observed.groupBy("family", "col").agg(F.map_from_entries(F.collect_list(F.struct("residue", "w"))).alias("w"))  # an entry a letter
    of = lambda a: F.coalesce(F.try_element_at("w", a), F.lit(0.0))
    total = F.aggregate(residues, F.lit(0.0), lambda t, a: t + of(a))
    each = own.withColumn("total", total).select("family", "col", "total", "w", F.explode(residues).alias("residue"))
    frequency = (of(F.col("residue")) + pseudocount * background[F.col("residue")]) / (F.col("total") + pseudocount)
    return each.select("family", "col", "residue", frequency.alias("frequency"), F.log2(frequency / background[F.col("residue")]).alias("odds"))


def column_information(frequencies: DataFrame, core_bits: float = CORE_BITS) -> DataFrame:
    """family, col, information in bits, the consensus residue (of equal ones the first), and whether the column is of the core."""
    commonest = F.max_by("residue", F.struct("frequency", -F.ascii("residue")))
    out = frequencies.groupBy("family", "col").agg(F.sum(F.col("frequency") * F.col("odds")).alias("information"), commonest.alias("consensus"))
    return out.withColumn("core", F.col("information") >= core_bits)


def profiles(aligned: DataFrame, max_gaps: float = MAX_GAPS, pseudocount: float = PSEUDOCOUNT, core_bits: float = CORE_BITS) -> DataFrame:
    """A row a family: pssm, consensus, information, core and members. Families without a column that is kept have no row."""
    found = kept_columns(cells(aligned), max_gaps)
    frequencies = column_frequencies(found, henikoff_weights(found), pseudocount)
    scores = frequencies.groupBy("family", "col").agg(F.array_sort(F.collect_list(F.struct("residue", "odds"))).alias("s"))
    scores = scores.select("family", "col", F.concat(F.col("s.odds"), F.array(F.lit(UNKNOWN_SCORE))).alias("scores"))
    each = scores.join(column_information(frequencies, core_bits), ["family", "col"])
    ordered = each.groupBy("family").agg(F.array_sort(F.collect_list(F.struct("col", "scores", "consensus", "information", "core"))).alias("c"))
    members = aligned.groupBy("family").agg(F.count("*").alias("members"))
    core = F.filter(F.transform("c", lambda x, i: F.when(x["core"], i)), lambda i: i.isNotNull())
    return ordered.join(members, "family").select("family", F.col("c.scores").alias("pssm"), F.array_join("c.consensus", "").alias("consensus"), F.col("c.information").alias("information"), core.alias("core"), "members")


def shuffled(sequence: Column, *seed: Column) -> Column:
    """The letters of a sequence in an order drawn by a hash of the seed: the same in every run and on every machine."""
    drawn = F.transform(F.split(sequence, ""), lambda c, i: F.struct(F.xxhash64(*seed, i).alias("h"), i.alias("i"), c.alias("c")))
    return F.array_join(F.transform(F.array_sort(drawn), lambda x: x["c"]), "")


def calibrated(found: DataFrame, aligned: DataFrame, decoys: int = DECOYS) -> DataFrame:
    """Profiles with decoy_mean and decoy_sd (1 where it were 0): their scores with shuffled members, each member in turn."""
    bare = F.regexp_replace(F.upper("aligned"), "-", "")
    pool = aligned.where(bare != "").select("family", "member", bare.alias("sequence"))
    place = F.row_number().over(Window.partitionBy("family").orderBy("member"))
    pool = pool.withColumn("place", place - 1).where(F.col("place") < decoys)  # decoy i is of member i modulo their number
    n = pool.groupBy("family").agg(F.count("*").alias("n"))
    drawn = pool.join(n, "family").withColumn("i", F.explode(F.sequence(F.col("place"), F.lit(decoys - 1), F.col("n").cast("int"))))
    scored = drawn.join(found.select("family", "pssm"), "family").select("family", alignment.pssm_score("pssm", shuffled(F.col("sequence"), F.col("family"), F.col("i"))).alias("score"))
    null = scored.groupBy("family").agg(F.avg("score").alias("decoy_mean"), F.stddev_pop("score").alias("sd"))
    out = found.join(null, "family", "left")
    return out.withColumn("decoy_mean", F.coalesce("decoy_mean", F.lit(0.0))).withColumn("decoy_sd", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)).drop("sd")


def z_score(score: Column) -> Column:
    """Standard deviations above the decoys."""
    return (score - F.col("decoy_mean")) / F.col("decoy_sd")


def core_coverage(begin: Column, end: Column) -> Column:
    """The share of the core's columns in [begin, end); 1 without a core."""
    return F.when(F.size("core") > 0, F.size(F.filter("core", lambda c: (c >= begin) & (c < end))) / F.size("core")).otherwise(1.0)


def projected(members: DataFrame) -> DataFrame:
    """An alignment (family, member, aligned) of unaligned members (family, member, sequence): each on the places of its family's longest, what is inserted dropped."""
    first = members.groupBy("family").agg(F.min_by(F.struct("member", "sequence"), F.struct(-F.length("sequence"), "member")).alias("anchor"))
    both = members.join(first, "family").withColumn("a", alignment.semiglobal_alignment("anchor.sequence", "sequence"))
    letters = F.filter(F.arrays_zip(F.split("a.q_aln", "").alias("q"), F.split("a.t_aln", "").alias("t")), lambda x: (x["q"] != "-") & (x["q"] != ""))
    inner = F.array_join(F.transform(letters, lambda x: x["t"]), "")
    row = F.concat(F.repeat(F.lit("-"), F.col("a.q_start")), inner, F.repeat(F.lit("-"), F.length("anchor.sequence") - F.col("a.q_end")))
    return both.select("family", "member", F.when(F.col("member") == F.col("anchor.member"), F.col("sequence")).otherwise(row).alias("aligned"))
