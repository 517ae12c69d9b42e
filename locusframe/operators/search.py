"""Sequence and profile searches: k-mer seeds, gapless segments, gapped scores, alignments.

Each step takes what the one before kept. Pairs come from the join of k-mer indexes only, with their fullest diagonals. They are dealt to blocks of
BLOCK pairs of one query, and a block gets its query's matrix (a profile, or the substitution scores of a sequence) once, before its pairs: no pair carries one.
Segments are sought in the stretches of targets along the diagonals; whole targets are joined only to pairs whose segment is high enough, scores and
alignments made for them in one pass. Rows that fell out stay with nulls, so that ``funnel`` and ``counted`` count every step of one search; ``hits`` are those that went through.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from locusframe.functions.sequence import reduce_alphabet

from . import alignment, profiles, similarity
from .checkpoints import checkpointed

K, LEAST_SEEDS, SEGMENT, MAX_EVALUE, PREFILTER_TOP, LIMIT = 4, 2, 30.0, 1e-3, 2000, 200
#: Pairs of a query that a task takes with one copy of its matrix; targets that are scored at once.
BLOCK, AT_ONCE = 512, 64


def seeded(queries: DataFrame, targets: DataFrame, k: int = K, letters=reduce_alphabet, keep: int | None = PREFILTER_TOP) -> DataFrame:
    """query, target, seeds on the fullest diagonal and the fullest diagonals. queries: query and q_seq; targets: target and t_seq. Of each query the ``keep`` targets with the most seeds, all for None."""
    q = similarity.index(queries, "query", letters(F.col("q_seq")), k)
    t = similarity.index(targets, "target", letters(F.col("t_seq")), k)
    top = similarity.top_diagonals(similarity.diagonals(q, t, "query", "target"), "query", "target")
    pairs = top.groupBy("query", "target").agg(F.max("n").alias("seeds"), F.collect_list("diagonal").alias("diagonals"))  # TOP_DIAGONALS at most
    return pairs if keep is None else similarity.best_hits(pairs, "query", "target", "seeds", keep).drop("place")


class _Model:
    """A query as its tasks hold it, from its row."""

    def __init__(self, row: dict):
        self.letters, self.core = row["letters"] or "", row["core"] or []
        self.profile = None if row["matrix"] is None else np.array(row["matrix"], dtype=np.float32).reshape(-1, alignment.UNKNOWN + 1)
        self.matrix = alignment.BLOSUM62[alignment.encode(self.letters)] if self.profile is None else self.profile
        self.gate, self.mean, self.sd, self.residues = row["gate"], row["decoy_mean"], row["decoy_sd"], row["residues"]

    def ends(self, targets: list[str]) -> list[tuple[float, int, int]]:
        """The score of each target and where it stands."""
        found = alignment.pair_ends([self.letters] * len(targets), targets) if self.profile is None else alignment.profile_ends(self.profile, targets)
        return [(float(score), int(i), int(j)) for score, i, j in found.tolist()]

    def align(self, target: str, end: tuple[float, int, int]) -> dict:
        return alignment.align(self.letters, target, True, self.profile, end)

    def expected(self, raw: float) -> float:
        bits = (similarity.LAMBDA * raw - math.log(similarity.KARLIN)) / math.log(2.0)
        return max(len(self.matrix), 1) * self.residues * 2.0 ** -min(bits, 1000.0)

    def coverage(self, x: dict) -> float:
        return sum(x["q_start"] <= c < x["q_end"] for c in self.core) / len(self.core) if self.core else 1.0


def _with_models(models: DataFrame, pairs: DataFrame, run: Callable[[_Model, list[dict]], Iterator[dict]], added: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """pairs (query, target, seeds, ..., block) with columns more, made by run from a query's model and some of its pairs. Every block gets its query's row (models) first."""
    ddl = {f.name: f.dataType.simpleString() for f in pairs.schema if f.name in ("query", "target", "seeds", "segment", "gapped")}
    kept = list(ddl)
    blocks = pairs.groupBy("query").agg((F.max("block") + 1).alias("n"))
    heads = models.join(blocks, "query").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    dealt = pairs.withColumn("is_pair", F.lit(True)).unionByName(heads.withColumn("is_pair", F.lit(False)), allowMissingColumns=True)
    # a fixed number of tasks: few bytes may be much work, so that small partitions are not to be put together
    dealt = dealt.repartition(similarity.tasks(pairs.sparkSession), "query", "block").sortWithinPartitions("query", "block", "is_pair")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for whole in batches:
            schema = pa.schema([(c, whole.schema.field(c).type) for c in kept] + [(n, t) for n, t, _ in added])
            for i in range(0, whole.num_rows, AT_ONCE):
                out, some = [], []
                for row in whole.slice(i, AT_ONCE).to_pylist():
                    if row["is_pair"]:
                        some.append(row)
                        continue
                    if some:
                        out += run(model, some)
                    model, some = _Model(row), []
                if some:
                    out += run(model, some)
                yield pa.RecordBatch.from_pylist(out, schema)

    return dealt.mapInArrow(each, ", ".join([f"`{c}` {t}" for c, t in ddl.items()] + [f"`{n}` {t}" for n, _, t in added]))


def _segments(model: _Model, rows: list[dict]) -> list[dict]:
    for r in rows:
        r["segment"] = max((alignment.best_segment(model.matrix[w["at"] :], alignment.encode(w["letters"] or ""), [0]) for w in r["windows"] or []), default=0.0)
        r["gapped"] = bool(r["segment"] >= model.gate)
    return rows


def _scores(passes: Callable[[_Model, float], bool], align: bool):
    def run(model: _Model, rows: list[dict]) -> list[dict]:
        gapped = sorted((r for r in rows if r["gapped"]), key=lambda r: len(r["t_seq"] or ""))
        for r, end in zip(gapped, model.ends([r["t_seq"] or "" for r in gapped]), strict=True):
            r["raw"], r["aligns"] = end[0], passes(model, end[0])
            if r["aligns"] and align:
                r["alignment"] = model.align(r["t_seq"] or "", end)
                r["core_coverage"] = model.coverage(r["alignment"])
        for r in rows:
            r["aligns"] = r.get("aligns") or False
            r |= {"width": len(model.matrix), "residues": model.residues, "decoy_mean": model.mean, "decoy_sd": model.sd}
        return rows

    return run


_SEGMENT = [("segment", pa.float64(), "double"), ("gapped", pa.bool_(), "boolean")]
_SCORED = [("raw", pa.float64(), "double"), ("aligns", pa.bool_(), "boolean"), ("alignment", alignment.ALIGNMENT, alignment.ALIGNMENT_TYPE.simpleString()), ("core_coverage", pa.float64(), "double")]
_ABOUT = [("width", pa.int32(), "int"), ("residues", pa.int64(), "long"), ("decoy_mean", pa.float64(), "double"), ("decoy_sd", pa.float64(), "double")]


def _searched(models: DataFrame, targets: DataFrame, pairs: DataFrame, passes: Callable[[_Model, float], bool], align: bool = True) -> DataFrame:
    """pairs with segment, gapped, raw, aligns, alignment, core_coverage, width and residues. models: query, matrix (null for a sequence), letters, core, gate, decoy_mean, decoy_sd."""
    models = models.crossJoin(F.broadcast(residues(targets)))  # one row
    pairs = checkpointed(pairs)  # thin: what follows reads it twice
    many = pairs.groupBy("query").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("many"))
    width = models.select("query", F.coalesce(F.size("matrix") / (alignment.UNKNOWN + 1), F.length("letters")).cast("int").alias("width"))
    dealt = pairs.join(many, "query").join(width, "query").withColumn("block", F.pmod(F.xxhash64("target"), F.col("many")).cast("int"))
    begin = lambda d: F.greatest(-d, F.lit(0))
    window = F.transform("diagonals", lambda d: F.struct(begin(d).alias("at"), F.substr("t_seq", (F.greatest(d, F.lit(0)) + 1).cast("int"), F.greatest(F.col("width") - begin(d), F.lit(0)).cast("int")).alias("letters")))
    cut = dealt.join(targets, "target").select("query", "target", "seeds", "block", window.alias("windows"))
    found = _with_models(models, cut, _segments, _SEGMENT).join(many, "query").withColumn("block", F.pmod(F.xxhash64("target"), F.col("many")).cast("int"))
    texts = found.join(targets, "target").withColumn("t_seq", F.when(F.col("gapped"), F.col("t_seq"))).drop("many")
    return _with_models(models, texts, _scores(passes, align), _SCORED + _ABOUT)


def _reported(out: DataFrame, good: Column, limit: int | None) -> DataFrame:
    out = out.withColumn("found", F.coalesce(F.col("aligns") & good, F.lit(False)))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("found").desc(), F.desc_nulls_last("alignment.score"), "target"))
    return out.withColumn("place", place).withColumn("reported", F.col("found") & (F.lit(True) if limit is None else F.col("place") <= limit))


def residues(targets: DataFrame) -> DataFrame:
    """One row: all letters of the database, the n of the search space."""
    return targets.agg(F.coalesce(F.sum(F.length("t_seq")), F.lit(0)).alias("residues"))


def sequence_search(queries: DataFrame, targets: DataFrame, k: int = K, letters=reduce_alphabet, max_evalue: float = MAX_EVALUE, least_seeds: int = LEAST_SEEDS, segment: float = SEGMENT, keep: int | None = PREFILTER_TOP, limit: int | None = LIMIT) -> DataFrame:
    """All seeded pairs with segment, raw, bits, evalue, alignment, reported and place. queries: query and q_seq; targets: target and t_seq, cleaned proteins.

    keep and limit (None: without) are how many targets of a query go on from the seeds, and how many are reported.
    """
    pairs = seeded(queries, targets, k, letters, keep).where(F.col("seeds") >= least_seeds)
    nothing = F.lit(None)
    models = queries.select("query", nothing.cast("array<double>").alias("matrix"), F.col("q_seq").alias("letters"), nothing.cast("array<int>").alias("core"), F.lit(float(segment)).alias("gate"), nothing.cast("double").alias("decoy_mean"), nothing.cast("double").alias("decoy_sd"))
    out = _searched(models, targets, pairs, lambda model, raw: model.expected(raw) <= max_evalue)
    bits = similarity.bits(F.col("alignment.score"))
    out = out.withColumn("bits", bits).withColumn("evalue", similarity.evalue(bits, F.greatest(F.col("width"), F.lit(1)), F.col("residues")))
    out = out.withColumn("raw", F.col("raw").cast("long"))
    return _reported(out, F.col("evalue") <= max_evalue, limit).drop("core_coverage", "width", "residues", "decoy_mean", "decoy_sd")


def profile_search(models: DataFrame, targets: DataFrame, k: int = K, letters=reduce_alphabet, max_evalue: float = MAX_EVALUE, least_z: float = 6.0, least_core: float = 0.7, least_seeds: int = LEAST_SEEDS, share: float = 0.5, keep: int | None = 20_000, limit: int | None = 5000, align: bool = True) -> DataFrame:
    """All seeded pairs of profiles (``query`` is their family) with segment, raw, z, evalue, alignment, coverage of the core, reported and place.

    A gapless segment is high enough at ``share`` of the score that least_z asks for. Without ``align``, what scores is reported and
    nothing aligned. keep and limit are those of sequence_search.
    """
    queries = models.select(F.col("family").alias("query"), F.col("consensus").alias("q_seq"))
    pairs = seeded(queries, targets, k, letters, keep).where(F.col("seeds") >= least_seeds)
    gate = share * (F.col("decoy_mean") + least_z * F.col("decoy_sd"))
    own = models.select(F.col("family").alias("query"), F.flatten("pssm").alias("matrix"), F.col("consensus").alias("letters"), F.col("core").cast("array<int>").alias("core"), gate.alias("gate"), "decoy_mean", "decoy_sd")
    good = lambda model, raw: (raw - model.mean) / model.sd >= least_z and (not align or model.expected(raw) <= max_evalue)
    out = _searched(own, targets, pairs, good, align)
    last = F.col("alignment.score") if align else F.col("raw")
    out = out.withColumn("z", profiles.z_score(last)).withColumn("evalue", similarity.evalue(similarity.bits(last), F.greatest(F.col("width"), F.lit(1)), F.col("residues")))
    reported = (F.col("z") >= least_z) & (F.col("evalue") <= max_evalue) & (F.col("core_coverage") >= least_core) if align else F.lit(True)
    return _reported(out, reported, limit).drop("width", "residues")


def hits(searched: DataFrame) -> DataFrame:
    """What a search reports."""
    return searched.where("reported").drop("gapped", "aligns", "found", "reported")


_STEPS = ("prefilter", "ungapped", "aligned", "reported")


def _steps() -> list[Column]:
    return [F.coalesce(F.count_if(c), F.lit(0)).alias(name) for name, c in zip(_STEPS, (F.lit(True), F.col("gapped"), F.col("aligns"), F.col("reported")), strict=True)]


def counted(searched: DataFrame) -> tuple[DataFrame, Observation]:
    """searched, and what counts the pairs that each step kept while it is first used: no job of its own."""
    observation = Observation()
    return searched.observe(observation, *_steps()), observation


def funnel(searched: DataFrame, queries: DataFrame, targets: DataFrame | int) -> DataFrame:
    """How many targets (a table, or their number) of each query each step kept: database, prefilter, ungapped, aligned, reported. Queries without seeds have zeros."""
    own = searched.groupBy("query").agg(*_steps())
    out = queries.select("query").join(own, "query", "left")
    out = out.withColumn("database", F.lit(targets).cast("long")) if isinstance(targets, int) else out.crossJoin(F.broadcast(targets.agg(F.count("*").alias("database"))))  # one row
    return out.select("query", "database", *[F.coalesce(c, F.lit(0)).alias(c) for c in _STEPS])


def family_model(members: DataFrame, decoys: int = profiles.DECOYS) -> DataFrame:
    """Calibrated profiles of families from unaligned members (family, member, sequence)."""
    aligned = profiles.projected(members)
    return profiles.calibrated(profiles.profiles(aligned), aligned, decoys)


def bootstrapped(seeds: DataFrame, targets: DataFrame, rounds: int = 2, least_z: float = 8.0, least_core: float = 0.5, first_evalue: float = 1e-6, first_limit: int = 30, least_members: int = 3, k: int = K, letters=reduce_alphabet, searches: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Models and members of families found from one described member each (family, member, sequence), all families at once.

    The first members are a sequence search's best; each round then builds the families' profiles and takes what these find. A family keeps its
    members where a round finds fewer than least_members. A family whose members did not change would find the same again, so a round searches and builds
    only those that changed in the one before, and all stop when none did. searches gets the number of families of each round's search.
    """
    described = seeds.select("family", "member", "sequence")
    found = hits(sequence_search(seeds.select(F.col("family").alias("query"), F.col("sequence").alias("q_seq")), targets, k, letters, first_evalue, limit=first_limit))
    sequences = targets.select(F.col("target").alias("member"), F.col("t_seq").alias("sequence"))
    of = lambda h, own: own.union(h.select(F.col("query").alias("family"), F.col("target").alias("member")).join(sequences, "member").select("family", "member", "sequence")).dropDuplicates(["family", "member"])
    members = checkpointed(of(found, described))
    model = checkpointed(family_model(members))
    active = members.select("family").distinct()
    for _ in range(rounds):
        if searches is not None:
            searches.append(active.count())
        new = of(hits(profile_search(model.join(active, "family", "left_semi"), targets, k, letters, least_z=least_z, least_core=least_core)), described.join(active, "family", "left_semi"))
        new = checkpointed(new)
        enough = new.groupBy("family").agg(F.count("*").alias("n")).where(F.col("n") >= least_members).select("family")
        key, before = ["family", "member"], members.join(enough, "family", "left_semi")
        new = new.join(enough, "family", "left_semi")
        differs = new.select(key).subtract(before.select(key)).union(before.select(key).subtract(new.select(key)))
        active = checkpointed(differs.select("family").distinct())
        if active.isEmpty():
            break
        changed = new.join(active, "family", "left_semi")
        members = checkpointed(members.join(active, "family", "left_anti").union(changed))
        model = checkpointed(model.join(active, "family", "left_anti").unionByName(family_model(changed)))
    return model, members


def called(scores: DataFrame, least_z: float = 8.0, least_coverage: float = 0.5) -> DataFrame:
    """A label for each gene from rows (gene, family, z, coverage): the family with the highest z (of equal ones the first) if it is high enough and covers enough, else ``unk``; and the runner-up."""
    w = Window.partitionBy("gene").orderBy(F.desc("z"), "family")
    ranked = scores.withColumn("place", F.row_number().over(w)).withColumn("runner_up", F.lead("family").over(w)).withColumn("runner_up_z", F.lead("z").over(w))
    label = F.when((F.col("z") >= least_z) & (F.col("coverage") >= least_coverage), F.col("family")).otherwise("unk")
    return ranked.where("place = 1").select("gene", label.alias("label"), F.col("family").alias("best"), "z", "coverage", "runner_up", "runner_up_z")
