"""Similarity joins on k-mers: seeds, diagonals, best segments and best hits.

The index is a table (key, position, k-mer), k-mers as longs; a search is its equi-join with the k-mers of the queries, which are sent to
all tasks up to MOST_SENT of them, so that targets are not shuffled. Beyond, k-mers that hold more than one in OFTEN of all rows are dealt to SALTS
tasks. An index that several searches use is stored once, in buckets by k-mer, heavy ones dealt alike; a search then shuffles its own k-mers only.
Counts by diagonal are summed in each task before the shuffle, so a frequent k-mer costs rows of the join but no large group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import codes

TOP_DIAGONALS = 3
#: K-mers of queries that may be broadcast.
MOST_SENT = 500_000
#: A k-mer is heavy where it has more than one in OFTEN of the rows; there are fewer than OFTEN of them. Heavy ones are dealt to SALTS tasks.
OFTEN, SALTS = 1000, 64

index = codes.index


def tasks(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _salted(targets: DataFrame, heavy: DataFrame) -> DataFrame:
    """targets with salt, 0 but for heavy k-mers."""
    return targets.join(F.broadcast(heavy.select("kmer", F.lit(True).alias("heavy_"))), "kmer", "left").withColumn("salt", F.when(F.col("heavy_"), F.pmod(F.xxhash64(*[c for c in targets.columns if c != "kmer"]), F.lit(SALTS)).cast("int")).otherwise(0)).drop("heavy_")


def _copied(queries: DataFrame, heavy: DataFrame) -> DataFrame:
    """queries with salt, heavy k-mers with each."""
    every = F.when(F.col("heavy_"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return queries.join(F.broadcast(heavy.select("kmer", F.lit(True).alias("heavy_"))), "kmer", "left").withColumn("salt", F.explode(every)).drop("heavy_")


def heavy_kmers(targets: DataFrame) -> DataFrame:
    """kmer of the heavy ones: fewer than OFTEN rows."""
    counts = targets.groupBy("kmer").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).where(F.col("n") * OFTEN > F.col("total")).select("kmer")  # one row


class StoredIndex:
    """An index written as a bucketed table, for any number of searches."""

    def __init__(self, spark: SparkSession, name: str, k: int):
        self.spark, self.name, self.k = spark, name, k
        self.rows, self.heavy = spark.table(name), spark.table(f"{name}_heavy")

    @staticmethod
    def store(df: DataFrame, key: str, sequence: Column, k: int, name: str, buckets: int | None = None, alphabet: str = codes.AMINO) -> StoredIndex:
        """Writes the tables ``name`` and ``name``_heavy of the session's warehouse, which it replaces."""
        spark = df.sparkSession
        n = buckets or tasks(spark)
        rows = index(df, key, sequence, k, alphabet)
        rows.write.mode("overwrite").saveAsTable(f"{name}_rows")
        written = spark.table(f"{name}_rows")
        heavy_kmers(written).coalesce(1).write.mode("overwrite").saveAsTable(f"{name}_heavy")
        dealt = _salted(written, spark.table(f"{name}_heavy")).repartition(n, "kmer", "salt")
        dealt.write.mode("overwrite").bucketBy(n, "kmer", "salt").sortBy("kmer", "salt").saveAsTable(name)
        spark.sql(f"DROP TABLE {name}_rows")
        return StoredIndex(spark, name, k)

    def join(self, queries: DataFrame) -> DataFrame:
        """Rows of the index (with t_pos) and of queries (other columns, kmer) with one k-mer. The index is read in its buckets."""
        return self.rows.withColumnRenamed("pos", "t_pos").join(_copied(queries, self.heavy), ["kmer", "salt"]).drop("salt")

    def drop(self) -> None:
        for name in (self.name, f"{self.name}_heavy"):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def seeds(queries: DataFrame, targets: DataFrame | StoredIndex) -> DataFrame:
    """Pairs of rows with one k-mer, places as q_pos and t_pos."""
    q = queries.withColumnRenamed("pos", "q_pos")
    if isinstance(targets, StoredIndex):
        return targets.join(q)
    t = targets.withColumnRenamed("pos", "t_pos")
    if q.limit(MOST_SENT + 1).count() <= MOST_SENT:
        return t.join(F.broadcast(q), "kmer")
    heavy = heavy_kmers(t)
    return _salted(t, heavy).join(_copied(q, heavy), ["kmer", "salt"]).drop("salt")


def diagonals(queries: DataFrame, targets: DataFrame | StoredIndex, query: str, target: str) -> DataFrame:
    """query, target, diagonal (target position less query position) and n, the seeds on it."""
    return seeds(queries, targets).groupBy(query, target, (F.col("t_pos") - F.col("q_pos")).cast("long").alias("diagonal")).agg(F.count("*").alias("n"))


def top_diagonals(found: DataFrame, query: str, target: str, keep: int = TOP_DIAGONALS) -> DataFrame:
    """The fullest diagonals of each pair, ties to the smaller diagonal, with their place."""
    w = Window.partitionBy(query, target).orderBy(F.desc("n"), "diagonal")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep)


def best_hits(scored: DataFrame, by: str, other: str, score: str, keep: int) -> DataFrame:
    """The ``keep`` best others of each ``by``, ties to the smaller key, with their place."""
    w = Window.partitionBy(by).orderBy(F.desc(score), other)
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep)


def reciprocal_best(scored: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """Pairs of which each is the other's best."""
    forth = best_hits(scored, a, b, score, 1).select(a, b, score)
    back = best_hits(scored, b, a, score, 1).select(a, b)
    return forth.join(back, [a, b])


def best_segment(query: Column, target: Column, diagonal: Column, match: float = 1.0, mismatch: float = -1.0) -> Column:
    """The greatest score of a gapless segment along a diagonal (0 for none)."""
    begin = F.greatest(F.lit(0), -diagonal)
    n = F.least(F.length(query) - begin, F.length(target) - begin - diagonal).cast("int")
    letters = lambda s, at: F.slice(F.split(s, ""), (at + 1).cast("int"), F.greatest(n, F.lit(0)))
    scores = F.zip_with(letters(query, begin), letters(target, begin + diagonal), lambda x, y: F.when(x == y, match).otherwise(mismatch))
    start = F.struct(F.lit(0.0).alias("here"), F.lit(0.0).alias("best"))

    def step(acc, x):
        here = F.greatest(F.lit(0.0), acc["here"] + x)
        return F.struct(here.alias("here"), F.greatest(acc["best"], here).alias("best"))

    return F.aggregate(scores, start, step)["best"]


def shared_sets(queries: DataFrame, targets: DataFrame, query: str, target: str, value: str, least: float = 0.0) -> DataFrame:
    """query, target, shared and jaccard of sets given as distinct (key, value) rows, for pairs with a Jaccard similarity of ``least`` or more (over 0).

    A pair can only reach ``least`` if one of each set's rarest values is shared: of n values ordered by how many targets have them, the first
    n - ceil(least * n) + 1. Pairs come from the join of these alone, and only sets of sizes within ``least`` of each other; the
    sets of the pairs that are left are compared whole.
    """
    if least > 0:  # targets too small or too large for any query
        size = targets.groupBy(target).agg(F.count("*").alias("n_"))
        ends = queries.groupBy(query).agg(F.count("*").alias("n_")).agg(F.min("n_").alias("low_"), F.max("n_").alias("high_"))
        fit = size.crossJoin(F.broadcast(ends)).where((F.col("n_") >= least * F.col("low_") - 1e-9) & (F.col("high_") >= least * F.col("n_") - 1e-9))  # one row
        targets = targets.join(fit.select(target), target, "left_semi")
    common = targets.groupBy(value).agg(F.count("*").alias("often_"))
    ranked = lambda df, key, n, own: (
        df.join(common, value, "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often_", F.lit(0)).alias("often_"), F.col(value).alias("v")))).alias("x"))
        .select(key, F.size("x").alias(n), F.col("x.v").alias(own))
    )
    q, t = ranked(queries, query, "n_q", "own_q"), ranked(targets, target, "n_t", "own_t")
    first = lambda df, key, n, own: df.select(key, n, F.explode(F.slice(own, F.lit(1), (F.col(n) - F.ceil(F.lit(least) * F.col(n) - 1e-9) + 1).cast("int"))).alias("v"))
    if least > 0:
        near = first(q, query, "n_q", "own_q").join(first(t, target, "n_t", "own_t"), "v").where((F.col("n_q") >= least * F.col("n_t") - 1e-9) & (F.col("n_t") >= least * F.col("n_q") - 1e-9)).select(query, target).distinct()
    else:
        near = queries.join(targets, value).select(query, target).distinct()
    both = near.join(q, query).join(t, target).withColumn("shared", F.size(F.array_intersect("own_q", "own_t")).cast("long"))
    out = both.select(query, target, "shared", (F.col("shared") / (F.col("n_q") + F.col("n_t") - F.col("shared"))).alias("jaccard"))
    return out.where((F.col("jaccard") >= least) & (F.col("shared") > 0))


#: Query sets that a task holds at once, and target sets that it is given for them.
SETS, TARGETS = 256, 1024
_BOTH = "`query` {q}, `target` {t}, shared long, jaccard double"


def _alike(least: float):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block, q = [], None, None
        for batch in rows:
            words = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, 1), np.uint64)
            size, of = batch.column("size").to_numpy(), list(zip(batch.column("block").to_pylist(), batch.column("chunk").to_pylist(), strict=True))
            is_target = batch.column("is_target").to_numpy(zero_copy_only=False)
            out = []
            for i in range(batch.num_rows):
                if of[i] != block:
                    held, block, q = [], of[i], None
                if not is_target[i]:
                    held.append((batch.column("query")[i].as_py(), size[i], words[i].copy()))
                    continue
                if q is None:
                    q = [h[0] for h in held], np.array([h[1] for h in held]), np.array([h[2] for h in held])
                near = np.flatnonzero((q[1] >= least * size[i] - 1e-9) & (size[i] >= least * q[1] - 1e-9))
                both = np.bitwise_count(q[2][near] & words[i]).sum(axis=1, dtype=np.int64)
                share = both / np.maximum(q[1][near] + size[i] - both, 1)
                good = (both > 0) & (share >= least)
                out += [(q[0][n], i, b, x) for n, b, x in zip(near[good].tolist(), both[good].tolist(), share[good].tolist(), strict=True)]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field("query").type), batch.column("target").take(pa.array(cols[1], pa.int64())), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64())], names=["query", "target", "shared", "jaccard"])

    return run


def shared_bitmaps(queries: DataFrame, targets: DataFrame, query: str, target: str, least: float = 0.0) -> DataFrame:
    """query, target, shared and jaccard of sets given as bitmaps (key, size, bits), for pairs with a Jaccard similarity of ``least`` or more (over 0).

    Queries are a stated set: in order of size they are cut into blocks of SETS, and each target meets the blocks with sizes that ``least``
    allows. A task holds one block and counts the bits in common with one target after another, so nothing is made for a pair but its row.
    """
    spark = queries.sparkSession
    sized = queries.where("size > 0")
    n = sized.count()
    if not n:
        return spark.createDataFrame([], _BOTH.format(q=queries.schema[query].dataType.simpleString(), t=targets.schema[target].dataType.simpleString())).select(F.col("query").alias(query), F.col("target").alias(target), "shared", "jaccard")
    ends = sized.agg(F.percentile_approx("size", [i * SETS / n for i in range(1, -(-n // SETS))] or [0.5], 10_000).alias("ends")).first().ends if n > SETS else []
    block = F.lit(0) if not ends else F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e < F.col("size")))
    blocks = sized.withColumn("block", block)
    span = blocks.groupBy("block").agg(F.min("size").alias("low"), F.max("size").alias("high")).collect()  # a row for each SETS queries
    chunks = max(1, -(-targets.count() // TARGETS))
    fits = F.array(*[F.when((F.col("size") >= least * r.low - 1e-9) & (F.col("size") * least <= r.high + 1e-9), F.lit(r.block)) for r in span])
    t = targets.where("size > 0").withColumn("block", F.explode(F.filter(fits, lambda b: b.isNotNull()))).withColumn("chunk", F.pmod(F.xxhash64(target), F.lit(chunks)).cast("int"))
    q = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    rows = q.select("block", "chunk", F.lit(False).alias("is_target"), F.col(query).alias("query"), none(targets, target).alias("target"), "size", "bits").union(
        t.select("block", "chunk", F.lit(True), none(queries, query), target, "size", "bits")
    )
    dealt = rows.repartition(tasks(spark), "block", "chunk").sortWithinPartitions("block", "chunk", "is_target", "size")
    types = _BOTH.format(q=queries.schema[query].dataType.simpleString(), t=targets.schema[target].dataType.simpleString())
    return dealt.mapInArrow(_alike(least), types).select(F.col("query").alias(query), F.col("target").alias(target), "shared", "jaccard")


# The statistics of gapped BLOSUM62 scores.
LAMBDA, KARLIN = 0.267, 0.041


def bits(raw: Column, gapped_lambda: float = LAMBDA, k: float = KARLIN) -> Column:
    """Bit score of a raw alignment score."""
    return (gapped_lambda * raw - F.log(F.lit(k))) / F.log(F.lit(2.0))


def evalue(bit_score: Column, query_length: Column, database_length: Column) -> Column:
    """Expected chance hits of at least that bit score; null for none."""
    return query_length.cast("double") * database_length * F.pow(F.lit(2.0), -F.when(bit_score > 1000, 1000.0).otherwise(bit_score))
