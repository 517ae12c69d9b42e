"""Centroid clustering in whole numbers by exponion search.

Vectors become integers, so that distances, sums and ties are exact. A vector keeps its centroid with an upper bound of
the distance to it and a lower bound of that to any other; both follow from how far centroids have moved. Where they do not settle the matter, only centroids in a
ball around the vector's own are scanned: with u the distance to its own centroid and s from there to the next one, all
that are farther from it than 2 u + s can be neither first nor second. Each centroid has its others sorted by distance, so a ball is
a prefix of a list; its radius is inclusive, so that a tie is found and goes to the smaller number.

Centroids are a parameter's number of rows, and all that is sent to tasks; sums of clusters are added up in tasks before they are shuffled. Each round
writes the vectors with their bounds anew as small integers, and drops the table before.

Defined cases: vectors of another length, null vectors and those with a null or non-finite component are left out; components are clamped to BOUND, beyond which no
distance would fit a long; fewer vectors than centroids make fewer centroids; equal vec_ids go by their vectors; equal rows may be several centroids, of which the first gets all;
an empty table gives no rows; columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SCALE, BOUND = 256, 1 << 27
DIMENSIONS, CENTROIDS, ROUNDS, SEED = 64, 40, 5, 2
#: Up to so large components products and sums of 64 of them are exact in double precision.
_EXACT = 1 << 22
#: Bounds are carried with so much slack, far above their rounding.
_SLACK = 1e-9
#: Rows that one numpy pass takes.
_CHUNK = 4096


def whole(vector: Column, dimensions: int = DIMENSIONS, scale: int = SCALE) -> Column:
    """The components of a vector as integers; null for a vector that is left out."""
    good = (F.size(vector) == dimensions) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(good, F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-float(BOUND))), F.lit(float(BOUND)))).cast("int")))


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x (int64) and c, exact."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= _EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


class Centroids:
    """Centroids with each one's others in order of distance, itself first."""

    def __init__(self, points: np.ndarray):
        self.points = points
        between = np.sqrt(_distances(points, points).astype(np.float64))
        self.order = np.argsort(between, axis=1, kind="stable")
        for i, row in enumerate(self.order):  # itself first, also before others at its place
            row[:] = np.concatenate([[i], row[row != i]])
        self.sorted = np.take_along_axis(between, self.order, axis=1)
        #: From each centroid to the next one.
        self.next = self.sorted[:, 1] if len(points) > 1 else np.full(len(points), np.inf)

    def ball(self, own: int, radius: np.ndarray) -> np.ndarray:
        """How many centroids of order[own] lie within radius, itself included, at least two where there are."""
        n = np.searchsorted(self.sorted[own], radius * (1 + _SLACK) + _SLACK, side="right")
        return np.clip(n, min(2, len(self.points)), len(self.points))


def searched(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row with new bounds, and how many distances it took. own: the centroid so far."""
    own, upper, lower, taken = own.copy(), upper.copy(), lower.copy(), 0
    open_ = np.flatnonzero(upper >= np.maximum(lower, centroids.next[own] / 2))  # else it is nearer than any other can be
    if len(open_):
        upper[open_] = np.sqrt(((x[open_] - centroids.points[own[open_]]) ** 2).sum(axis=1).astype(np.float64)) * (1 + _SLACK)
        taken += len(open_)
        open_ = open_[upper[open_] >= np.maximum(lower[open_], centroids.next[own[open_]] / 2)]
    before = own[open_]
    for c in np.unique(before):
        rows = open_[before == c]
        n = centroids.ball(c, 2 * upper[rows] + centroids.next[c])
        wide = 1 << np.ceil(np.log2(n)).astype(np.int64)  # balls of about one size are scanned at once
        for size in np.unique(wide):
            some, most = rows[wide == size], int(n[wide == size].max())
            among = np.sort(centroids.order[c, :most])  # ties go to the smaller number
            d = _distances(x[some], centroids.points[among])
            taken += d.size
            first = d.argmin(axis=1)
            own[some] = among[first]
            upper[some] = np.sqrt(d[np.arange(len(some)), first].astype(np.float64)) * (1 + _SLACK)
            d[np.arange(len(some)), first] = np.iinfo(np.int64).max
            lower[some] = np.sqrt(d.min(axis=1).astype(np.float64)) * (1 - _SLACK) if most > 1 else np.inf
    return own, upper, lower, taken


def _vectors(column) -> np.ndarray:
    own = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return own.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(own), -1)


STATE = "vec_id long, v array<int>, cluster int, upper double, lower double"


def _round(centroids: Centroids, moved: np.ndarray):
    """Assigns anew after the centroids have moved so far each; nothing is known of a row whose cluster is null."""
    far = moved.max(initial=0.0)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in rows:
            for i in range(0, whole_batch.num_rows, _CHUNK):
                batch = whole_batch.slice(i, _CHUNK)
                x = _vectors(batch.column("v"))
                if "cluster" in batch.schema.names:
                    own = batch.column("cluster").to_numpy().astype(np.int64)
                    upper = batch.column("upper").to_numpy() + moved[own] * (1 + _SLACK)
                    lower = np.maximum(batch.column("lower").to_numpy() - far * (1 + _SLACK), 0)
                else:
                    own, upper, lower = np.zeros(len(x), dtype=np.int64), np.full(len(x), np.inf), np.zeros(len(x))
                own, upper, lower, _ = searched(x, own, upper, lower, centroids)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(own.astype(np.int32)), pa.array(upper), pa.array(lower)], names=[c.split()[0] for c in STATE.split(", ")])

    return run


def _last(centroids: Centroids):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            x, own = _vectors(batch.column("v")), batch.column("cluster")
            d = ((x - centroids.points[own.to_numpy()]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), own, pa.array(d)], names=["vec_id", "cluster", "distance"])

    return run


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors (vec_id, v) with the smallest hashes of seed and vec_id, in their order."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.withColumn("h", hashed).orderBy("h", "vec_id", "v").limit(k).select("v").collect()  # k rows
    return np.array([r.v for r in rows], dtype=np.int64)


def means(state: DataFrame, points: np.ndarray) -> np.ndarray:
    """The floors of the clusters' means; a cluster without vectors keeps its point."""
    n = points.shape[1]
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.get("v", F.lit(i)).cast("decimal(10,0)")).cast("string").alias(f"s{i}") for i in range(n)]).collect()  # a row a centroid
    out = points.copy()
    for r in sums:
        out[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(n)]
    return out


def clustered(table: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each vector of table (vec_id, embedding)."""
    spark = table.sparkSession
    kept = table.select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("embedding"), dimensions, scale).alias("v")).where("v is not null")
    state, path = common.cut_at(kept, "vectors")
    points = first_centroids(state, k, seed)
    if not len(points):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    moved = np.zeros(len(points))
    for i in range(rounds + 1):
        new, new_path = common.cut_at(state.mapInArrow(_round(Centroids(points), moved), STATE), "vectors")
        common.drop_table(spark, path)
        state, path = new, new_path
        if i < rounds:
            after = means(state, points)
            moved = np.sqrt(((after - points) ** 2).sum(axis=1).astype(np.float64))
            points = after
    placed, _ = common.cut_at(state.mapInArrow(_last(Centroids(points)), "vec_id long, cluster int, distance long"), "assigned")
    common.drop_table(spark, path)
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    total = lambda c: F.least(F.sum(F.col(c).cast("decimal(38,0)")), most).cast("long")
    own = placed.groupBy("cluster").agg(total("distance").alias("cluster_inertia")).withColumn("one", F.lit(1))
    every = own.groupBy("one").agg(total("cluster_inertia").alias("inertia"))
    digests = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points.tolist()]
    of = F.element_at(F.array(*map(F.lit, digests)), F.col("cluster") + 1)
    per_cluster = own.join(F.broadcast(every), "one").select("cluster", "cluster_inertia", "inertia", of.alias("centroid_sha256"))
    return placed.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row a centroid


def op13_exponion_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    d = "list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint"
    floor = "((s - ((s % n) + n) % n) // n)::bigint"
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) AS e, row_number() OVER () AS r FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), vec_id, e) - 1 AS k, e FROM v ORDER BY k LIMIT {CENTROIDS})",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT v.r, min((({d}), c.k)) AS best FROM v, c{i} c GROUP BY v.r)")
        if i < ROUNDS:
            parts.append(f"u{i} AS (SELECT best[2] AS k, i, sum(v.e[i]) AS s, count(*) AS n FROM v JOIN a{i} USING (r), unnest(range(1, {DIMENSIONS + 1})) u(i) GROUP BY ALL)")
            parts.append(f"m{i} AS (SELECT k, list({floor} ORDER BY i) AS e FROM u{i} GROUP BY k)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN m{i} m USING (k))")
    return f"""WITH {", ".join(parts)} SELECT vec_id, best[2]::int AS cluster, best[1]::bigint AS distance, (sum(best[1]) OVER (PARTITION BY best[2]))::bigint AS cluster_inertia, (sum(best[1]) OVER ())::bigint AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM v JOIN a{ROUNDS} USING (r) JOIN c{ROUNDS} c ON c.k = best[2]"""


OP13_SQL = _sql()
