"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features serves all grades; ordered thresholds cut its score into them:
P(grade <= k) = sigmoid(threshold_k - score). It gives an expected grade and the probability of the top grade,
by which documents are selected. The weights are fitted on a bounded sample of rated documents (SAMPLE a grade, those of
the smallest hashes; copies count once), for the features that depend on the grade; every document is scored on its whole text.

Ratings: 0 for low quality, 1 for acceptable text that is toxic, 2 for good text.

Defined cases: a null or empty text has no features and the score 0; a very long text is scored whole, in a pass of its own;
ratings that are null or out of range are ignored, of several for a document the lowest counts, of several texts of an id the
smallest; where fewer than two grades are rated, the estimates are null and all documents are
kept; repeated rows score alike; an empty table gives no rows; other columns are carried by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

GRADES = 3
#: Hashed features: presence of words, and how large a share of words has a shape.
DIMENSIONS = 1 << 18
#: Rated documents of each grade that the fit uses, at most; also what the driver gets.
SAMPLE = 3000
#: Least chi-square of a feature's presence against the grades for it to get a weight: chance reaches it for under 1 in 100 of all DIMENSIONS features together.
SCREEN = 35.0
#: Least probability of the top grade of a kept document.
LEAST_TAIL = 0.8
STEPS, RATE, PENALTY, SHAPE_SCALE = 600, 0.1, 3e-5, 4.0

#: Bytes of words: letters in lower case and digits; other ASCII parts them.
_LETTERS = bytes(b if b >= 128 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())
_CLASS = np.arange(256, dtype=np.int64)
for _range, _code in (((97, 123), 1), ((65, 91), 2), ((48, 58), 3), ((128, 256), 4)):
    _CLASS[slice(*_range)] = _code
_PAIR = common.mix64(np.arange(1, 256 * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: where each text's features begin, their numbers and values."""
    starts, numbers, values = [np.zeros(1, np.int64)], [], []
    last = 0
    for i, j in common.batches(texts):
        raw = common.Words(texts[i:j])
        low = common.Words([t.translate(_LETTERS) for t in texts[i:j]])
        n = np.maximum(np.diff(raw.offsets), 1)
        doc = raw.text_of_word()
        key = np.unique(low.text_of_word() * DIMENSIONS + (low.hashes % np.uint64(DIMENSIONS // 2)).astype(np.int64))
        kind = _CLASS[raw.bytes]
        before = np.concatenate([[0], kind[:-1]])
        before[raw.starts] = 0
        turn = np.where(kind != before, _PAIR[before * 256 + kind], np.uint64(0))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(turn, dtype=np.uint64)])
        shape = common.mix64(total[raw.ends] - total[raw.starts])
        shape_key, times = np.unique(doc * DIMENSIONS + DIMENSIONS // 2 + (shape % np.uint64(DIMENSIONS // 2)).astype(np.int64), return_counts=True)
        keys = np.concatenate([key, shape_key])
        vals = np.concatenate([np.ones(len(key)), SHAPE_SCALE * times / n[shape_key // DIMENSIONS]])
        order = np.argsort(keys, kind="stable")
        keys, vals = keys[order], vals[order]
        per = np.bincount(keys // DIMENSIONS, minlength=j - i)
        starts.append(last + np.cumsum(per))
        last += len(keys)
        numbers.append((keys % DIMENSIONS).astype(np.int32))
        values.append(vals.astype(np.float32))
    return np.concatenate(starts), np.concatenate(numbers) if numbers else np.empty(0, np.int32), np.concatenate(values) if values else np.empty(0, np.float32)


def _row_sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
    return total[starts[1:]] - total[starts[:-1]]


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """P(grade) of each score, a row each."""
        upto = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - scores[:, None], -40, 40)))
        edges = np.hstack([np.zeros((len(scores), 1)), upto, np.ones((len(scores), 1))])
        return np.diff(edges, axis=1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        starts, numbers, values = features(texts)
        return _row_sums(self.weights[numbers] * values, starts)


def associated(starts: np.ndarray, numbers: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """Which features' presence depends on the grade."""
    grade = np.repeat(grades, np.diff(starts)).astype(np.int64)
    there = np.bincount(numbers.astype(np.int64) * GRADES + grade, minlength=DIMENSIONS * GRADES).reshape(DIMENSIONS, GRADES)
    docs = np.bincount(grades, minlength=GRADES)
    share = there.sum(axis=1, keepdims=True) / docs.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = np.nansum((there - docs * share) ** 2 / (docs * share * (1 - share)), axis=1)
    return chi2 >= SCREEN


def fit(starts: np.ndarray, numbers: np.ndarray, values: np.ndarray, grades: np.ndarray, rated: np.ndarray | None = None) -> Model | None:
    """Maximum penalised likelihood by Adam over the whole sample; a grade weighs as its number among all rated documents. None with fewer than two grades."""
    present = np.bincount(grades, minlength=GRADES)
    if (present > 0).sum() < 2:
        return None
    used = associated(starts, numbers, grades)
    keep = used[numbers]
    row = np.repeat(np.arange(len(grades)), np.diff(starts))[keep]
    local = np.cumsum(used) - 1
    col, val = local[numbers[keep]], values[keep].astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(grades)))])
    rated = present if rated is None else rated * (present > 0)
    share = (rated / np.maximum(present, 1))[grades] / rated.sum()
    # parameters: weights, the first threshold, log gaps between thresholds
    w = np.zeros(int(used.sum()))
    words = np.flatnonzero(used) < DIMENSIONS // 2  # a word counts against a text only: else long texts would gather score by their length
    t = np.concatenate([[-0.7], np.log(np.full(GRADES - 2, 1.4))])
    m, s = np.zeros(len(w) + len(t)), np.zeros(len(w) + len(t))
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, STEPS + 1):
        theta = np.concatenate([[-np.inf], t[0] + np.concatenate([[0], np.cumsum(np.exp(t[1:]))]), [np.inf]])
        score = _row_sums(w[col] * val, starts)
        up, down = sig(theta[grades + 1] - score), sig(theta[grades] - score)
        up[grades == GRADES - 1], down[grades == 0] = 1.0, 0.0
        p = np.maximum(up - down, 1e-12)
        d_up, d_down = up * (1 - up) / p * share, down * (1 - down) / p * share
        g_w = np.bincount(col, weights=(d_up - d_down)[row] * val, minlength=len(w)) + PENALTY * w
        g_theta = np.bincount(grades, weights=-d_up, minlength=GRADES)[:-1] + np.bincount(grades, weights=d_down, minlength=GRADES)[1:]
        tail = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([g_w, [tail[0]], tail[1:] * np.exp(t[1:])])
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        w, t = w - move[: len(w)], t - move[len(w) :]
        w[words] = np.minimum(w[words], 0)
    weights = np.zeros(DIMENSIONS)
    weights[used] = w
    return Model(weights, t[0] + np.concatenate([[0], np.cumsum(np.exp(t[1:]))]))


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade of the rated documents."""
    grade = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def sample(ratings: DataFrame, size: int = SAMPLE) -> DataFrame:
    """At most ``size`` rated documents of each grade."""
    out = None
    for g in range(GRADES):
        own = ratings.where(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
        out = own if out is None else out.unionByName(own)
    return out


def _sparse(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        starts, numbers, values = features(common.as_bytes(batch.column("text")))
        cut = list(zip(starts[:-1], starts[1:], strict=True))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array([numbers[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([values[a:b].tobytes() for a, b in cut], pa.binary())], names=["doc_id", "grade", "numbers", "values"])


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model | None:
    """The model of the sample's documents. Its features, GRADES * size rows at most (one a doc_id), come to the driver."""
    ratings = graded(labels)
    rated = np.zeros(GRADES)
    for r in ratings.groupBy("grade").count().collect():  # a row a grade
        rated[r[0]] = r[1]
    chosen = common.cut(sample(ratings, size), "rated")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    known = found.groupBy("doc_id", "grade").agg(F.min("text").alias("text"))  # of a repeated id, the smallest text
    first = known.groupBy(F.xxhash64("text").alias("t")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")  # copies count once
    rows = known.join(F.broadcast(first), "doc_id", "left_semi").select("doc_id", "grade", "text").mapInArrow(_sparse, "doc_id long, grade int, numbers binary, values binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: r.doc_id)
    numbers = [np.frombuffer(r.numbers, np.int32) for r in rows]
    starts = np.concatenate([[0], np.cumsum([len(n) for n in numbers])])
    return fit(starts, np.concatenate(numbers), np.concatenate([np.frombuffer(r["values"], np.float32) for r in rows]), np.array([r.grade for r in rows]), rated)


ESTIMATES = "expected_grade double, tail_probability double, quality_kept boolean"


def _estimate(model):
    @F.arrow_udf(f"struct<{ESTIMATES.replace(' ', ':').replace(',:', ',')}>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            if model is None:
                own = [pa.nulls(len(column), pa.float64())] * 2 + [pa.array(np.ones(len(column), dtype=bool))]
            else:
                scores = [model.value.scores(common.as_bytes(column.slice(i, 1024))) for i in range(0, len(column), 1024)]
                p = model.value.probabilities(np.concatenate(scores) if scores else np.empty(0))
                own = [pa.array(p @ np.arange(GRADES)), pa.array(p[:, -1]), pa.array(p[:, -1] >= LEAST_TAIL)]
            yield pa.StructArray.from_arrays(own, names=[x.split()[0] for x in ESTIMATES.split(", ")])

    return run


def estimates(model: Model | None, spark: SparkSession) -> Callable[[str], Column]:
    """A function of a column of texts that gives a struct of ESTIMATES. Only texts go to Python."""
    return _estimate(spark.sparkContext.broadcast(model) if model else None)


def estimated(rows: DataFrame, model: Model | None) -> DataFrame:
    """rows (with a column text) and ESTIMATES, which replace columns of their names."""
    name = common.fresh(rows.columns, "estimate")
    own = [x.split()[0] for x in ESTIMATES.split(", ")]
    return rows.withColumn(name, estimates(model, rows.sparkSession)("text")).withColumns({x: F.col(f"{name}.{x}") for x in own}).drop(name)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, expected_grade, tail_probability and kept of each document."""
    return estimated(docs.select("doc_id", "text"), train(docs, labels)).select("doc_id", "expected_grade", "tail_probability", F.col("quality_kept").alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with their columns."""
    return docs.where(estimates(train(docs, labels), docs.sparkSession)("text")["quality_kept"])


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
