import numpy as np
from helpers import awkward, empty
from pyspark.sql import functions as F

from locusframe.llm import ordinal


def synthetic(n=600, seed=3):
    """Ratings by what a text holds: junk marks, a bad word, neither."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = [f"w{x}" for x in rng.integers(0, 400, int(rng.integers(20, 200)))]
        grade = i % 3
        if grade == 0:
            words = [w.upper() + "!!" for w in words]
        if grade == 1:
            words[len(words) // 2] = "awful,"
        rows.append((i, " ".join(words), grade))
    return rows


def test_held_out_accuracy(spark):
    rows = synthetic()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, min(g, 1), int(g == 1)) for i, _, g in rows if i < 400], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in ordinal.classify(docs, labels).collect()}
    held = [(out[i], g) for i, _, g in rows if i >= 400]
    assert sum(r.kept == (g == 2) for r, g in held) >= 0.95 * len(held)
    mean = [np.mean([r.expected_grade for r, g in held if g == k]) for k in range(3)]
    assert mean[0] < mean[1] < mean[2]


def test_given_table_keeps_clean_documents(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = ordinal.train(docs, labels.where("doc_id % 2 = 0"))
    out = ordinal.estimated(docs.select("doc_id", "text"), model).join(ordinal.graded(labels.where("doc_id % 2 = 1")), "doc_id")
    kept = {r.grade: r.kept for r in out.groupBy("grade").agg(F.avg(F.col("quality_kept").cast("double")).alias("kept")).collect()}
    assert kept[2] > 0.98 and kept[0] < 0.1 and kept[1] < 0.45


def test_ordered_thresholds_and_probabilities():
    rows = synthetic(150)
    x = ordinal.features([r[1].encode() for r in rows])
    model = ordinal.fit(*x, np.array([r[2] for r in rows]))
    assert (np.diff(model.thresholds) > 0).all()
    p = model.probabilities(model.scores([r[1].encode() for r in rows]))
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    assert ordinal.fit(*x, np.zeros(150, dtype=int)) is None


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 1), (6, None, 0), (3, 7, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    assert ordinal.classify(awkward(spark), labels).count() == 9
    none = ordinal.classify(awkward(spark), labels.limit(0)).collect()
    assert all(r.kept and r.expected_grade is None for r in none)
    assert ordinal.classify(empty(spark), labels).count() == 0
    assert ordinal.keep_good(awkward(spark), labels).columns == awkward(spark).columns
