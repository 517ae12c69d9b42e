from pyspark.sql import functions as F

from locusframe.llm import ordinal


def test_weak_evidence_of_toxicity_rejects(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = ordinal.train(docs, labels.where("doc_id % 2 = 0"))
    out = ordinal.estimated(docs.select("doc_id", "text"), model).join(ordinal.graded(labels.where("doc_id % 2 = 1")), "doc_id")
    kept = {r.grade: r.kept for r in out.groupBy("grade").agg(F.avg(F.col("quality_kept").cast("double")).alias("kept")).collect()}
    assert kept[2] > 0.98 and kept[1] < 0.25
