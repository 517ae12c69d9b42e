from pyspark.sql import functions as F

from locusframe.llm import perplexity as px


def verdicts(spark, rows):
    """kept by id of documents (id, lang, log perplexity) that the base rules keep."""
    features = spark.createDataFrame([(i, lang, 100, 0, -1000.0 * x, 1000) for i, lang, x in rows], "doc_id long, lang string, n_words long, n_repeat_words long, log_p double, n_units long")
    return {r.doc_id: r.kept for r in px.with_verdict(features).collect()}


def test_band_follows_the_spread(spark):
    rows = [(i, "en", 1.5 + 0.0004 * (i - 100)) for i in range(201)]
    kept = verdicts(spark, [*rows, (900, "en", 1.2), (901, "en", 1.78)])
    assert not kept[900] and not kept[901] and all(kept[i] for i in range(201))


def test_copies_and_few_texts_do_not_narrow_the_band(spark):
    rows = [(i, "en", 1.5 + 0.001 * (i - 100)) for i in range(201)] + [(1000 + i, "en", 1.47) for i in range(800)] + [(1, "xx", 1.2349), (2, None, 1.4321)]
    assert all(verdicts(spark, rows).values())


def test_given_table_rejects_more_bad_than_good(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = px.rules(spark.read.parquet(f"{d}/documents.parquet")).where("not base_failed").join(labels, "doc_id")
    rejected = {r.quality: r.share for r in rows.groupBy("quality").agg(F.avg((~F.col("kept")).cast("double")).alias("share")).collect()}
    print("rejected by quality", rejected)
    assert rejected[0] > 0.1 and rejected[1] < 0.01
