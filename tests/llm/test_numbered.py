"""Numbers of rows without a copy of them, and stars of candidates dealt to several tasks."""

from pyspark.sql import functions as F

from locusframe.llm import common, near_dup


def test_rows_of_a_parquet_table_keep_their_numbers(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).select("id", F.concat(F.lit("t"), "id").alias("text"), F.lit(1).alias("ROW"), F.lit(2).alias("file_")).repartition(5).write.option("parquet.block.size", 2048).parquet(path)
    table = spark.read.parquet(path)
    own = common.numbered(table, "n")
    assert own.columns == [*table.columns, "n"]
    rows = {r.n: r.id for r in own.select("n", "id").collect()}
    assert len(rows) == 1000
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert {r.n: int(r.text[1:]) for r in own.select("n", "text").collect()} == rows
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_other_tables_are_written_first(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    table = spark.read.parquet(path)
    json = str(tmp_path / "j")
    table.write.json(json)
    for df in (table.union(table), table.select(F.explode(F.array("id", "id")).alias("id")), spark.range(20), spark.read.json(json).union(spark.read.json(json)), table.withColumn("_metadata", F.lit(1)).union(table.withColumn("_metadata", F.lit(1)))):
        numbers = [r.n for r in common.numbered(df, "n").select("n").collect()]
        assert len(numbers) == len(set(numbers)) == 20
    assert common.numbered(spark.read.json(json), "n").select("n").distinct().count() == 10
    assert common.numbered(table.limit(0), "n").count() == 0


def test_large_stars_give_the_links_of_small_ones(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w if (i + j) % 61 else f"x{i}" for j, w in enumerate(words))) for i in range(150)]  # near copies of one text
    docs = spark.createDataFrame([*rows, (900, "quite another text " * 5), (901, None)], "doc_id long, text string")
    of = lambda: sorted((r.doc_id, r.component_id) for r in near_dup.near_duplicates(docs, 4, 80).collect())
    want = of()
    assert len({c for _, c in want}) == 3
    for n in (1, 7):
        monkeypatch.setattr(near_dup, "SPOKES", n)
        assert of() == want
