from collections import Counter

from helpers import awkward, empty
from pyspark.sql import functions as F

from locusframe.llm import sharding


def check(rows, shards):
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_sizes_are_near_equal_and_places_gapless(spark, sf_dir):
    rows = sharding.shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4).collect()
    size = Counter()
    for r in rows:
        size[r.shard] += r["size"]
    assert len(rows) == 200 and max(size.values()) < 1.05 * min(size.values())
    check(rows, 4)


def test_awkward_rows(spark):
    rows = sharding.shard(awkward(spark), 3).collect()
    assert len(rows) == 9
    assert {r.doc_id: r["size"] for r in rows}[2] == 8
    check(rows, 3)
    assert sharding.shard(empty(spark), 3).count() == 0


def test_equal_rows_are_split(spark):
    docs = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    rows = sharding.shard(docs.union(spark.range(600).select("id", F.lit("other text"))), 6).collect()
    assert max(Counter(r.shard for r in rows).values()) <= 1.1 * 3600 / 6
    check(rows, 6)


def test_growing_moves_slots_into_the_new_shard_only():
    units = [(s, 0, 100 + s % 17, 3) for s in range(512)]
    old = sharding.numbered(sharding.place(units, 8), 1)
    new = sharding.grow(old, 8)
    moved = [(a, b) for a, b in zip(old, new, strict=True) if a[5] != b[5]]
    assert moved and all(b[5] == 8 for _, b in moved) and {b[0] for b in new} == {2}
    load = Counter()
    for b in new:
        load[b[5]] += b[3]
    assert max(load.values()) < 1.1 * min(load.values())


def test_versions_are_stored(spark, tmp_path):
    old = sharding.numbered(sharding.place([(s, 0, 10, 1) for s in range(64)], 4), 1)
    sharding.store_map(spark, old, str(tmp_path / "map"))
    assert sharding.store_map(spark, sharding.grow(old, 4), str(tmp_path / "map")).count() == 64
    assert spark.read.parquet(str(tmp_path / "map")).count() == 128
