"""Sharding by fixed virtual slots.

Every record falls into one of thousands of virtual slots by a hash. Bytes are summed per slot, and a
small versioned map sends slots to shards so that the shards' bytes are nearly equal. Adding a shard
edits the map: slots move into the new shard only, nothing moves between the old ones.

Defined cases: a null text has no bytes (size is the overhead alone); a very long text is one record of its size, and the
largest texts are placed first; an empty table gives no rows; equal
rows are separate records; a slot that equal rows make heavy is split into sub-slots, so that no slot
bounds the balance; other columns than doc_id and text are not read.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Fixed number of virtual slots; the map, and what is broadcast of it, is bounded by twice this.
SLOTS = 4096
#: Bytes of each record besides its text.
OVERHEAD = 8
#: A slot of more than this many times the mean is split into sub-slots.
HOT = 4
MAP_SCHEMA = "version int, virtual_slot int, sub_slot int, bytes long, rows long, shard int, first long"


def virtual_slot(*key: str, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of each document."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    thin = docs.select("doc_id", (F.length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return thin.withColumn("virtual_slot", virtual_slot("doc_id", "size", "text_crc32", slots=slots))


def fanout(slot_stats: list, slots: int) -> dict[int, int]:
    """Sub-slots of each hot slot. slot_stats: (virtual_slot, bytes, rows), a row a slot at most."""
    mean = sum(s["bytes"] for s in slot_stats) / slots or 1
    return {s["virtual_slot"]: min(s["rows"], math.ceil(s["bytes"] / mean)) for s in slot_stats if s["rows"] > 1 and s["bytes"] > HOT * mean}


def place(units: list[tuple[int, int, int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Units (slot, sub, bytes, rows) by descending bytes, each to the shard with the fewest so far."""
    heap = [(0, 0, s) for s in range(shards)]
    out = []
    for slot, sub, size, rows in sorted(units, key=lambda u: (-u[2], u[0], u[1])):
        b, r, shard = heapq.heappop(heap)
        heapq.heappush(heap, (b + size, r + rows, shard))
        out.append((slot, sub, size, rows, shard))
    return out


def numbered(placed: list[tuple[int, int, int, int, int]], version: int) -> list[tuple]:
    """Rows of MAP_SCHEMA; first: the place in its shard of a unit's first row."""
    at: dict[int, int] = {}
    out = []
    for slot, sub, size, rows, shard in sorted(placed):
        out.append((version, slot, sub, size, rows, shard, at.get(shard, 0)))
        at[shard] = at.get(shard, 0) + rows
    return out


def grow(slot_map: list[tuple], shards: int) -> list[tuple]:
    """The next version of a map for one shard more: slots go from the fullest shards into the new one only."""
    placed = [list(m[1:6]) for m in slot_map]
    total = sum(p[2] for p in placed)
    target, got = total / (shards + 1), 0
    load = [0] * shards
    for p in placed:
        load[p[4]] += p[2]
    for p in sorted(placed, key=lambda p: (-p[2], p[0], p[1])):
        if got + p[2] <= target and load[p[4]] - p[2] >= target * 0.98:
            load[p[4]] -= p[2]
            got += p[2]
            p[4] = shards
    version = max((m[0] for m in slot_map), default=0) + 1
    return numbered([tuple(p) for p in placed], version)


def with_units(recs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """records() with sub_slot. Only slots that are hot have more than sub-slot 0."""
    stats = recs.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()  # at most a row a slot
    hot = fanout(stats, slots)
    if not hot:
        return recs.withColumn("sub_slot", F.lit(0))
    n = F.element_at(F.create_map(*[F.lit(x) for kv in sorted(hot.items()) for x in kv]), F.col("virtual_slot"))
    return recs.withColumn("sub_slot", F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), n), F.lit(0)).cast("int"))


def build_map(units: DataFrame, shards: int) -> list[tuple]:
    stats = units.groupBy("virtual_slot", "sub_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()  # at most 2 * slots rows
    return numbered(place([(s["virtual_slot"], s["sub_slot"], s["bytes"], s["rows"]) for s in stats], shards), 1)


def store_map(spark: SparkSession, slot_map: list[tuple], path: str) -> DataFrame:
    """Appends a version of the map to the table at path; returns that version."""
    spark.createDataFrame(slot_map, MAP_SCHEMA).coalesce(1).write.mode("append").partitionBy("version").parquet(path)
    version = slot_map[0][0] if slot_map else 1
    fresh = spark.read.schema(MAP_SCHEMA).parquet(path) if slot_map else spark.createDataFrame([], MAP_SCHEMA)
    return fresh.where(F.col("version") == version)


def shard(docs: DataFrame, shards: int = 24, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, sub_slot, shard and slot, the row's place in its shard from 0, of the map's first version; next_shard, of its second, edited for one shard more."""
    spark = docs.sparkSession
    units = common.cut(with_units(common.cut(records(docs, slots), "records"), slots), "units")
    path = common.new_table(spark, "slot_map")
    slot_map = build_map(units, shards)
    stored = store_map(spark, slot_map, path).select("virtual_slot", "sub_slot", "shard", "first")
    grown = store_map(spark, grow(slot_map, shards), path).select("virtual_slot", "sub_slot", F.col("shard").alias("next_shard"))
    stored = stored.join(F.broadcast(grown), ["virtual_slot", "sub_slot"])
    within = Window.partitionBy("virtual_slot", "sub_slot").orderBy("doc_id", "text_crc32", "size")
    placed = units.withColumn("at", F.row_number().over(within) - 1)
    return placed.join(F.broadcast(stored), ["virtual_slot", "sub_slot"]).withColumn("slot", (F.col("first") + F.col("at")).cast("long")).drop("first", "at")


def op4_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "sub_slot", "next_shard")
