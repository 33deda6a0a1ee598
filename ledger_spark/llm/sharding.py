"""Sharding through a fixed number of virtual slots and a versioned map from slots to shards.

A record's slot is a hash of its key and never changes. Bytes are summed per slot, and the map says which shard holds
a slot. Version 0 deals slots in turn; rebalancing edits the map, moving slots from overfull shards to the least full
one while that helps, and stores the edited map as the next version. All of it is DataFrame work: the map has as many
rows as there are slots, a constant, and an edit is one fold over them.

A record's key is its doc_id, text and size. Records that repeat all three more than HOT times, and more often than an
even share of a quarter of a slot, would overfill one slot: their copies are dealt over the slots by the number of the
stored row (at most 4 * slots keys can be as frequent as that, a table to broadcast). A slot's records are numbered in
parts, dealt by row. Null doc_ids hash like any other value. Null texts have no bytes, so size 1. Repeated rows each get
a place. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, parallelism

SLOTS = 4096
HOT = 8
KEY = ("doc_id", "text_crc32", "size")


def slotted(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """rows(*KEY, row, ...), a stored table, with virtual_slot."""
    often = max(HOT, rows.count() // (4 * slots))
    hot = rows.groupBy(*KEY).agg(F.count("*").alias("copies")).filter(F.col("copies") > often).select(*(F.col(c).alias(f"hot_{c}") for c in KEY))
    same = F.lit(True)
    for c in KEY:
        same &= F.col(c).eqNullSafe(F.col(f"hot_{c}"))
    met = rows.join(F.broadcast(hot), same, "left")
    copy = F.when(F.col("hot_size").isNotNull(), F.pmod("row", F.lit(slots))).otherwise(0)
    return met.withColumn("virtual_slot", F.pmod(F.xxhash64(*KEY, copy), F.lit(slots)).cast("int")).drop(*(f"hot_{c}" for c in KEY))


def initial_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """version, virtual_slot, shard: version 0, slots dealt in turn."""
    return spark.range(slots).select(F.lit(0).alias("version"), F.col("id").cast("int").alias("virtual_slot"), F.pmod("id", F.lit(shards)).cast("int").alias("shard"))


def slot_bytes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"))


def edited(slot_map: DataFrame, bytes_: DataFrame, shards: int, into: int = 0) -> DataFrame:
    """The next version of the map. Slots are taken from the largest; one in a shard above the mean moves to the least
    full shard if that one then still holds less than the slot's shard held. Only shards from `into` on take slots in,
    so that a map grows into new shards alone."""
    sized = slot_map.join(F.broadcast(bytes_), "virtual_slot", "left").select("version", "virtual_slot", "shard", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))
    one = sized.agg(
        F.max("version").alias("version"),
        F.sort_array(F.collect_list(F.struct("bytes", "virtual_slot", "shard")), asc=False).alias("slots"),
        F.array(*(F.sum(F.when(F.col("shard") == k, F.col("bytes")).otherwise(0)) for k in range(shards))).alias("loads"),
        (F.sum("bytes") / shards).alias("mean"),
    )

    def step(state: Column, slot: Column) -> Column:
        loads, takers = state["loads"], F.slice(state["loads"], into + 1, shards - into)
        low = F.array_min(takers)
        to = (F.array_position(takers, low) - 1 + into).cast("int")
        held = F.element_at(loads, slot["shard"] + 1)
        moves = (held > F.col("mean")) & (low + slot["bytes"] < held)
        after = F.transform(loads, lambda v, i: v + F.when(i == to, slot["bytes"]).when(i == slot["shard"], -slot["bytes"]).otherwise(F.lit(0)))
        return F.struct(
            F.when(moves, after).otherwise(loads).alias("loads"),
            F.concat(state["map"], F.array(F.struct(slot["virtual_slot"].alias("virtual_slot"), F.when(moves, to).otherwise(slot["shard"]).alias("shard")))).alias("map"),
        )

    start = F.struct(F.col("loads").alias("loads"), F.lit(None).cast("array<struct<virtual_slot:int,shard:int>>").alias("map"))
    start = start.withField("map", F.array().cast("array<struct<virtual_slot:int,shard:int>>"))
    folded = one.select((F.col("version") + 1).alias("version"), F.explode(F.aggregate("slots", start, step)["map"]).alias("m"))
    return folded.select("version", "m.virtual_slot", "m.shard")


def rebalanced(rows: DataFrame, slot_map: DataFrame, shards: int, edits: int = 3, into: int = 0) -> DataFrame:
    """All versions of the map, the given one and one for each edit, as a stored table."""
    sizes = materialize(slot_bytes(rows))
    versions = slot_map
    for _ in range(edits):
        slot_map = materialize(edited(slot_map, sizes, shards, into))
        versions = versions.unionByName(slot_map)
    return materialize(versions)


def latest(versions: DataFrame) -> DataFrame:
    newest = versions.agg(F.max("version").alias("version"))
    return versions.join(F.broadcast(newest), "version", "left_semi").select("virtual_slot", "shard", "version")


def shard_documents(docs: DataFrame, shards: int = 16, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (place in the shard, from 0), grown_shard, virtual_slot, map_version.

    The law is `bytes`: the map is edited until the shards hold nearly the same bytes. Places: records are numbered
    inside a slot's salted part, parts are laid end to end inside a shard."""
    parts = -(-4 * parallelism(docs.sparkSession) // slots)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    ))
    rows = materialize(slotted(rows, slots).withColumn("part", F.pmod("row", F.lit(parts)).cast("int")))
    placed = latest(rebalanced(rows, initial_map(docs.sparkSession, shards, slots), shards))
    counts = rows.groupBy("virtual_slot", "part").agg(F.count("*").alias("n")).join(F.broadcast(placed), "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("virtual_slot", "part", "shard", "version", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("place", F.row_number().over(own) - 1).join(F.broadcast(bases), ["virtual_slot", "part"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") + F.col("base")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"),
    )
