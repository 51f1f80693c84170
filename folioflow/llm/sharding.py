"""Operator 9, sharding by fixed virtual slots (DataFrame functions only).

A record's key is hashed into one of ``slots`` virtual slots; a versioned map gives each slot its shard. Maps are tables in
the shared folder, a folder per version that is never written again. Rebalancing edits the map, never the hash:
``grow`` moves the fewest slots into one new shard and nothing else, ``rebalanced`` moves slots from heavy to light shards
by the bytes that were summed per slot. A map has ``slots`` rows whatever the data; it's broadcast, and the driver edits it.

``grow`` depends on slot numbers and the shard count alone, so under law ``key`` doc_id and shard count decide. Law
``bytes`` uses a map rebalanced for the table. Places in a shard come from counts per slot and part (``slots`` x ``PARTS``
rows at most, broadcast) plus the place inside the part. Equal rows are counted before they are placed and come out
again in pieces, so rows that share a key or even all values (null keys, say) meet in no single task.
Null texts have no bytes; null keys hash like any value; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.sources.workspace import shared_dir

SLOTS = 8192
PARTS = 16
PIECE = 65_536


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(slots)).cast("int")


def first_map(spark: SparkSession, slots: int = SLOTS) -> DataFrame:
    """Version 1: one shard owns every slot."""
    return spark.range(slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("virtual_slot"), F.lit(0).alias("shard"))


def _moved(owner: list[int], shards: int) -> list[int]:
    """Owners after one more shard: each shard gives its last slots, by a hash of slot and shard count, down to its even share."""
    held: dict[int, list[int]] = {}
    for s, h in enumerate(owner):
        held.setdefault(h, []).append(s)
    after = list(owner)
    for h, mine in held.items():
        keep = len(owner) // (shards + 1) + (h < len(owner) % (shards + 1))
        mine.sort(key=lambda s: ((s * 2654435761 + shards * 40503) % 4294967296, s))
        for s in mine[keep:]:
            after[s] = shards
    return after


def _table(spark: SparkSession, version: int, owner: list[int]) -> DataFrame:
    return spark.createDataFrame([(version, s, h) for s, h in enumerate(owner)], "version int, virtual_slot int, shard int")


def _owner(mapped: DataFrame) -> tuple[int, list[int]]:
    rows = mapped.orderBy("virtual_slot").collect()  # a row per slot
    return rows[0]["version"], [r["shard"] for r in rows]


def grow(mapped: DataFrame) -> DataFrame:
    """The next version with one more shard, which takes slots only into itself."""
    version, owner = _owner(mapped)
    return _table(mapped.sparkSession, version + 1, _moved(owner, max(owner) + 1))


def even_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """The map that growing from one shard gives; its version is the number of shards."""
    owner = [0] * slots
    for n in range(1, shards):
        owner = _moved(owner, n)
    return _table(spark, shards, owner)


def save_map(mapped: DataFrame, path: str) -> DataFrame:
    """Writes a version into the map's folder, which must not hold it yet, and reads it back."""
    version = mapped.first()["version"]
    mapped.select("virtual_slot", "shard").coalesce(1).write.parquet(f"{path}/version={version}")
    return load_map(mapped.sparkSession, path, version)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the last one by default."""
    maps = spark.read.parquet(path).select("version", "virtual_slot", "shard")
    return maps.where(F.col("version") == (version if version is not None else maps.agg(F.max("version")).first()[0]))


def slot_bytes(docs: DataFrame, key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of each virtual slot, summed on the map side first."""
    return docs.groupBy(slot_of(F.col(key), slots).alias("virtual_slot")).agg(F.sum(size_of(F.col("text"))).alias("bytes"), F.count("*").alias("n_rows"))


def rebalanced(mapped: DataFrame, loads: DataFrame, slack: float = 0.02) -> DataFrame:
    """The next version: slots move from shards above the mean load to those below, heaviest surplus first.

    Works on the ``slots`` rows of the map, which the driver may hold. Stops when every shard is within ``slack`` of the
    mean or no single move helps.
    """
    version, owner = _owner(mapped)
    weight = [0] * len(owner)
    for r in loads.collect():
        weight[r["virtual_slot"]] = r["bytes"]
    load = dict.fromkeys(set(owner), 0)
    for h, w in zip(owner, weight, strict=True):
        load[h] += w
    mean = sum(load.values()) / len(load)
    for _ in owner:
        high, low = max(load, key=lambda h: (load[h], -h)), min(load, key=lambda h: (load[h], h))
        if load[high] <= mean * (1 + slack):
            break
        gap = load[high] - load[low]
        fit = [s for s, h in enumerate(owner) if h == high and 0 < weight[s] < gap]
        if not fit:
            break
        moved = min(fit, key=lambda s: (abs(gap / 2 - weight[s]), s))
        owner[moved] = low
        load[high] -= weight[moved]
        load[low] += weight[moved]
    return _table(mapped.sparkSession, version + 1, owner)


def size_of(text: Column) -> Column:
    """UTF-8 bytes (null: none) plus one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def placed(docs: DataFrame, mapped: DataFrame, grown: DataFrame | None = None, law: str = "key", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version, shard_bytes of every row under a stored map."""
    row = ["doc_id", "size", "text_crc32"]
    keyed = docs.select("doc_id", size_of(F.col("text")).alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("text_crc32"), slot_of(F.col("doc_id"), slots).alias("virtual_slot"))
    each = keyed.groupBy("virtual_slot", *row).agg(F.count("*").alias("n")).withColumn("part", F.pmod(F.xxhash64(*row), F.lit(PARTS)).cast("int"))
    part = keyed.withColumn("part", F.pmod(F.xxhash64(*row), F.lit(PARTS)).cast("int")).groupBy("virtual_slot", "part").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    ahead = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    after = grown.select("virtual_slot", F.col("shard").alias("grown_shard")) if grown is not None else mapped.select("virtual_slot", F.lit(None).cast("int").alias("grown_shard"))
    plan = (
        mapped.join(F.broadcast(after), "virtual_slot")
        .join(part, "virtual_slot")
        .select("virtual_slot", "part", "shard", "grown_shard", F.col("version").alias("map_version"), F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("before"), F.sum("bytes").over(Window.partitionBy("shard")).alias("shard_bytes"))
    )
    upto = Window.partitionBy("virtual_slot", "part").orderBy(*row).rowsBetween(Window.unboundedPreceding, 0)
    some = each.withColumn("first", F.sum("n").over(upto) - F.col("n"))
    pieces = some.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PIECE))).alias("piece"))
    large = pieces.where(F.col("n") > PIECE).repartition(*row, "piece")
    every = pieces.where(F.col("n") <= PIECE).unionByName(large).withColumn("i", F.explode(F.sequence(F.col("piece") * PIECE, F.least((F.col("piece") + 1) * PIECE, "n") - 1)))
    return every.join(F.broadcast(plan), ["virtual_slot", "part"]).select(
        *row, F.lit(law).alias("law"), "shard", (F.col("before") + F.col("first") + F.col("i")).cast("long").alias("slot"), "grown_shard", "virtual_slot", "map_version", "shard_bytes"
    )


def shard_documents(docs: DataFrame, shards: int = 16, slots: int = SLOTS) -> DataFrame:
    """Law ``key``: the map of ``shards`` shards and the next, grown one are stored, read back and applied."""
    spark, path = docs.sparkSession, f"{shared_dir(docs.sparkSession)}/slot-map-{uuid.uuid4().hex}"
    now = save_map(even_map(spark, shards, slots), path)
    return placed(docs, now, save_map(grow(now), path), "key", slots)


def shard_evenly(docs: DataFrame, shards: int = 16, slots: int = SLOTS) -> DataFrame:
    """Law ``bytes``: the stored map is rebalanced by the bytes of each slot, stored as the next version and applied."""
    spark, path = docs.sparkSession, f"{shared_dir(docs.sparkSession)}/slot-map-{uuid.uuid4().hex}"
    now = save_map(even_map(spark, shards, slots), path)
    return placed(docs, save_map(rebalanced(now, slot_bytes(docs, slots=slots)), path), None, "bytes", slots)
