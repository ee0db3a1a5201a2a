"""Sharding by fixed virtual slots.

Every record is hashed into one of SLOTS virtual slots; bytes are summed per slot; a versioned map gives the
shard of each slot. Version 1 deals the slots in turn. Rebalancing edits a version into the next: slots move (or
swap) from the heaviest to the lightest shard while that narrows the gap. Records never need to be hashed anew,
only the slots named in an edit move. Only the map (SLOTS rows) is handled on the driver.

The law kept here is `bytes`: the shards' sizes end up near equal. A document is never cut, so they are as near
as whole slots allow.

Defined results: a null text has no bytes (its size is the 8 bytes overhead, its checksum 0); the slot hash
takes id, size and checksum, so rows without id spread too; equal rows share a virtual slot and get different
places; an empty table gives an empty result; other columns are ignored by `assign`, kept by `write_shards`.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from sparktab.functions.staging import stage_path
from sparktab.llm.common import keep, query, table

SLOTS = 4096
SHARDS = 24
OVERHEAD = 8
CELL_ROWS = 500_000  # rows numbered by one window group
MAP_SCHEMA = T.StructType([T.StructField("version", T.LongType()), T.StructField("virtual_slot", T.IntegerType()),
                           T.StructField("shard", T.IntegerType())])


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 of each row."""
    text = F.col("text")
    return docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("bigint").alias("size"),
                       F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"))


def slot_of(slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(slots)).cast("int")


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 1: slots dealt in turn."""
    return [s % shards for s in range(slots)]


def rebalance(shard_of: list[int], load_of: list[int], shards: int) -> list[int]:
    """The next version of a map: moves and swaps from the heaviest to the lightest shard while the gap shrinks.

    `load_of` has the bytes of each slot. Works on the map only, so its cost doesn't depend on the records.
    """
    shard_of = list(shard_of)
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(shard_of):
        held[shard].append((load_of[slot], slot))
    for own in held:
        own.sort()
    total = [sum(x for x, _ in own) for own in held]

    def put(item, a, b):
        held[a].remove(item)
        held[b].insert(bisect_left(held[b], item), item)
        total[a] -= item[0]
        total[b] += item[0]
        shard_of[item[1]] = b

    for _ in range(20 * len(shard_of)):
        a, b = max(range(shards), key=total.__getitem__), min(range(shards), key=total.__getitem__)
        gap = total[a] - total[b]
        best, most = None, 0  # what shifting x bytes gains: gap - |gap - 2x|
        heavy, light = held[a], [(0, -1), *held[b]]
        for back in light:
            at = bisect_left(heavy, (back[0] + gap / 2, -1))
            for item in heavy[max(0, at - 1):at + 1]:
                gain = gap - abs(gap - 2 * (item[0] - back[0]))
                if gain > most:
                    best, most = (item, back), gain
        if best is None or most <= gap / 1000:
            break
        put(best[0], a, b)
        if best[1][1] >= 0:
            put(best[1], b, a)
    return shard_of


def grow(shard_of: list[int], load_of: list[int], shards: int) -> list[int]:
    """The next version for one shard more: slots move only into the new shard, from the heaviest ones."""
    shard_of = list(shard_of)
    total = [0] * (shards + 1)
    for slot, shard in enumerate(shard_of):
        total[shard] += load_of[slot]
    goal = sum(total) / (shards + 1)
    held = [sorted((load_of[s], s) for s, x in enumerate(shard_of) if x == k) for k in range(shards)]
    while True:
        a = max(range(shards), key=total.__getitem__)
        fits = [x for x in held[a] if 0 < x[0] <= min(goal - total[shards], total[a] - goal)]
        if not fits:
            return shard_of
        item = fits[-1]
        held[a].remove(item)
        shard_of[item[1]] = shards
        total[a] -= item[0]
        total[shards] += item[0]


def write_map(spark: SparkSession, path: str, version: int, shard_of: list[int]) -> None:
    """Add one version to the map table; versions written before stay."""
    rows = [(version, slot, shard) for slot, shard in enumerate(shard_of)]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(virtual_slot, shard) of one version, the newest by default."""
    stored = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.filter(F.col("version") == version).select("virtual_slot", "shard")


def balanced_map(rows: DataFrame, path: str, shards: int = SHARDS, slots: int = SLOTS) -> list[int]:
    """Sum bytes per slot of (virtual_slot, size), store versions 1 and 2 of the map at `path`, return version 2."""
    load = [0] * slots
    for slot, size in rows.groupBy("virtual_slot").agg(F.sum("size")).collect():  # at most `slots` rows
        load[slot] = size
    one = first_map(shards, slots)
    two = rebalance(one, load, shards)
    write_map(rows.sparkSession, path, 1, one)
    write_map(rows.sparkSession, path, 2, two)
    return two


def assign(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (place in the shard, gapless from 0), virtual_slot.

    Places are numbered inside cells: a virtual slot, cut by input partition where it is large. The offsets of
    the cells come from their counts.
    """
    spark = docs.sparkSession
    rows = keep(sized(docs).withColumn("virtual_slot", slot_of(slots)).withColumn("part", F.spark_partition_id()), "shard-rows")
    path = stage_path(spark, "slot-map")
    balanced_map(rows, path, shards, slots)
    largest = rows.groupBy("virtual_slot").count().agg(F.max("count")).first()[0] or 0
    cells = -(-largest // cell_rows) or 1
    rows = rows.withColumn("cell", F.pmod(F.col("part"), F.lit(cells))).drop("part")
    counts = rows.groupBy("virtual_slot", "cell").count().join(F.broadcast(read_map(spark, path)), "virtual_slot")
    before = W.partitionBy("shard").orderBy("virtual_slot", "cell").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("virtual_slot", "cell", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    if slots * cells <= 50_000:
        starts = F.broadcast(starts)
    inside = W.partitionBy("virtual_slot", "cell").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("n", F.row_number().over(inside).cast("bigint") - 1)
    return (placed.join(starts, ["virtual_slot", "cell"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("n")).alias("slot"),
                    "virtual_slot"))


def write_shards(docs: DataFrame, map_path: str, out: str, slots: int = SLOTS, version: int | None = None) -> None:
    """Write the rows, all their columns, into one folder per shard by a stored map."""
    text = F.col("text")
    key = docs.withColumns({"__size": (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("bigint"),
                            "__crc": F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("bigint")})
    slot = F.pmod(F.xxhash64("doc_id", "__size", "__crc"), F.lit(slots)).cast("int")
    shard = read_map(docs.sparkSession, map_path, version).select(F.col("virtual_slot").alias("__slot"), F.col("shard").alias("__shard"))
    (key.withColumn("__slot", slot).join(F.broadcast(shard), "__slot")
     .select("__shard", *[F.col(f"`{x}`") for x in docs.columns])
     .write.partitionBy("__shard").parquet(out))


@query("op3_sharding")
def op3_sharding(spark, folder):
    return (assign(table(spark, folder, "documents"))
            .select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"))
