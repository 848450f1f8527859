"""Sharding by fixed virtual slots.

Records hash into thousands of virtual slots, the bytes of each slot are summed, and a map puts every slot into a shard:
largest slot first, into the shard with the fewest bytes so far. The map is a small table with a version. Rebalancing
edits it: slots move, from the fullest shards into the new or emptiest ones, and records follow their slot; nothing is
hashed anew. Only the map, whose size is the number of slots, ever is on the driver.
"""

from __future__ import annotations

import heapq
import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagmill.written import cut, new_folder

SLOTS = 8192
#: Bytes a record has besides its text.
OVERHEAD = 8


def virtual_slot(slots: int = SLOTS) -> Column:
    """The virtual slot of a record: of its id and its text's checksum, so that rows without an id spread too."""
    return F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int")


def slot_loads(records: DataFrame) -> DataFrame:
    """(virtual_slot, bytes, records) of ``records`` (virtual_slot, size), summed before and after one shuffle of slots."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("records"))


def _as_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    schema = "virtual_slot int, shard int, version int"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema.replace(' int', ': int')}>>")))


def first_map(loads: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map (virtual_slot, shard, version) for the slots in ``loads``."""
    heap = [(0, s) for s in range(shards)]
    rows = []
    for r in loads.orderBy(F.desc("bytes"), "virtual_slot").collect():  # as many rows as slots, at most
        size, shard = heapq.heappop(heap)
        rows.append({"virtual_slot": r.virtual_slot, "shard": shard, "version": 1})
        heapq.heappush(heap, (size + r.bytes, shard))
    return _as_table(loads.sparkSession, rows)


def edit_map(slot_map: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next version, for ``shards`` shards, as many as before or more; slots move only out of shards above the mean.

    If shards are new, slots move into these only; else into the emptiest. While a slot of the fullest shard fits there
    without filling it beyond the mean, the largest such slot moves. Slots new in ``loads`` are added. Every other
    slot keeps its shard, so few records travel. Loads without rows keep the known slots; ties go to the smaller slot
    and shard; a slot without bytes never moves. ``loads`` must have one row a slot.
    """
    known = {r.virtual_slot: r.shard for r in slot_map.collect()}
    version = max((r.version for r in slot_map.select("version").distinct().collect()), default=0) + 1
    size = {r.virtual_slot: r.bytes for r in loads.collect()}
    held: dict[int, list[tuple[int, int]]] = {s: [] for s in range(shards)}
    total = dict.fromkeys(range(shards), 0)
    for slot in sorted(size, key=lambda s: (-size[s], s)):
        shard = known.get(slot, min(total, key=lambda s: (total[s], s)))
        held[shard].append((size[slot], slot))
        total[shard] += size[slot]
    mean = sum(total.values()) / shards
    fresh = set(range(shards)) - set(known.values())
    takers = fresh or set(total)
    while True:
        full, empty = max(total, key=lambda s: (total[s], -s)), min(takers, key=lambda s: (total[s], s))
        room = min(mean - total[empty], total[full] - total[empty] - 1)
        fitting = [x for x in held[full] if 0 < x[0] <= room]
        if not fitting or total[full] <= mean:
            break
        move = max(fitting)
        held[full].remove(move)
        held[empty].append(move)
        total[full] -= move[0]
        total[empty] += move[0]
    rows = [{"virtual_slot": slot, "shard": shard, "version": version} for shard, own in held.items() for _, slot in own]
    return _as_table(loads.sparkSession, rows)


def store_map(slot_map: DataFrame, path: str) -> None:
    """Append a version of the map to the table at ``path``."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The map of ``version``, or the latest, from the table at ``path``."""
    versions = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    latest = versions.agg(F.max("version")).first()[0] if version is None else version
    return versions.filter(F.col("version") == F.lit(latest))


def current_map(loads: DataFrame, shards: int, path: str) -> DataFrame:
    """The latest map at ``path`` if it covers ``loads`` and ``shards``; else the next version, which is stored first."""
    spark = loads.sparkSession
    try:
        known = load_map(spark, path)
    except AnalysisException:  # no map there yet
        known = None
    if known is None:
        store_map(first_map(loads, shards), path)
    elif known.agg(F.max("shard")).first()[0] != shards - 1 or not loads.join(known, "virtual_slot", "left_anti").isEmpty():
        store_map(edit_map(known, loads, shards), path)
    return load_map(spark, path)


def spread_masses(records: DataFrame, slots: int) -> DataFrame:
    """``records`` (doc_id, size, text_crc32, place) with virtual_slot.

    A record's slot is a hash of its id and checksum. Rows equal in both would all be in one slot; where they are more
    than a slot's mean of rows, each takes the slot of its place in the table instead. Such masses are fewer than slots.
    """
    mean = max(1, -(-records.count() // slots))
    masses = cut(records.groupBy("doc_id", "text_crc32").agg(F.count("*").alias("n")).filter(F.col("n") > mean).select(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc")), "masses")
    by_place = F.pmod(F.xxhash64("place"), F.lit(slots)).cast("int")
    same = records["doc_id"].eqNullSafe(masses["_id"]) & (records["text_crc32"] == masses["_crc"])
    marked = records.join(F.broadcast(masses), same, "left")
    return marked.select("doc_id", "size", "text_crc32", "place", F.when(F.col("_crc").isNotNull(), by_place).otherwise(virtual_slot(slots)).alias("virtual_slot"))


def shard(docs: DataFrame, shards: int, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None) -> DataFrame:
    """Every row of ``docs`` in a shard: doc_id, size, text_crc32, virtual_slot, shard, slot (its place in the shard, gapless from 0), map_version.

    The law is `bytes`: shards get sizes near equal. The slot map is stored at ``map_path`` (or in the shared folder) and read
    back from there: the first run stores version 1; a run that finds a map keeps its shards and stores an edited version
    only where slots or the number of shards are new. Null texts count as empty (size OVERHEAD), texts are measured
    whole. Rows with a null doc_id, equal and repeated rows are placed each; extra columns are ignored; an empty table
    gives an empty result. Places follow the virtual slots' order in the shard, then doc_id, checksum and place in
    the table. Places are counted inside a virtual slot, never inside a whole shard, and shifted by the records of the
    slots before.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    numbered = cut(sized.withColumn("place", F.monotonically_increasing_id()), "numbered")  # written, so a place never changes
    records = spread_masses(numbered, slots)
    loads = cut(slot_loads(records), "loads")
    slot_map = current_map(loads, shards, map_path or new_folder(spark, "slot-map"))
    before = F.sum("records").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1))
    placed = cut(loads.join(F.broadcast(slot_map), "virtual_slot").select("virtual_slot", "shard", "version", F.coalesce(before, F.lit(0)).alias("first")), "placed")
    inside = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "place")) - 1
    return (
        records.withColumn("inside", inside)
        .join(F.broadcast(placed), "virtual_slot")
        .select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("first") + F.col("inside")).cast("long").alias("slot"), F.col("version").alias("map_version"))
    )
