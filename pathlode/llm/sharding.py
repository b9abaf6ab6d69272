"""Sharding by fixed virtual slots.

Each record is hashed by its id into one of SLOTS virtual slots, for good. Bytes are summed by slot, and a
small versioned table maps slots to shards. The first version deals slots, largest first, to the shard
with the fewest bytes; rebalancing edits the map (moving as few slots as will do) and leaves all other
slots where they are. Records never need to be hashed again.

The law that holds is ``bytes``: the sizes of shards differ by at most the largest virtual slot.

A record's place within its shard is counted from 0 without gaps. It is the count of the shard's records
in earlier parts of the table plus its rank within its own part, so that no task ever ranks a whole shard.

A record's slot follows from its id alone, so copies of one text under different ids may stand in different
shards; only so can sizes stay near equal when one text makes up a third of the table. A record without
an id is hashed by its text.

Defined cases: null text has size 1 and the CRC of no bytes; repeated rows are each placed; rows of one id
share a virtual slot; sizes of shards may tie, then the shard of the smaller number gets the next slot;
an empty table gives no rows and an empty map; texts are only measured, so their length does not matter;
other columns are ignored by :func:`assign_shards` and kept by :func:`shard_documents`, but for those
named like its own.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathlode.llm.common import materialize, scratch_root

SLOTS, SHARDS = 4096, 16
#: Setting of the session: the folder of the stored versions of the map.
MAPS_SETTING = "pathlode.slotMaps"


@dataclass(frozen=True)
class SlotMap:
    """A version of the map: ``shard_of[slot]``."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    def column(self, slot: Column) -> Column:
        return F.element_at(F.lit(list(self.shard_of)), slot.cast("int") + 1)

    def loads(self, sizes: list[int]) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.shard_of):
            out[shard] += sizes[slot]
        return out


def first_map(sizes: list[int], shards: int = SHARDS) -> SlotMap:
    """Largest slots first, each to the shard with the fewest bytes; empty slots follow in turn."""
    heap = [(0, 0, s) for s in range(shards)]
    shard_of = [0] * len(sizes)
    for slot in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        load, held, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (load + sizes[slot], held + 1, shard))
    return SlotMap(1, shards, tuple(shard_of))


def rebalance(old: SlotMap, sizes: list[int], shards: int | None = None) -> SlotMap:
    """The next version for new sizes or a new number of shards.

    Slots of shards that go are dealt anew. Then slots are moved from the fullest to the emptiest shard: those
    dealt anew while it brings the two closer together, others only while the two are further apart than
    the largest slot.
    """
    shards = shards or old.shards
    shard_of = list(old.shard_of)
    loads = [0] * shards
    members: list[list[int]] = [[] for _ in range(shards)]
    homeless = []
    for slot, shard in enumerate(shard_of):
        if shard < shards:
            loads[shard] += sizes[slot]
            members[shard].append(slot)
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda k: (-sizes[k], k)):
        to = min(range(shards), key=lambda s: (loads[s], s))
        shard_of[slot] = to
        loads[to] += sizes[slot]
        members[to].append(slot)
    fresh, largest = set(homeless), max(sizes)
    for _ in range(len(sizes)):
        hi, lo = max(range(shards), key=lambda s: (loads[s], -s)), min(range(shards), key=lambda s: (loads[s], s))
        gap = loads[hi] - loads[lo]
        fitting = [k for k in members[hi] if 0 < sizes[k] < gap and (k in fresh or gap > largest)]
        if not fitting:
            break
        # the slot that comes closest to half the gap
        slot = min(fitting, key=lambda k: (abs(gap - 2 * sizes[k]), k))
        members[hi].remove(slot)
        members[lo].append(slot)
        shard_of[slot] = lo
        loads[hi] -= sizes[slot]
        loads[lo] += sizes[slot]
    return SlotMap(old.version + 1, shards, tuple(shard_of))


def virtual_slot(id_col: Column, text: Column, slots: int = SLOTS) -> Column:
    own = F.when(id_col.isNull(), F.xxhash64(F.lit("no id"), text)).otherwise(F.xxhash64(id_col))
    return F.pmod(own, F.lit(slots)).cast("int")


def measured_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Written table without texts: doc_id, size, text_crc32, vslot, and rid (part and place in the input)."""
    body = F.col(f"`{text}`").cast("string")
    slim = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.encode(body, "UTF-8"), F.lit(b""))).cast("long").alias("text_crc32"),
        virtual_slot(F.col(f"`{id_col}`").cast("long"), body, slots).alias("vslot"),
    )
    return materialize(slim.withColumn("rid", F.monotonically_increasing_id()), "slots")


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes by slot; the result has ``slots`` rows at most."""
    sizes = [0] * slots
    for r in rows.groupBy("vslot").agg(F.sum("size").alias("size")).collect():
        sizes[r.vslot] = r["size"]
    return sizes


def save_map(spark, slot_map: SlotMap, path: str) -> None:
    """Append a version to the table of maps at ``path``."""
    rows = spark.createDataFrame([(slot_map.version, slot_map.shards, slot, shard) for slot, shard in enumerate(slot_map.shard_of)], "version int, shards int, vslot int, shard int")
    rows.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark, path: str, version: int | None = None) -> SlotMap:
    """A version of the map, the newest by default."""
    maps = spark.read.parquet(path)
    version = version if version is not None else maps.agg(F.max("version")).first()[0]
    rows = maps.where(F.col("version") == version).orderBy("vslot").collect()
    return SlotMap(version, rows[0].shards, tuple(r.shard for r in rows))


def stored_map(spark, sizes: list[int], shards: int = SHARDS, maps: str | None = None) -> SlotMap:
    """The map for the sizes, stored at ``maps``: the newest version there, rebalanced (a new version only if a slot
    moves), or else a first one.

    Without ``maps`` and without the setting MAPS_SETTING a first map goes to a folder of its own in the shared folder.
    """
    maps = maps or spark.conf.get(MAPS_SETTING, None)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(maps) if maps else None
    if target is not None and target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        old = load_map(spark, maps)
        new = rebalance(old, sizes, shards)
        if (new.shards, new.shard_of) == (old.shards, old.shard_of):
            return old
    else:
        new = first_map(sizes, shards)
    save_map(spark, new, maps or f"{scratch_root(spark)}/slot-maps-{uuid.uuid4().hex}")
    return new


def place_rows(rows: DataFrame, slot_map: SlotMap) -> DataFrame:
    """Add shard and slot, the row's place within its shard."""
    placed = rows.withColumn("shard", slot_map.column(F.col("vslot"))).withColumn("part", F.shiftright("rid", 33))
    counts = placed.groupBy("part", "shard").agg(F.count("*").alias("c"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("part").alias("p"), F.col("shard").alias("s"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("part", "shard").orderBy("rid")))
    joined = ranked.join(starts, (F.col("part") == F.col("p")) & (F.col("shard") == F.col("s")))
    return joined.withColumn("slot", (F.col("start") + F.col("rank") - 1).cast("long")).drop("p", "s", "start", "rank", "part")


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shards: int = SHARDS, maps: str | None = None) -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version."""
    rows = measured_rows(docs, id_col, text)
    slot_map = stored_map(docs.sparkSession, slot_sizes(rows), shards, maps)
    return place_rows(rows, slot_map).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("vslot").alias("virtual_slot"),
        F.lit(slot_map.version).alias("map_version"),
    )


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shards: int = SHARDS, slot_map: SlotMap | None = None, maps: str | None = None) -> DataFrame:
    """The documents with two more columns, ``shard`` and ``virtual_slot``; the texts are not shuffled."""
    slot = virtual_slot(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text}`").cast("string"))
    if slot_map is None:
        size = (F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + 1).cast("long")
        slot_map = stored_map(docs.sparkSession, slot_sizes(docs.select(slot.alias("vslot"), size.alias("size"))), shards, maps)
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "virtual_slot")], slot_map.column(slot).alias("shard"), slot.alias("virtual_slot"))
