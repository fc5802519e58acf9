"""Sharding by fixed virtual slots (native DataFrame operations only).

Records hash into a fixed number of virtual slots; bytes are summed per slot, and
a small versioned table says which shard owns which slot. Versions of the map are
Parquet tables side by side in one folder: a version is written once, and later
runs place records by the newest one that has their number of shards, and write the
next one only if there is none, or when they rebalance. Rebalancing edits that table only: records never change slots. The
slot table has ``n_slots`` rows whatever the input, so it is the one thing that
is gathered, to be edited, or broadcast.

Null keys, repeated keys and null texts are placed like any others (a null key
hashes as its type's null, so repeated nulls share a slot). Slots that such keys
fill are ranked in parts, of which there are at most ``PARTS`` times as many as
slots. An empty table gives an empty result. Columns that are not used may have
any names; :func:`assign_slots` keeps them.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import cut, drop, shared_dir

N_SLOTS = 8192
#: A slot is ranked in parts beyond so many rows, or so many times the mean slot.
PART_ROWS, PARTS = 1000, 4
#: How far above the mean a shard may be before slots leave it.
SLACK = 0.01


def slot_of(*keys: Column, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n_slots)).cast("int")


def assign_slots(df: DataFrame, key: str, size: Column, n_slots: int = N_SLOTS) -> DataFrame:
    """Adds ``virtual_slot`` and ``size``; a column of that name is replaced."""
    return df.withColumns({"virtual_slot": slot_of(F.col(key), n_slots=n_slots), "size": size.cast("long")})


def slot_totals(slotted: DataFrame) -> DataFrame:
    return slotted.groupBy("virtual_slot").agg(F.sum("size").alias("slot_bytes"), F.count(F.lit(1)).alias("slot_rows"))


def _known(totals: DataFrame) -> dict[int, int]:
    return {r.virtual_slot: r.slot_bytes or 0 for r in totals.collect()}


def _map(spark: SparkSession, shards: list[int], version: int, totals: DataFrame) -> DataFrame:
    """The table of a map; the list goes in as one literal."""
    listed = F.posexplode(F.split(F.lit(",".join(map(str, shards))), ",")).alias("virtual_slot", "shard")
    owners = spark.range(1).select(F.lit(version).alias("version"), listed).withColumn("shard", F.col("shard").cast("int"))
    full = owners.join(F.broadcast(totals.select("virtual_slot", "slot_bytes", "slot_rows")), "virtual_slot", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return full.select("version", "virtual_slot", "shard", zero("slot_bytes"), zero("slot_rows"))


def build_map(spark: SparkSession, totals: DataFrame, n_shards: int, n_slots: int = N_SLOTS, version: int = 1) -> DataFrame:
    """First map: slots from the heaviest down, each to the lightest shard.

    ``totals`` has at most ``n_slots`` rows, a constant.
    """
    known = _known(totals)
    heap = [(0, s) for s in range(n_shards)]
    shards = [0] * n_slots
    for slot in sorted(range(n_slots), key=lambda s: (-known.get(s, 0), s)):
        load, shards[slot] = heapq.heappop(heap)
        heapq.heappush(heap, (load + known.get(slot, 0), shards[slot]))
    return _map(spark, shards, version, totals)


def rebalance_map(spark: SparkSession, current: DataFrame, n_shards: int, totals: DataFrame | None = None, slack: float = SLACK) -> DataFrame:
    """Next version of the map for ``n_shards``, moving as few bytes as it takes.

    ``totals`` are fresh sums of the slots; without them those of the map count.
    Slots of removed shards go to the lightest ones. Then, as long as a shard is
    more than ``slack`` off the mean, the heaviest that can gives the lightest
    its largest slot that does not lift it above the mean; if there are new
    shards, they alone receive. Every other slot stays.
    """
    rows = sorted(current.collect(), key=lambda r: r.virtual_slot)
    totals = current if totals is None else totals
    known = _known(totals)
    shards = [r.shard for r in rows]
    weight = [known.get(k, 0) for k in range(len(rows))]
    loads, owned = [0] * n_shards, [[] for _ in range(n_shards)]

    def give(slot: int, to: int) -> None:
        shards[slot] = to
        loads[to] += weight[slot]
        owned[to].append(slot)

    for slot in sorted(range(len(rows)), key=lambda k: (shards[k] >= n_shards, -weight[k], k)):
        give(slot, shards[slot] if shards[slot] < n_shards else min(range(n_shards), key=lambda s: (loads[s], s)))
    mean = sum(loads) / n_shards
    takers = [s for s in range(n_shards) if not owned[s]] or range(n_shards)
    moving = bool(rows)
    while moving:
        to = min(takers, key=lambda s: (loads[s], s))
        moving = False
        if max(loads) > mean * (1 + slack) or loads[to] < mean * (1 - slack):
            for at in sorted(range(n_shards), key=lambda s: (-loads[s], s)):
                fits = [k for k in owned[at] if 0 < weight[k] <= mean - loads[to]] if loads[at] > mean else []
                if fits:
                    slot = max(fits, key=lambda k: (weight[k], -k))
                    owned[at].remove(slot)
                    loads[at] -= weight[slot]
                    give(slot, to)
                    moving = True
                    break
    version = max((r.version for r in rows), default=0) + 1
    return _map(spark, shards, version, totals)


def save_map(slot_map: DataFrame, folder: str) -> int:
    """Write a map as its version's table in ``folder``; a version that is there
    already is an error. Returns the version."""
    kept = cut(slot_map, "slot-map")
    version = kept.agg(F.max("version")).first()[0]
    kept.coalesce(1).write.mode("error").parquet(f"{folder.rstrip('/')}/version={version:08d}")
    drop(kept)
    return version


def versions(spark: SparkSession, folder: str) -> dict[int, int]:
    """Number of shards of each version in ``folder``, none if there is no folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/"))
    if not list(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path.suffix("/version=*")) or []):
        return {}
    rows = spark.read.parquet(folder.rstrip("/")).groupBy("version").agg((F.max("shard") + 1).alias("n")).collect()
    return {int(r.version): r.n for r in rows}


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """That version of the map in ``folder``, or the latest."""
    every = spark.read.parquet(folder.rstrip("/"))
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == F.lit(version)).select(F.col("version").cast("int").alias("version"), "virtual_slot", "shard", "slot_bytes", "slot_rows")


def place_map(spark: SparkSession, totals: DataFrame, n_shards: int, n_slots: int, folder: str) -> int:
    """The version in ``folder`` by which records go into ``n_shards`` shards: the
    newest that has so many. If there is none, one is written: an edit of the newest,
    or the first map of an empty folder. Nothing is written otherwise."""
    known = versions(spark, folder)
    fit = [v for v, n in known.items() if n == n_shards]
    if fit:
        return max(fit)
    if not known:
        return save_map(build_map(spark, totals, n_shards, n_slots), folder)
    return save_map(rebalance_map(spark, load_map(spark, folder, max(known)), n_shards, totals), folder)


def compare_maps(one: DataFrame, two: DataFrame) -> DataFrame:
    """Slots that change hands: ``virtual_slot, shard_from, shard_to, slot_bytes``."""
    a = one.select("virtual_slot", F.col("shard").alias("shard_from"))
    return a.join(two.select("virtual_slot", F.col("shard").alias("shard_to"), "slot_bytes"), "virtual_slot").where("shard_from <> shard_to")


def _parts(slotted: DataFrame) -> DataFrame:
    """``virtual_slot, part, rows, parts`` of all slots that have rows: hot ones
    have several parts, and their number is bounded by that of the slots."""
    counts = cut(slotted.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("n")), "slot-counts")
    mean = counts.agg(F.avg("n")).first()[0] or 0
    sized = counts.select("virtual_slot", F.ceil(F.col("n") / F.lit(max(PART_ROWS, PARTS * mean))).cast("int").alias("parts"))
    by_part = slotted.join(F.broadcast(sized), "virtual_slot").withColumn("part", F.pmod("salt", "parts").cast("int"))
    return cut(by_part.groupBy("virtual_slot", "part", "parts").agg(F.count(F.lit(1)).alias("rows")), "slot-parts")


def apply_map(slotted: DataFrame, slot_map: DataFrame, key: str, *ties: str) -> DataFrame:
    """Adds ``shard`` and ``slot``, the record's gapless place within its shard.

    ``slotted`` is a written table with ``virtual_slot`` and a random ``salt``.
    A shard's places run through its virtual slots in order, through the parts
    of a hot slot, and within a part by key and ``ties``; only the parts' row
    counts are summed up ahead of that, so no task ever orders a whole shard, or
    a whole slot that one key fills.
    """
    owners = slot_map.select("virtual_slot", "shard")
    ahead = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = _parts(slotted).join(F.broadcast(owners), "virtual_slot")
    first = cut(parts.withColumn("first", F.coalesce(F.sum("rows").over(ahead), F.lit(0))).select("virtual_slot", "part", "parts", "shard", "first"), "slot-first")
    sized = first.select("virtual_slot", "parts").distinct()
    own = Window.partitionBy("virtual_slot", "part").orderBy(F.col(key).asc_nulls_first(), *ties, "salt")
    placed = slotted.join(F.broadcast(sized), "virtual_slot").withColumn("part", F.pmod("salt", "parts").cast("int")).drop("parts")
    placed = placed.withColumn("rank", F.row_number().over(own) - 1)
    out = placed.join(F.broadcast(first.drop("parts")), ["virtual_slot", "part"])
    return out.withColumn("slot", F.col("first") + F.col("rank")).drop("first", "rank", "part", "salt")


def shard_documents(docs: DataFrame, n_shards: int = 16, n_slots: int = N_SLOTS, folder: str | None = None) -> DataFrame:
    """Documents -> ``doc_id, size, text_crc32, virtual_slot, shard, slot,
    map_version, next_shard``.

    ``folder`` keeps the versions of the map: records go by the newest one there that
    has ``n_shards`` shards, so equal runs place them alike and write no version. Where
    none has so many, the newest is edited, and an empty folder gets its first map, of
    ``n_slots`` slots. ``next_shard`` is the owner after growth by one shard: an edit of
    that map which is not stored, as no record goes by it yet. Without a folder the map
    is kept for this run only, in the shared folder.
    """
    spark = docs.sparkSession
    if folder is None:
        folder = f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    sizes = versions(spark, folder)
    if sizes:  # slots are fixed when the first map is made
        n_slots = load_map(spark, folder, max(sizes)).count()
    thin = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    slotted = assign_slots(thin, "doc_id", F.col("bytes") + 1, n_slots).drop("bytes").withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    slotted = cut(slotted, "slotted")
    totals = cut(slot_totals(slotted), "slot-totals")
    version = place_map(spark, totals, n_shards, n_slots, folder)
    current = load_map(spark, folder, version)
    grown = rebalance_map(spark, current, n_shards + 1, totals)
    out = apply_map(slotted, current, "doc_id", "size", "text_crc32")
    return out.join(F.broadcast(grown.select("virtual_slot", F.col("shard").alias("next_shard"))), "virtual_slot").withColumn("map_version", F.lit(version))
