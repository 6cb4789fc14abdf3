"""Operator 6: sharding by fixed virtual slots, in DataFrame operations alone.

Records are hashed into ``slots`` virtual slots; rows and bytes are added up per slot; a
versioned map says which shard a slot belongs to. Version 1 deals the slots out in turn; each
rebalancing edits the map before it, moving slots from full shards to empty ones until the
bytes are near equal, and stores the result as the next version. The law that holds is
``bytes``.

Only the totals per slot (a fixed number of rows) reach the driver. A row's place in its shard
is its rank in its virtual slot plus the rows of the shard's slots before it: no task ever
sorts a whole shard. A slot that holds more than ``HOT`` of a shard's mean, as that of an id that
very many rows have, is split into ``PARTS`` slots, dealt in turn as the rows are read.

Defined results: a null text has no bytes and so size 1, its crc32 is that of no bytes; null
ids hash like any value; repeated rows get places of their own; the bytes of shards are equal
as far as single rows allow, whatever ids repeat; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import only, shared_dir, stored


HOT, PARTS = 0.25, 256


@dataclass(frozen=True)
class SlotMap:
    """One version of the map: the shard of each slot."""

    version: int
    shards: int
    owner: tuple[int, ...]

    @staticmethod
    def first(slots: int, shards: int) -> SlotMap:
        return SlotMap(1, shards, tuple(s % shards for s in range(slots)))

    def rebalanced(self, load: list[int], shards: int | None = None) -> SlotMap:
        """The next version: slots move from shards above the mean to those below, large slots first, then single swaps close what is left."""
        shards = shards or self.shards
        owner, total = list(self.owner), [0] * shards
        held: list[list[int]] = [[] for _ in range(shards)]
        for slot, shard in enumerate(owner):
            if shard < shards:
                held[shard].append(slot)
                total[shard] += load[slot]
        mean = sum(load) / shards
        loose = [s for s, shard in enumerate(owner) if shard >= shards]
        for shard in range(shards):
            held[shard].sort(key=lambda s: (load[s], s))
            while held[shard] and total[shard] > mean:
                slot = held[shard].pop()
                total[shard] -= load[slot]
                loose.append(slot)
        for slot in sorted(loose, key=lambda s: (-load[s], s)):
            shard = min(range(shards), key=lambda k: (total[k], k))
            owner[slot] = shard
            total[shard] += load[slot]
        for _ in range(4 * shards):
            high, low = max(range(shards), key=lambda k: (total[k], -k)), min(range(shards), key=lambda k: (total[k], k))
            gap = total[high] - total[low]
            tops, bottoms = [s for s, k in enumerate(owner) if k == high], [s for s, k in enumerate(owner) if k == low]
            moves = [(abs(gap - 2 * load[a]), a, None) for a in tops if 0 < load[a] < gap]
            give = sorted(bottoms, key=lambda s: load[s])
            sizes = [load[s] for s in give]
            for a in tops:
                if give and (want := load[a] - gap / 2) > 0:
                    i = min(range(len(sizes)), key=lambda i: abs(sizes[i] - want)) if len(sizes) < 64 else _near(sizes, want)
                    if 0 < load[a] - sizes[i] < gap:
                        moves.append((abs(gap - 2 * (load[a] - sizes[i])), a, give[i]))
            if not moves:
                break
            _, a, b = min(moves, key=lambda m: (m[0], m[1]))
            owner[a] = low
            total[high] -= load[a]
            total[low] += load[a]
            if b is not None:
                owner[b] = high
                total[low] -= load[b]
                total[high] += load[b]
        return SlotMap(self.version + 1, shards, tuple(owner))

    def split(self, slots: list[int], parts: int) -> SlotMap:
        """The same map with ``parts`` more slots for each of ``slots``, on its shard; to be rebalanced."""
        return SlotMap(self.version, self.shards, self.owner + tuple(self.owner[s] for s in slots for _ in range(parts)))

    def shard_of(self, slot: Column) -> Column:
        """The map as a constant of the query: no join."""
        return F.get(F.from_json(F.lit(json.dumps(self.owner)), "array<int>"), slot)

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.range(len(self.owner)).select(F.lit(self.version).alias("version"), F.lit(self.shards).alias("shards"), F.col("id").cast("int").alias("slot"), self.shard_of(F.col("id").cast("int")).alias("shard"))

    def save(self, spark: SparkSession, folder: str) -> None:
        """Add this version to a stored map; versions are never overwritten."""
        self.rows(spark).coalesce(1).write.parquet(f"{folder}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, folder: str, version: int | None = None) -> SlotMap:
        """A stored version, the newest by default."""
        rows = spark.read.parquet(f"{folder}/version=*")
        version = version or rows.agg(F.max("version")).first()[0]
        got = rows.where(F.col("version") == version).orderBy("slot").select("shards", "shard").collect()
        return SlotMap(version, got[0]["shards"], tuple(r["shard"] for r in got))


def _near(sizes: list[int], want: float) -> int:
    """Index of the size nearest to ``want`` in a sorted list."""
    low, high = 0, len(sizes) - 1
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if sizes[middle] < want else (low, middle)
    return low if low == 0 or sizes[low] - want < want - sizes[low - 1] else low - 1


def virtual_slot(id_col: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(slots)).cast("int")


def shard_documents(docs: DataFrame, shards: int = 16, slots: int = 4096, folder: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version of each row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    facts = only(docs, "doc_id", "text").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), virtual_slot(F.col("doc_id"), slots).alias("virtual_slot"))
    facts = stored(facts.withColumn("turn", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int")), "slots")  # the texts are read once
    sums = F.sum("size").alias("bytes"), F.count("*").alias("rows")
    totals = {r["virtual_slot"]: (int(r["bytes"]), int(r["rows"])) for r in facts.groupBy("virtual_slot").agg(*sums).collect()}  # one row a slot
    folder = folder or shared_dir(spark, "slot-map")
    first = SlotMap.first(slots, shards)
    first.save(spark, folder)
    most = HOT * sum(n for n, _ in totals.values()) / shards
    hot = sorted(s for s, (n, rows) in totals.items() if n > most and rows > 1)  # at most shards / HOT
    if hot:
        part = F.get(F.from_json(F.lit(json.dumps([slots + PARTS * hot.index(s) if s in hot else -1 for s in range(slots)])), "array<int>"), F.col("virtual_slot"))
        facts = facts.withColumn("virtual_slot", F.when(part >= 0, part + F.col("turn")).otherwise(F.col("virtual_slot")))
        totals = {s: t for s, t in totals.items() if s not in hot}
        totals |= {r["virtual_slot"]: (int(r["bytes"]), int(r["rows"])) for r in facts.where(F.col("virtual_slot") >= slots).groupBy("virtual_slot").agg(*sums).collect()}
        first = first.split(hot, PARTS)
    every = len(first.owner)
    now = first.rebalanced([totals.get(s, (0, 0))[0] for s in range(every)])
    now.save(spark, folder)
    before, filled = [0] * every, [0] * shards
    for s in range(every):
        before[s] = filled[now.owner[s]]
        filled[now.owner[s]] += totals.get(s, (0, 0))[1]
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    start = F.get(F.from_json(F.lit(json.dumps(before)), "array<bigint>"), F.col("virtual_slot"))
    return facts.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), now.shard_of(F.col("virtual_slot")).alias("shard"), (start + rank - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(now.version).alias("map_version"))
