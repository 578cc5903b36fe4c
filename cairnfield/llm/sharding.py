"""Sharding by fixed virtual slots.

A record's id is hashed into one of thousands of virtual slots, for good. A slot map says which shard
a slot belongs to; it is small (one row per slot), versioned and stored, and rebalancing or growing
edits the map, so that only the records of reassigned slots move.

Defined results: a null id hashes like an empty text; a null text has size 8 (no bytes) and the
checksum of nothing; rows with equal ids share a slot and shard and are ordered by checksum and size, equal rows in
any order; however many rows share an id, several tasks number them; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.llm.common import cut, new_path

VIRTUAL_SLOTS = 8192
#: Bytes that a record takes besides its text.
RECORD_OVERHEAD = 8


def virtual_slot(doc_id: Column, slots: int = VIRTUAL_SLOTS) -> Column:
    """First 32 bits of the MD5 of the id's decimal text, modulo slots."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % slots).cast("int")


@dataclass(frozen=True)
class SlotMap:
    """Slot i belongs to shard owners[i]. Bounded by the number of slots, whatever the data."""

    owners: tuple[int, ...]
    version: int = 1
    edits: tuple[tuple[int, int, int], ...] = field(default=(), repr=False)  # slot, from, to of the last version

    @classmethod
    def even(cls, shards: int, slots: int = VIRTUAL_SLOTS) -> SlotMap:
        if not 0 < shards <= slots:
            raise ValueError("shards must be between 1 and the number of slots")
        return cls(tuple(i % shards for i in range(slots)))

    @property
    def shards(self) -> int:
        return max(self.owners) + 1

    def _edited(self, moves: dict[int, int]) -> SlotMap:
        edits = tuple((s, self.owners[s], to) for s, to in sorted(moves.items()))
        return SlotMap(tuple(moves.get(i, o) for i, o in enumerate(self.owners)), self.version + 1, edits)

    def grown(self) -> SlotMap:
        """One more shard, which takes an equal number of slots from the largest shards; no slot moves between old shards."""
        new, held = self.shards, {}
        for slot, owner in enumerate(self.owners):
            held.setdefault(owner, []).append(slot)
        moves: dict[int, int] = {}
        for _ in range(len(self.owners) // (new + 1)):
            giver = max(held, key=lambda s: (len(held[s]), -s))
            moves[held[giver].pop()] = new
        return self._edited(moves)

    def rebalanced(self, slot_bytes: dict[int, int], tolerance: float = 0.02) -> SlotMap:
        """Moves slots from the heaviest to the lightest shard until they differ by tolerance of the mean or no move helps."""
        load = [0] * self.shards
        held: dict[int, list[int]] = {s: [] for s in range(self.shards)}
        for slot, owner in enumerate(self.owners):
            load[owner] += slot_bytes.get(slot, 0)
            held[owner].append(slot)
        goal, moves = sum(load) / self.shards, {}
        for _ in range(len(self.owners)):
            high, low = max(range(self.shards), key=load.__getitem__), min(range(self.shards), key=load.__getitem__)
            gap = load[high] - load[low]
            fits = [s for s in held[high] if 0 < slot_bytes.get(s, 0) < gap]
            if gap <= tolerance * goal or not fits:
                break
            slot = min(fits, key=lambda s: (abs(slot_bytes[s] - gap / 2), s))
            held[high].remove(slot)
            held[low].append(slot)
            load[high] -= slot_bytes[slot]
            load[low] += slot_bytes[slot]
            moves[slot] = low
        return self._edited(moves)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.version, s, o) for s, o in enumerate(self.owners)], "map_version int, virtual_slot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version beside the earlier ones; a version that is there already is an error."""
        self.frame(spark).coalesce(1).write.mode("error").parquet(f"{path}/version={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The version asked for, or the last."""
        if version is None:
            version = spark.read.parquet(path).agg(F.max("map_version")).first()[0]
        rows = spark.read.parquet(f"{path}/version={version}").orderBy("virtual_slot").collect()  # a row a slot
        return cls(tuple(r.shard for r in rows), version)


def rebalance(spark: SparkSession, path: str, records: DataFrame, tolerance: float = 0.02) -> SlotMap:
    """Edits the last stored map by the bytes that records (`sized`) have in each slot, and stores the next version."""
    held = {r["virtual_slot"]: r["slot_bytes"] for r in slot_stats(records).collect()}  # a row a slot
    edited = SlotMap.load(spark, path).rebalanced(held, tolerance)
    edited.save(spark, path)
    return edited


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """id, size in bytes, checksum of the text and virtual slot of every record; the text is read once."""
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(body) + RECORD_OVERHEAD).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        virtual_slot(F.col(id_col), slots).alias("virtual_slot"),
        F.monotonically_increasing_id().alias("row_id"),
    )


def slot_stats(records: DataFrame) -> DataFrame:
    """Rows and bytes of every slot that has any; combined before the shuffle, one row per slot after it."""
    return records.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("slot_rows"), F.sum("size").alias("slot_bytes"))


def assign(records: DataFrame, slot_map: SlotMap) -> DataFrame:
    """Adds shard and the gapless position in the shard (`slot`, from 0); records: as written out.

    Records are range-partitioned by shard, virtual slot, id, checksum, size and row, so that no key, however
    frequent, is one task's, and numbered inside each partition; one row a partition and one a shard say where
    numbers start.
    """
    spark = records.sparkSession
    owners = slot_map.frame(spark).select("virtual_slot", "shard").join(slot_stats(records).select("virtual_slot", "slot_bytes"), "virtual_slot")
    order = ("shard", "virtual_slot", "doc_id", "text_crc32", "size", "row_id")
    ranged = records.join(F.broadcast(owners), "virtual_slot").repartitionByRange(*order).sortWithinPartitions(*order)  # a row a slot
    held = cut(ranged.withColumn("at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftrightunsigned("at", 33)
    sizes = held.groupBy(part.alias("part"), "shard").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a partition, and one more a shard at most
    begins, shards, total = {}, {}, 0
    for r in sorted(sizes):
        begins.setdefault(r["part"], total)
        shards.setdefault(r["shard"], total)
        total += r["n"]
    starts = spark.createDataFrame([(p, n) for p, n in begins.items()], "part long, begins long")
    firsts = spark.createDataFrame([(s, n) for s, n in shards.items()], "shard int, first long")
    placed = held.withColumn("part", part).join(F.broadcast(starts), "part").join(F.broadcast(firsts), "shard")
    return placed.withColumn("slot", F.col("begins") + F.col("at").bitwiseAND((1 << 33) - 1) - F.col("first"))


def shard_documents(docs: DataFrame, shards: int = 24, slots: int = VIRTUAL_SLOTS, map_path: str | None = None) -> DataFrame:
    """The shard of every record by law `key`: its id and the number of shards decide.

    Also gives the shard after adding one (`grown_shard`): a record stays or goes to the new shard. The slot map and
    its edit are stored as versions 1 and 2 under map_path (by default a new folder in the shared one) and read from there.
    """
    spark = docs.sparkSession
    path = map_path or new_path(spark, "slot-map")
    SlotMap.even(shards, slots).save(spark, path)
    first = SlotMap.load(spark, path, 1)
    first.grown().save(spark, path)
    grown = SlotMap.load(spark, path, 2).frame(spark).select("virtual_slot", F.col("shard").alias("grown_shard"))
    records = cut(sized(docs, slots=slots), "sharding")
    return (
        assign(records, first)
        .join(F.broadcast(grown), "virtual_slot")
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "virtual_slot", F.lit(first.version).alias("map_version"), "slot_bytes")
    )


#: DuckDB: the same rows. The checksum is worked out a byte at a time from its table of 256 remainders; slots of version 2 that moved are the last of each shard.
SHARDING_SQL = """
WITH RECURSIVE poly AS (SELECT b, 0 AS k, b::BIGINT AS v FROM range(256) t(b) UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM poly WHERE k < 8),
tab AS (SELECT list(v ORDER BY b) AS t FROM poly WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS body, hex(encode(coalesce(text, ''))) AS h, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % 8192)::INTEGER AS virtual_slot FROM documents),
r AS (
  SELECT doc_id, virtual_slot, octet_length(encode(body)) + 8 AS size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda p: ('0x' || p)::BIGINT)), lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1])), 4294967295) AS text_crc32
  FROM d, tab),
held AS (SELECT v, v % 24 AS shard, row_number() OVER (PARTITION BY v % 24 ORDER BY v DESC) AS from_end, count(*) OVER (PARTITION BY v % 24) AS n FROM range(8192) s(v)),
-- the largest shards give first, the lowest of equals first, until the new one has 8192 // 25 slots
given AS (SELECT v, row_number() OVER (ORDER BY n - from_end DESC, shard) AS turn FROM held),
sums AS (SELECT virtual_slot, sum(size)::BIGINT AS slot_bytes FROM r GROUP BY virtual_slot)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, (virtual_slot % 24)::INTEGER AS shard,
       row_number() OVER (PARTITION BY virtual_slot % 24 ORDER BY virtual_slot, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
       CASE WHEN turn <= 8192 // 25 THEN 24 ELSE virtual_slot % 24 END::INTEGER AS grown_shard, virtual_slot, 1 AS map_version, slot_bytes
FROM r JOIN given ON v = virtual_slot JOIN sums USING (virtual_slot)
"""
