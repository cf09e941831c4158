"""Sharding over fixed virtual slots.

Records hash into a fixed number of slots. Bytes and rows are summed per slot, and a versioned map says which shard
holds each slot. Rebalancing edits that map and never the hash, so a new version moves whole slots only.
Everything that touches records is DataFrame code; the driver sees one row per slot, `slots` rows at most.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import cut_lineage, read_table, shared_folder

SLOTS = 4096
SHARDS = 16
#: Equal rows that share a slot, and the most blocks that equal rows are dealt in.
COPIES, BLOCKS = 64, 1 << 16


@dataclass(frozen=True)
class SlotMap:
    """shard_of[slot] is a shard; edits lists (version, slot, old shard, new shard)."""

    version: int
    shards: int
    shard_of: tuple[int, ...]
    edits: tuple[tuple[int, int, int, int], ...] = field(default=())

    @staticmethod
    def initial(slots: int = SLOTS, shards: int = SHARDS) -> SlotMap:
        return SlotMap(1, shards, tuple(s % shards for s in range(slots)))

    def edited(self, moves: dict[int, int], shards: int | None = None) -> SlotMap:
        """The next version, with the slots in `moves` on new shards."""
        v = self.version + 1
        log = tuple((v, s, self.shard_of[s], to) for s, to in sorted(moves.items()) if self.shard_of[s] != to)
        new = tuple(moves.get(s, old) for s, old in enumerate(self.shard_of))
        return SlotMap(v, shards or self.shards, new, self.edits + log)

    def grown(self, load: list[int]) -> SlotMap:
        """One more shard, which takes slots from the fullest shards up to its share; no other slot moves."""
        n, total = self.shards + 1, sum(load)
        held = [[] for _ in range(self.shards)]
        sums = [0] * self.shards
        for s, shard in enumerate(self.shard_of):
            held[shard].append(s)
            sums[shard] += load[s]
        for x in held:
            x.sort(key=lambda s: (load[s], s))
        heap = [(-sums[i], i) for i in range(self.shards)]
        heapq.heapify(heap)
        moves, got = {}, 0
        while heap and got < total // n:
            _, i = heapq.heappop(heap)
            if not held[i]:
                continue
            s = held[i].pop()
            if got + load[s] <= total // n:
                moves[s] = n - 1
                got += load[s]
                sums[i] -= load[s]
            heapq.heappush(heap, (-sums[i], i))
        return self.edited(moves, n)

    def rebalanced(self, load: list[int]) -> SlotMap:
        """Move or swap slots between the fullest and the emptiest shard while that narrows their gap."""
        shard_of, sums = list(self.shard_of), [0] * self.shards
        held: list[set[int]] = [set() for _ in range(self.shards)]
        for s, shard in enumerate(shard_of):
            sums[shard] += load[s]
            held[shard].add(s)
        for _ in range(4 * len(shard_of)):
            order = sorted(range(self.shards), key=lambda i: (sums[i], i))
            best = None
            for low in order[: max(1, self.shards // 2)]:
                top = order[-1]
                gap = sums[top] - sums[low]
                if gap <= 1:
                    break
                best = _best_exchange(held[top], held[low], load, gap)
                if best:
                    break
            if not best:
                break
            give, take = best
            for s, a, b in ((give, top, low), (take, low, top)):
                if s is not None:
                    held[a].remove(s)
                    held[b].add(s)
                    shard_of[s] = b
                    sums[a] -= load[s]
                    sums[b] += load[s]
        return self.edited({s: to for s, to in enumerate(shard_of) if to != self.shard_of[s]})

    def lookup(self, slot: Column) -> Column:
        """The shard of a slot, from a literal that Catalyst folds into one array of `slots` integers."""
        return F.split(F.lit(",".join(map(str, self.shard_of))), ",")[slot].cast("int")


def _best_exchange(top: set[int], low: set[int], load: list[int], gap: int) -> tuple[int, int | None] | None:
    """The slot to give (and one to take back, or None) that brings the gap nearest to zero; None if nothing narrows it."""
    gives = sorted((load[s], s) for s in top if load[s])
    takes = sorted((load[s], s) for s in low)
    takes = [(0, None), *takes]
    best, left, j = None, gap, 0
    for a, s in gives:
        while j + 1 < len(takes) and abs(gap - 2 * (a - takes[j + 1][0])) <= abs(gap - 2 * (a - takes[j][0])):
            j += 1
        rest = abs(gap - 2 * (a - takes[j][0]))
        if rest < left:
            best, left = (s, takes[j][1]), rest
    return best


def slot_of(*keys: Column | str, slots: int = SLOTS) -> Column:
    """The virtual slot of a record's keys together; a null is a value like any other."""
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def slot_loads(records: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot, from columns vslot, size, copies. At most `slots` rows reach the driver."""
    load, rows = [0] * slots, [0] * slots
    for r in records.groupBy("vslot").agg(F.sum(F.col("size") * F.col("copies")).alias("b"), F.sum("copies").alias("n")).collect():
        load[r["vslot"]], rows[r["vslot"]] = r["b"], r["n"]
    return load, rows


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> tuple[DataFrame, SlotMap]:
    """Rows of documents with their size, virtual slot, shard and gapless position in the shard, and the slot map.

    Size is the text's UTF-8 bytes plus 1; a null text has size 1 and crc 0. A row's slot comes from its doc_id, size and
    crc, so that many texts under one doc_id, or under none, spread over all slots. Equal rows (in all three) are counted
    before the shuffle and expanded at the end, so that a hot document is never gathered; they go in blocks of COPIES rows (of
    more, if there are more than BLOCKS such blocks), each with a slot of its own, so that they spread too. A null doc_id
    is a key like others. No row is dropped; an empty table gives an empty result and version 2 of the initial map.
    Columns other than doc_id and text are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    records = (
        docs.select(F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
        .groupBy("doc_id", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("blocks", F.least(F.ceil(F.col("copies") / COPIES), F.lit(BLOCKS)))
        .withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)")))
        .withColumn("copies", F.expr("(block + 1) * copies div blocks - block * copies div blocks"))
        .withColumn("vslot", F.when(F.col("block") == 0, slot_of("doc_id", "size", "text_crc32", slots=slots)).otherwise(slot_of("doc_id", "size", "text_crc32", "block", slots=slots)))
        .drop("blocks")
    )
    records = cut_lineage(records)
    load, rows = slot_loads(records, slots)
    slot_map = SlotMap.initial(slots, shards).rebalanced(load)
    base, first = [0] * slots, [0] * shards
    for s, shard in enumerate(slot_map.shard_of):
        base[s] = first[shard]
        first[shard] += rows[s]
    vslot = F.col("vslot")
    ahead = Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32", "block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.split(F.lit(",".join(map(str, base))), ",")[vslot].cast("long") + F.coalesce(F.sum("copies").over(ahead), F.lit(0))
    placed = (
        records.withColumn("start", start)
        .withColumn("slot", F.explode(F.expr("sequence(start, start + copies - 1)")))
        .select("doc_id", "size", "text_crc32", slot_map.lookup(vslot).alias("shard"), "slot", F.col("vslot").alias("virtual_slot"), F.lit(slot_map.version).alias("map_version"))
    )
    return placed, slot_map


def write_slot_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Write this version of the map and the edits that led to it, each into the version's own folder.

    A folder is overwritten as a whole, so a write that is tried again leaves the same rows. Its slots come last: a version
    without them isn't there yet.
    """
    before = list(slot_map.shard_of)
    for version, slot, old, _ in slot_map.edits:
        if version == slot_map.version:
            before[slot] = old
    slots = spark.range(len(before)).coalesce(1).select(F.col("id").cast("int").alias("slot"))
    old, new = (SlotMap(0, 0, tuple(x)).lookup(F.col("slot")) for x in (before, slot_map.shard_of))
    edits = slots.select("slot", old.alias("old_shard"), new.alias("new_shard")).filter("old_shard <> new_shard")
    edits.write.mode("overwrite").parquet(f"{path}/edits/version={slot_map.version}")
    slots.select("slot", slot_map.lookup(F.col("slot")).alias("shard"), F.lit(slot_map.shards).alias("shards")).write.mode("overwrite").parquet(f"{path}/slots/version={slot_map.version}")


def read_slot_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored version of the map, the latest by default, with all edits up to it."""
    table = spark.read.parquet(f"{path}/slots")
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    rows = table.filter(F.col("version") == version).orderBy("slot").collect()
    edits = spark.read.schema("slot int, old_shard int, new_shard int, version int").parquet(f"{path}/edits").filter(F.col("version") <= version).orderBy("version", "slot")
    return SlotMap(version, rows[0]["shards"], tuple(r["shard"] for r in rows), tuple((r["version"], r["slot"], r["old_shard"], r["new_shard"]) for r in edits.collect()))


def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes, by the stored map: its first version and its edit are written, the latest is read."""
    placed, slot_map = shard_documents(read_table(spark, sf_dir, "documents"))
    path = f"{shared_folder(spark)}/slot-maps/{uuid.uuid4().hex}"
    write_slot_map(spark, SlotMap.initial(), path)
    write_slot_map(spark, slot_map, path)
    stored = read_slot_map(spark, path)
    shard = stored.lookup(F.col("virtual_slot")).alias("shard")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), shard, "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(stored.version).alias("map_version"))
