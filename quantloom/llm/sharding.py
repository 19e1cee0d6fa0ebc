"""Sharding by a permutation-filled lookup table (Maglev), natively.

Every shard has its own permutation of the slots of a prime-sized table (an offset and a skip
from hashes of its name); the shards take turns, each claiming the first slot of its
preference that is still free, until the table is full. A row's key hashes to a slot, whose
shard is its placement: one probe, even loads, and few moves when the shard set changes.

The table has a fixed size, so it is filled on the driver and broadcast; the placement is
a hash and an equi-join.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots, a prime of over a hundred times the shards.
SLOTS = 2039
SHARDS = tuple(f"shard-{i:02d}" for i in range(16))


def _md5(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def preferences(shard: str, slots: int) -> tuple[int, int]:
    """(offset, skip) of the shard's permutation (offset + i * skip) mod slots."""
    return _md5(f"{shard}/offset") % slots, _md5(f"{shard}/skip") % (slots - 1) + 1


def lookup_table(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[str]:
    """Shard of every slot. slots is prime, so each permutation reaches every slot."""
    table: list[str | None] = [None] * slots
    pref = [preferences(s, slots) for s in shards]
    tried = [0] * len(shards)
    left = slots if shards else 0
    while left:
        for k, (offset, skip) in enumerate(pref):
            while table[slot := (offset + tried[k] * skip) % slots] is not None:
                tried[k] += 1
            table[slot] = shards[k]
            left -= 1
            if not left:
                break
    return table  # type: ignore[return-value]


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The first 32 bits of the MD5 of the key's text (null: of ""), modulo the slots."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % slots).cast("long")


def placed(docs: DataFrame, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, key: str = "doc_id") -> DataFrame:
    """``docs`` plus slot and shard. Equal keys share a shard, null keys too; rows of equal
    keys stay as many; an empty table gives no rows. Own columns of these names give way."""
    listed = F.split(F.lit("\x1f".join(lookup_table(shards, slots))), "\x1f")
    table = docs.sparkSession.range(1).select(F.posexplode(listed).alias("slot", "shard"))
    table = table.withColumn("slot", F.col("slot").cast("long"))
    return docs.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots)).join(F.broadcast(table), "slot")


def write_shards(docs: DataFrame, path: str, **options: object) -> None:
    """Write one folder per shard; each task writes the rows it has, without a shuffle."""
    placed(docs, **options).drop("slot").write.partitionBy("shard").parquet(path)


def placement(docs: DataFrame) -> DataFrame:
    """doc_id, slot and shard of every document."""
    return placed(docs.select(F.col("doc_id").cast("long").alias("doc_id"))).select("doc_id", "slot", "shard")


def oracle_sql(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> str:
    """The table is filled by a recursion of one claim a step, over lists."""
    n = len(shards)
    names = ", ".join(f"'{s}'" for s in shards)
    hashed = lambda what: f"CAST('0x' || substr(md5(s || '/{what}'), 1, 8) AS BIGINT)"
    return f"""WITH RECURSIVE
        pref AS (SELECT k, list_transform(range({slots}), lambda i: ({hashed("offset")} % {slots} + i * ({hashed("skip")} % {slots - 1} + 1)) % {slots}) p
            FROM (SELECT unnest(range({n})) k, unnest([{names}]) s)),
        fill AS (
            SELECT 0 AS step, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS slot
            UNION ALL
            SELECT step + 1, list_append(taken, s), s
            FROM (SELECT step, taken, list_extract(list_filter(p, lambda x: NOT list_contains(taken, x)), 1) s
                FROM fill JOIN pref ON k = step % {n} WHERE step < {slots})),
        tab AS (SELECT slot, list_extract([{names}], (step - 1) % {n} + 1) shard FROM fill WHERE step > 0)
        SELECT doc_id, slot, shard FROM (SELECT doc_id, CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT) % {slots} slot FROM documents) JOIN tab USING (slot)"""
