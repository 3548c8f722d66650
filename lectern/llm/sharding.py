"""Placing documents on shards by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lectern.llm.landing import columns_of, whole_row

SLOTS = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(96))


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(shard: str, slots: int) -> tuple[int, int]:
    """Offset and stride of the order in which a shard wants the slots; a prime table is visited as a whole."""
    digest = hashlib.md5(shard.encode()).digest()
    return int.from_bytes(digest[:8]) % slots, int.from_bytes(digest[8:]) % (slots - 1) + 1


def fill_table(shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> list[int]:
    """Which shard each slot belongs to: the shards take turns, each claiming the next free slot of its order.

    Shares differ by one slot at most. If a shard comes or goes, most slots keep their shard.
    """
    if not shards or len(set(shards)) < len(shards) or not is_prime(slots) or len(shards) > slots:
        raise ValueError("needs different shards, and a prime number of slots that is no less")
    wanted = [list(preference(s, slots)) for s in shards]
    table = [-1] * slots
    for claimed in range(slots):
        shard = claimed % len(shards)
        slot, stride = wanted[shard]
        while table[slot] >= 0:
            slot = (slot + stride) % slots
        table[slot] = shard
        wanted[shard][0] = (slot + stride) % slots
    return table


def table_frame(spark: SparkSession, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``slot, shard``: as many rows as the table has slots, however many documents there are."""
    rows = [(slot, shards[i]) for slot, i in enumerate(fill_table(shards, slots))]
    return spark.createDataFrame(rows, "slot int, shard string")


def slot_of(doc_id: str = "doc_id", slots: int = SLOTS) -> Column:
    """A document's slot: 60 bits of its id's digest, modulo the table. A null id counts as empty text."""
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(slots)).cast("int")


def place(docs: DataFrame, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``doc_id, slot, shard`` of every row.

    The place depends on ``doc_id`` alone, so rows of one id lie together, texts and sources do not matter, and
    copies spread. Rows without an id all lie on one shard. Rows that repeat come out as often; an empty table
    gives none. The table is broadcast: its size is the number of slots.
    """
    placed = docs.select("doc_id", slot_of(slots=slots).alias("slot"))
    return placed.join(F.broadcast(table_frame(docs.sparkSession, shards, slots)), "slot").select("doc_id", "slot", "shard")


def with_shard(docs: DataFrame, shards: Sequence[str] = SHARDS, slots: int = SLOTS, column: str = "shard") -> DataFrame:
    """All columns and the shard; a column of that name gives way. Other columns may have any names."""
    table = table_frame(docs.sparkSession, shards, slots)
    own = docs.select(whole_row(docs).alias("row"), slot_of(slots=slots).alias("slot"))
    joined = own.join(F.broadcast(table), "slot")
    return joined.select(*[c for c, name in zip(columns_of("row", docs), docs.columns) if name != column], F.col("shard").alias(column))


def write_sharded(docs: DataFrame, path: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS, pieces: int = 8) -> None:
    """A folder per shard, each in at most ``pieces`` files that go by slot, so that no shard is one task's work."""
    table = F.pmod(slot_of(slots=slots), F.lit(pieces))
    with_shard(docs, shards, slots).repartition("shard", table).write.mode("overwrite").partitionBy("shard").parquet(path)
