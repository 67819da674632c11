"""Shards by jump consistent hashing.

The jump hash walks the bucket counts at which a key changes its bucket; a key's shard is the last jump
below the shard count. It needs no ring table, and going from n to n + 1 shards moves only the keys whose
next jump is shard n.

Defined results: a null key hashes as key 0; a null text has size 1 and the checksum of an empty text;
repeated rows get one slot each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked

# Fixed values of the published jump consistent hash.
MULTIPLIER = 2862933555777941757
WORD = 1 << 64


def _number(n: int) -> Column:
    return F.lit(Decimal(n))


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a long key among ``shards``. Jumps strictly grow, so ``shards`` steps always suffice.

    The generator multiplies modulo 2**64; exact decimals do that under ANSI arithmetic.
    """
    key = F.coalesce(key, F.lit(0)).cast("decimal(20,0)")
    start = F.struct(
        F.when(key < 0, key + _number(WORD)).otherwise(key).cast("decimal(20,0)").alias("state"),
        F.lit(-1).cast("long").alias("shard"),
        F.lit(0).cast("long").alias("jump"),
    )

    def step(acc: Column, _: Column) -> Column:
        state = ((acc["state"] * _number(MULTIPLIER) + _number(1)) % _number(WORD)).cast("decimal(20,0)")
        high = ((state - state % _number(1 << 33)) / _number(1 << 33)).cast("double")
        jump = F.floor((acc["jump"] + 1).cast("double") * (F.lit(float(1 << 31)) / (high + 1.0)))
        moved = F.struct(state.alias("state"), acc["jump"].alias("shard"), jump.cast("long").alias("jump"))
        return F.when(acc["jump"] < shards, moved).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda acc: acc["shard"].cast("int"))


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, size, text_crc32, law, shard, slot, grown_shard.

    ``slot`` numbers a shard's documents by key. Only keys, sizes and checksums are shuffled.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shard(F.col(key), shards).alias("shard"),
        jump_shard(F.col(key), shards + 1).alias("grown_shard"),
    )
    slots = ranked(rows, ["shard"], ["doc_id", "size", "text_crc32"])
    return slots.select("doc_id", "size", "text_crc32", "law", "shard", F.col("rank").cast("long").alias("slot"), "grown_shard")
