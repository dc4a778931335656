"""Permutation-filled lookup table: shards claim slots of a prime-sized table in turn; a document's key names its slot."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import all_of, without

#: Largest table that is broadcast: 24 bytes a row, so 25 MB at most.
MAX_TABLE = 1_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(key: str) -> int:
    return int(hashlib.md5(key.encode()).hexdigest()[:15], 16)


def claimed_slots(shards: list[str], size: int, seed: str = "") -> list[int]:
    """For each slot the index of the shard that owns it.

    A shard prefers ``offset, offset + skip, offset + 2 skip, ...`` modulo the prime ``size``, a permutation of the slots. In
    turn, each shard takes the first slot of its preference that is still free, until none is left; so shards differ by one slot at
    most, and taking a shard away moves few other slots. Work and memory depend on ``size`` alone, never on the documents.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct, and there must be one at least")
    if not _is_prime(size) or size < len(shards) or size > MAX_TABLE:
        raise ValueError(f"the table's size must be a prime from the number of shards to {MAX_TABLE}")
    offset = [_number(f"{seed}:offset:{s}") % size for s in shards]
    skip = [_number(f"{seed}:skip:{s}") % max(1, size - 1) + 1 for s in shards]
    owner, taken, step = [-1] * size, 0, [0] * len(shards)
    while True:
        for i in range(len(shards)):
            slot = (offset[i] + step[i] * skip[i]) % size
            while owner[slot] >= 0:
                step[i] += 1
                slot = (offset[i] + step[i] * skip[i]) % size
            owner[slot] = i
            step[i] += 1
            taken += 1
            if taken == size:
                return owner


def slot_table(spark: SparkSession, shards: list[str], size: int, seed: str = "") -> DataFrame:
    """``slot`` and ``shard`` of every slot, one row for each."""
    named = ",".join(map(str, claimed_slots(shards, size, seed)))
    names = F.array(*[F.lit(s) for s in shards])
    return (
        spark.range(1)
        .select(F.posexplode(F.split(F.lit(named), ",")).alias("slot", "owner"))
        .select(F.col("slot").cast("long").alias("slot"), F.element_at(names, F.col("owner").cast("int") + 1).alias("shard"))
    )


def slot_of(key: Column, size: int, seed: str = "") -> Column:
    """The slot of a key: 60 bits of its MD5, modulo the table's size. A null key counts as the empty string."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size).cast("long"))


def assign_shards(docs: DataFrame, shards: list[str], size: int = 65_537, key: str = "doc_id", seed: str = "") -> DataFrame:
    """``docs`` with ``slot`` (long) and ``shard`` (string) by ``key``; input columns of these names are replaced.

    Every row gets one shard: equal keys the same, null keys that of the empty string; other columns and repeated rows pass
    through. The table is broadcast, at most ``MAX_TABLE`` rows; no row of ``docs`` is shuffled, so a hot key costs nothing.
    """
    docs = without(docs, ["slot", "shard"])
    table = F.broadcast(slot_table(docs.sparkSession, shards, size, seed))
    return docs.withColumn("slot", slot_of(F.col(key), size, seed)).join(table, "slot", "left").select(*all_of(docs), "slot", "shard")
