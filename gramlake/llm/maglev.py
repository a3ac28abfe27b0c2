"""Sharding by a permutation-filled lookup table (consistent hashing with constant-time placement)."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the table, a prime far above the number of shards: the largest shard has about a hundredth more slots than the least.
SLOTS = 65_537


def table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """The shard (position in shards) of each slot.

    Each shard prefers the slots in the order (offset + k * skip) mod slots, with offset and skip hashed from its name; in
    turn, each claims the first it prefers that is free. A shard that goes or comes moves few other slots.
    """
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards need distinct names, at least one and at most as many as slots")
    digests = [hashlib.md5(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "big") % slots for d in digests]
    skip = [int.from_bytes(d[8:], "big") % (slots - 1) + 1 for d in digests]
    owner = np.full(slots, -1, np.int32)
    free = slots
    while free:
        for s in range(len(shards)):
            while owner[at[s]] >= 0:
                at[s] = (at[s] + skip[s]) % slots
            owner[at[s]] = s
            free -= 1
            if not free:
                break
    return owner


def slot(*keys: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: 60 bits of the MD5 of its parts joined by ':', modulo the slots."""
    text = F.concat_ws(":", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % slots).cast("int")


def lookup(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(shard_slot, shard): slots rows of two integers, whatever the data: the bound that lets it be broadcast."""
    owner = table(shards, slots)
    return spark.createDataFrame([(k, int(s)) for k, s in enumerate(owner)], "shard_slot int, shard int")


def sharded(docs: DataFrame, shards: list[str], key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """docs with shard_slot (int) and shard (int, position in shards) appended; columns of those names are replaced.

    Placement is a hash and one probe of the broadcast table; no row moves. Equal keys share a shard, so a key with a
    third of all rows makes its shard so large; `write_shards` splits it over files. Rows with a null key
    have no identity to keep together and are placed by the MD5 of their text, so that they do not gather in one shard.
    Empty and very long texts need nothing else; an empty table gives an empty result.
    """
    plain = docs.drop("shard_slot", "shard")
    by = F.when(F.col(key).isNotNull(), F.col(key).cast("string")).otherwise(F.md5(F.coalesce("text", F.lit(""))))
    return plain.withColumn("shard_slot", slot(by, slots=slots)).join(F.broadcast(lookup(docs.sparkSession, shards, slots)), "shard_slot")


def write_shards(docs: DataFrame, shards: list[str], path: str, files: int = 1, **kw) -> None:
    """Parquet under path, one folder a shard, each of `files` files: every (shard, file) is a task of its own.

    Rows of a shard are dealt to its files by a hash of their doc_id and text, rows that repeat in both by chance of their
    place, so that neither a repeated key nor a repeated row fills one file. An empty table gives a folder without shards.
    """
    placed = sharded(docs, shards, **kw)
    spread = F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(files)).cast("int")
    placed.repartitionById(len(shards) * files, F.col("shard") * files + spread).write.partitionBy("shard").parquet(path)
