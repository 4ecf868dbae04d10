"""Sharding by a permutation-filled lookup table.

Each shard walks the slots of a prime-sized table in an order of its own; the
shards take turns, each claiming the next free slot of its order, until the
table is full. A key's slot is its hash modulo the prime. Shards end up with
equal shares of the slots, and when one shard leaves, few other slots move.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.llm.common import col, fresh

#: The lookup table is broadcast; its size is this prime, whatever the data.
SLOTS = 65_537
SHARDS = 64


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of the shard that claimed it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and differ")
    if not _is_prime(slots) or slots < len(shards):
        raise ValueError("the number of slots must be a prime not below that of shards")
    step, place = [], []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        place.append(int.from_bytes(digest[:8], "big") % slots)
        step.append(int.from_bytes(digest[8:16], "big") % (slots - 1) + 1)
    table, free = [-1] * slots, slots
    while free:
        for shard in range(len(shards)):
            while table[place[shard]] >= 0:
                place[shard] = (place[shard] + step[shard]) % slots
            table[place[shard]] = shard
            free -= 1
            if not free:
                break
    return table


def assign_shards(
    docs: DataFrame,
    key: str = "doc_id",
    shards: int | list[str] = SHARDS,
    slots: int = SLOTS,
    out: str = "shard",
) -> DataFrame:
    """All rows and columns of ``docs`` and the number of the row's shard.

    Placement depends on the key alone: equal keys, null ones among them, share
    a shard, also across runs and inputs. A column already called ``out`` stays
    and the new one gets a longer name. The slots go out as a broadcast table of
    ``slots`` rows; a join on the slot is one array access per row and no
    shuffle of the documents.
    """
    spark = docs.sparkSession
    names = [f"shard-{i}" for i in range(shards)] if isinstance(shards, int) else shards
    slot, shard = fresh(docs, "__slot"), fresh(docs, out)
    claimed = spark.createDataFrame(
        list(enumerate(lookup_table(names, slots))),
        T.StructType([T.StructField(slot, T.IntegerType(), False), T.StructField(shard, T.IntegerType(), False)]),
    )
    hashed = F.xxhash64(F.coalesce(col(key).cast("string"), F.lit("\x00null")))
    placed = docs.withColumn(slot, F.pmod(hashed, F.lit(slots)).cast("int"))
    return placed.join(F.broadcast(claimed), slot, "left").select(*[col(c) for c in docs.columns], shard)
