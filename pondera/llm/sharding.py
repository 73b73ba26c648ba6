"""Sharding by a permutation-filled lookup table.

The table has a prime number of slots.  Each shard has its own order of
preference over all slots, ``offset + j * skip`` modulo the size; shards take
turns, each claiming the first slot of its order that is free, until the table
is full.  All shards get equally many slots (one more or less), and when a
shard goes, few slots of the others change hands.  A key's slot is a hash
modulo the table size, and the broadcast table gives its shard in constant time.

The table is control data: its size is a parameter, at most ``MAX_SLOTS``,
whatever the number of documents.  Placement itself is a broadcast hash join.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_SLOTS = 1 << 20


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], slots: int) -> list[int]:
    """The claimed table: for each slot, the index of its shard."""
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shards must be distinct and not empty")
    if not is_prime(slots) or not len(shards) <= slots <= MAX_SLOTS:
        raise ValueError(f"slots must be a prime from {len(shards)} to {MAX_SLOTS}")
    at, skip = [], []
    for s in shards:
        d = hashlib.md5(s.encode()).hexdigest()
        at.append(int(d[:8], 16) % slots)
        skip.append(int(d[8:16], 16) % (slots - 1) + 1 if slots > 2 else 1)
    table = [-1] * slots
    for turn in range(slots):
        i = turn % len(shards)
        while table[at[i]] >= 0:
            at[i] = (at[i] + skip[i]) % slots
        table[at[i]] = i
    return table


def lookup(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    """The table as rows ``(slot, shard)``, one literal unpacked by the engine."""
    table = ",".join(map(str, fill_table(shards, slots)))
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(table), ",")).alias("slot", "i"))
    return rows.select("slot", F.col("i").cast("int").alias("shard"))


def slot_of(key: Column, slots: int) -> Column:
    """Slot of a key: 52 bits of its MD5 modulo the table size."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(docs: DataFrame, *, shards: int | list[str] = 64, slots: int = 65537, key: str = "doc_id") -> DataFrame:
    """Add ``slot`` and ``shard`` to every row.

    The key is the id's text; rows with a null id are placed by their text, so
    that they spread too.  Equal keys, and so repeated rows, go to one shard.
    Columns named ``slot`` or ``shard`` are replaced, all others are kept.  An empty
    table gives an empty one; texts are never moved, whatever their length.
    """
    names = shards if isinstance(shards, list) else [f"shard-{i}" for i in range(shards)]
    by = F.coalesce(F.col(f"`{key.replace('`', '``')}`").cast("string"), *([F.col("text")] if "text" in docs.columns else []), F.lit(""))
    docs = docs.drop("slot", "shard").withColumn("slot", slot_of(by, slots))
    return docs.join(F.broadcast(lookup(docs.sparkSession, names, slots)), "slot")
