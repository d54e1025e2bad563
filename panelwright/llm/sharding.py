"""Shard placement by a permutation-filled lookup table."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of the table: a prime, about a hundred for each of 64 shards, so that shares differ by 1 % at most.
TABLE_SIZE = 6571
MAX_TABLE_SIZE = 1 << 20


def _number(name: str, salt: str) -> int:
    return int(md5(f"{salt}:{name}".encode()).hexdigest()[:8], 16)


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """Shard number of every slot.

    Every shard prefers the slots in an order of its own, (offset + j * skip) mod ``size``, which meets each slot once as
    ``size`` is prime. Shards take turns; in its turn a shard claims the first slot of its order that is still free. So
    shares differ by one slot at most, and few slots change their shard when a shard comes or goes. The table depends on
    the shards' names and not on where it is filled.
    """
    if not 0 < len(shards) <= size <= MAX_TABLE_SIZE or len(set(shards)) < len(shards):
        raise ValueError(f"need 1 to {size} different shard names and a table of {MAX_TABLE_SIZE} slots at most")
    if size < 2 or any(size % d == 0 for d in range(2, int(size ** 0.5) + 1)):
        raise ValueError(f"the table size {size} is not prime")
    place = [_number(s, "offset") % size for s in shards]
    skip = [_number(s, "skip") % (size - 1) + 1 for s in shards]
    table = [-1] * size
    for turn in range(size):
        i = turn % len(shards)
        while table[place[i]] >= 0:
            place[i] = (place[i] + skip[i]) % size
        table[place[i]] = i
    return table


def slot_of(keys: Sequence[str], size: int) -> Column:
    return F.pmod(F.hash(*keys), F.lit(size))


def place(df: DataFrame, keys: Sequence[str], shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with the columns slot and shard (the shard's name), which replace columns of these names.

    The table (``size`` rows, a checked parameter) is broadcast, so no row of ``df`` moves and each is placed in constant
    time, whatever share of the rows one key holds. Equal keys, repeated rows included, get the same shard; a NULL key
    hashes to a fixed slot. An empty table stays empty.
    """
    table = lookup_table(shards, size)
    numbers = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")
    names = F.array(*[F.lit(s) for s in shards])
    slots = df.sparkSession.range(size).select(F.col("id").cast("int").alias("_slot"), names[numbers[F.col("id").cast("int")]].alias("_shard"))
    placed = df.withColumn("slot", slot_of(keys, size)).join(F.broadcast(slots), F.col("slot") == F.col("_slot"))
    return placed.withColumn("shard", F.col("_shard")).drop("_slot", "_shard")


def write_shards(df: DataFrame, path: str) -> None:
    """One folder per shard; a shard is written by as many tasks as hold its rows."""
    df.write.partitionBy("shard").mode("overwrite").parquet(path)
