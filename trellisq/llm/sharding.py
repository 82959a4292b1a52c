"""Sharding by a permutation-filled lookup table.

Each shard walks the slots of a prime-sized table in an order of its own, (offset + skip * i) mod size; in turns the
shards claim the next free slot of their order until the table is full. So shards own nearly equal numbers of slots,
and adding or removing a shard moves few others. A document goes to the shard that owns the slot of its key's hash:
one look-up in a table of fixed size, which is broadcast.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots, a prime of at least 100 times the shards; the broadcast table never has more rows than this.
SLOTS, SHARDS = 65537, 64


def _number(*key) -> int:
    return int.from_bytes(hashlib.md5("/".join(map(str, key)).encode()).digest()[:8], "big")


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of the shard that owns it."""
    if not shards or slots < len(shards) or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("there must be shards, and a prime number of slots not below theirs")
    order = [(_number(s, "offset") % slots, _number(s, "skip") % (slots - 1) + 1) for s in shards]
    table, at, left = [-1] * slots, [0] * len(shards), slots
    while True:
        for k, (offset, skip) in enumerate(order):
            slot = (offset + skip * at[k]) % slots
            while table[slot] >= 0:
                at[k] += 1
                slot = (offset + skip * at[k]) % slots
            table[slot] = k
            at[k] += 1
            left -= 1
            if not left:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key's text; a null key has the slot of the empty text."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long") % slots).cast("int")


def lookup(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    return spark.createDataFrame([(i, k) for i, k in enumerate(fill(shards, slots))], "slot int, shard int")


def assign(docs: DataFrame, key: str = "doc_id", n_shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """docs with slot and shard (both int). No shuffle: the look-up table, of ``slots`` rows, is broadcast.

    Columns of docs named slot or shard are replaced. Rows with the same key share a shard; a null key has one too.
    """
    table = lookup(docs.sparkSession, [f"shard-{i}" for i in range(n_shards)], slots)
    return docs.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots)).join(F.broadcast(table), "slot")


def write(docs: DataFrame, path: str, key: str = "doc_id", n_shards: int = SHARDS, slots: int = SLOTS, rows_per_file: int = 1_000_000) -> None:
    """Writes one folder for each shard. A shard's rows are split over its files by a hash of the row, so that a hot key isn't one task and a task that runs again writes the same."""
    placed = assign(docs, key, n_shards, slots)
    heavy = placed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("__files"))
    salted = placed.join(F.broadcast(heavy), "shard").withColumn("__file", F.pmod(F.xxhash64(*[f"`{c}`" for c in placed.columns]), F.col("__files")))
    salted.repartition("shard", "__file").drop("__files", "__file").write.partitionBy("shard").mode("overwrite").parquet(path)
