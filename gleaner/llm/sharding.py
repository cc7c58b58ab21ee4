"""Sharding through a lookup table that shards fill in turn by their permutations of its slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import null_to_empty

#: Slots of the table: a prime, over 100 for each shard, so shares differ by under one percent.
SLOTS, SHARDS = 2039, 16


def digest(text: Column) -> Column:
    """60 bits of MD5 as a long: the same in any SQL dialect that has MD5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot int, shard string), one row for each slot.

    A shard prefers the slots offset, offset + skip, offset + 2 skip, ... modulo the prime number of slots, which
    visits each once. Shards take turns in the given order, each claiming the first slot in its order that is
    still free, until none is. The table's size is a parameter, not a matter of the data; adding or removing a
    shard moves few slots of the others. offset and skip are computed by the same SQL functions as the keys.
    """
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"{slots} is not a prime")
    if not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError("shards must have distinct names, at most one for each slot")
    names = spark.createDataFrame([(i, s) for i, s in enumerate(shards)], "i int, name string")
    drawn = names.select("i", F.pmod(digest(F.concat(F.col("name"), F.lit(":offset"))), slots).alias("offset"), (F.pmod(digest(F.concat(F.col("name"), F.lit(":skip"))), slots - 1) + 1).alias("skip"))
    prefer = [(r.offset, r.skip) for r in drawn.orderBy("i").collect()]  # one row for each shard
    owner, tried, left, turn = [-1] * slots, [0] * len(shards), slots, 0
    while left:
        who = turn % len(shards)
        offset, skip = prefer[who]
        while owner[at := (offset + tried[who] * skip) % slots] >= 0:
            tried[who] += 1
        owner[at] = who
        left, turn = left - 1, turn + 1
    return spark.createDataFrame([(i, shards[w]) for i, w in enumerate(owner)], "slot int, shard string")


def place(rows: DataFrame, key_col: str, table: DataFrame, slots: int = SLOTS) -> DataFrame:
    """All columns with slot (int) and shard (string) added, replacing columns of these names.

    The slot is a hash of the key as text, modulo the table's size: equal keys share a shard, and null counts as
    the empty text. The table has `slots` rows whatever the data, so it is broadcast and rows don't move.
    """
    slotted = rows.drop("slot", "shard").withColumn("slot", F.pmod(digest(null_to_empty(F.col(key_col).cast("string"))), slots).cast("int"))
    return slotted.join(F.broadcast(table), "slot").select(*(c for c in slotted.columns if c != "slot"), "slot", "shard")


def write_shards(placed: DataFrame, path: str, parts: int = 8) -> None:
    """A folder of Parquet files for each shard; each shard is dealt to `parts` tasks by its rows' hashes, so none meets in one.

    Null values are kept, and null keys have a shard as any other; repeated rows are written as often as they come.
    """
    spread = placed.withColumn("__part", F.pmod(F.xxhash64(*placed.columns), parts))
    spread.repartition("shard", "__part").drop("__part").write.partitionBy("shard").parquet(path)
