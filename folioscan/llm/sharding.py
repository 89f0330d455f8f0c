"""Sharding by a permutation-filled lookup table, DataFrame operations only.

Each shard has its own preference order over the slots of a table of prime size: slot
(offset + k * skip) mod size, k = 0, 1, 2 ..., where offset and skip come from the md5 of the shard's
name. Shards take turns, each claiming the first free slot of its order, until every slot is taken; so
slots are shared out evenly, and adding or removing a shard moves few slots. A row's slot is its key's
md5 mod size, and its shard is one look-up in the table. The table has `slots` rows whatever the
data's size, so broadcasting it is bounded by a parameter.

Defined cases: rows without a key are placed by the md5 of their text, so that they do not share one
shard; without both, they go by the md5 of the empty string. Repeated rows go to one shard. An empty
table gives no rows. Columns named slot or shard in the input are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Shards:
    """count: number of shards. slots: size of the table, a prime well above count (bounds the broadcast)."""

    count: int = 64
    slots: int = 16381
    prefix: str = "shard-"

    def __post_init__(self) -> None:
        if self.count < 1 or self.slots < self.count or any(self.slots % d == 0 for d in range(2, int(self.slots**0.5) + 1)):
            raise ValueError("slots must be a prime of at least the number of shards")


def lookup_table(shards: Shards) -> list[int]:
    """The shard that owns each slot."""
    size = shards.slots
    at, skip = [], []
    for s in range(shards.count):
        digest = hashlib.md5(f"{shards.prefix}{s}".encode()).hexdigest()
        at.append(int(digest[:15], 16) % size)
        skip.append(int(digest[15:30], 16) % (size - 1) + 1)
    owner = [-1] * size
    taken = 0
    while True:
        for s in range(shards.count):
            while owner[at[s]] >= 0:
                at[s] = (at[s] + skip[s]) % size
            owner[at[s]] = s
            taken += 1
            if taken == size:
                return owner


def slot_of(key: Column, size: int) -> Column:
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long") % size).cast("int")


def place(df: DataFrame, key: str, shards: Shards = Shards(), text: str | None = None) -> DataFrame:
    """df's rows with slot and shard (int) appended; columns of these names are replaced."""
    spark = df.sparkSession
    owners = F.split(F.lit(",".join(map(str, lookup_table(shards)))), ",")
    lookup = spark.range(1).select(F.posexplode(owners).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))
    name = F.coalesce(F.col(key).cast("string"), F.md5(F.col(text).cast("binary")) if text else F.lit(None), F.lit(""))
    placed = df.drop("slot", "shard").withColumn("slot", slot_of(name, shards.slots))
    return placed.join(F.broadcast(lookup), "slot").select(*placed.columns, "shard")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return place(docs, "doc_id", text="text").select("doc_id", "slot", "shard")


def oracle() -> str:
    shards = Shards()
    owners = ",".join(map(str, lookup_table(shards)))
    key = "coalesce(doc_id::VARCHAR, md5(text), '')"
    return f"""
        WITH o AS (SELECT string_split('{owners}', ',') AS owners),
             d AS (SELECT doc_id, (('0x' || substr(md5({key}), 1, 15))::BIGINT % {shards.slots})::INT AS slot FROM documents)
        SELECT doc_id, slot, owners[slot + 1]::INT AS shard FROM d, o"""
