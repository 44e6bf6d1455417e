"""Sharding by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a table of prime size: it starts at one slot and
steps by a fixed distance. The shards take turns, each claiming the next free slot it prefers, until the
table is full; so every shard has as many slots as any other, give or take one, and losing a shard moves
few keys besides its own. The table goes to the executors once, as its size is a parameter; placing a row is a
hash, a remainder and one look-up, with no exchange: a hot source or group spreads by the rows' own keys.

Nulls: a null key is placed like the text of an empty key, always in the same shard. Repeated rows go to
the same shard, and rows of one key always meet. Other columns stay as they are, whatever they are called; the two new ones take the
names asked for, and replace columns that have them in any case of letters. An empty table has an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Slots of the table (a prime) and shards. With a hundred slots a shard or more, shares differ by under a hundredth.
SLOTS, SHARDS = 65_537, 512


def _number(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:7], "big")


def lookup_table(names: list[str], slots: int = SLOTS) -> np.ndarray:
    """The index into names for each slot. slots is a prime larger than the number of names."""
    if slots < 2 or any(slots % i == 0 for i in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"{slots} is not a prime")
    if not 0 < len(names) < slots or len(set(names)) != len(names):
        raise ValueError("names must be distinct, at least one, and fewer than the slots")
    at = [_number(f"start {x}") % slots for x in names]
    step = [_number(f"step {x}") % (slots - 1) + 1 for x in names]
    table = np.full(slots, -1, np.int32)
    filled = 0
    while filled < slots:
        for i in range(len(names)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            table[at[i]] = i
            filled += 1
            if filled == slots:
                break
    return table


def slot_of(key, slots: int = SLOTS):
    """The slot of a key column: the first 60 bits of the MD5 of its text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def lookup_frame(spark: SparkSession, names: list[str], slots: int, slot_column: str, shard_column: str) -> DataFrame:
    """The table as rows (slot, shard): as many as slots, whatever the data."""
    table = lookup_table(names, slots).tolist()
    return spark.createDataFrame([(i, names[x]) for i, x in enumerate(table)], T.StructType([T.StructField(slot_column, T.IntegerType()), T.StructField(shard_column, T.StringType())]))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def place(df: DataFrame, key: str, names: list[str], slots: int = SLOTS, slot_column: str = "slot", shard_column: str = "shard") -> DataFrame:
    """df with the slot and the shard (one of names) of each row's key."""
    # the row travels as one struct, so that no name of its columns can clash with those of the table
    keyed = df.select(F.struct(*(F.col(quoted(c)) for c in df.columns)).alias("whole"), slot_of(F.col(quoted(key)), slots).alias("at"))
    lookup = lookup_frame(df.sparkSession, names, slots, "at", "name")
    taken = {slot_column.lower(), shard_column.lower()}
    rest = [F.col("whole." + quoted(c)).alias(c) for c in df.columns if c.lower() not in taken]
    return keyed.join(F.broadcast(lookup), "at").select(*rest, F.col("at").alias(slot_column), F.col("name").alias(shard_column))


def place_sql(names: list[str], slots: int = SLOTS, table: str = "documents", key: str = "doc_id") -> str:
    """The same for a key column alone, in DuckDB's SQL. The lookup table is a list in it; tests fill one by the plain rule."""
    shards = ", ".join(f"'{x}'" for x in names)
    return f"""
WITH lookup AS (SELECT [{", ".join(map(str, lookup_table(names, slots).tolist()))}] AS claimed, [{shards}] AS names),
keyed AS (SELECT {key}, (('0x' || substr(md5(coalesce({key}::VARCHAR, '')), 1, 15))::BIGINT % {slots})::INTEGER AS slot FROM {table})
SELECT {key}, slot, names[claimed[slot + 1] + 1] AS shard FROM keyed, lookup"""
