"""Shard placement by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table, given by an offset and a skip
hashed from its name. Shards take turns, each claiming its next preferred free slot, until no slot is
free. A key's slot is its hash modulo the table size; the table is broadcast, so that placing a row is one
look-up. Adding or removing a shard moves few other keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import no_reserved

#: Slots of the production table; bounds what is broadcast to about 1 MB whatever the input's size.
TABLE_SIZE = 65_537
#: Largest table that may be broadcast.
MAX_TABLE_SIZE = 5_000_011


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _draw(name: str, seed: str, below: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{name}".encode(), digest_size=8).digest(), "big") % below


def fill_table(shards: Sequence[str] | Mapping[str, int], size: int = TABLE_SIZE) -> list[int]:
    """The shard number that owns each slot. ``shards``: names, or names with the slots each claims a turn.

    Raises ValueError for no shards, a repeated name, a weight below 1, a size that isn't prime, is
    smaller than the number of shards or is over MAX_TABLE_SIZE.
    """
    names = list(shards)
    weights = [int(shards[n]) for n in names] if isinstance(shards, Mapping) else [1] * len(names)
    if not names or len(set(names)) < len(names) or min(weights) < 1:
        raise ValueError("shards must be distinct names with weights of 1 or more")
    if not _is_prime(size) or size < len(names) or size > MAX_TABLE_SIZE:
        raise ValueError(f"size must be a prime from the number of shards to {MAX_TABLE_SIZE}")
    at = [_draw(n, "offset", size) for n in names]
    skip = [_draw(n, "skip", size - 1) + 1 for n in names]
    owner, free = [-1] * size, size
    while free:
        for shard, turns in enumerate(weights):
            for _ in range(min(turns, free)):
                while owner[at[shard]] >= 0:
                    at[shard] = (at[shard] + skip[shard]) % size
                owner[at[shard]] = shard
                free -= 1
    return owner


def slot_of(keys: Sequence[Column], size: int) -> Column:
    """A key's slot; a null key has a slot like any other value."""
    return F.pmod(F.xxhash64(*keys), F.lit(size)).cast("int")


def place(df: DataFrame, keys: Sequence[str], shards: Sequence[str] | Mapping[str, int], size: int = TABLE_SIZE, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """``df`` with the slot and the shard number of each row, by the columns ``keys``.

    Every row stays, repeated rows too: rows with equal keys go to one shard. Null keys are placed like
    any value, so all rows with null keys share a shard. An empty table stays empty. Columns of ``df``
    named like the two new ones are replaced; all other columns are kept. Raises ValueError if a column's name
    begins with ``__lf_``.
    """
    no_reserved(df)
    owner = fill_table(shards, size)
    table = df.sparkSession.createDataFrame(pd.DataFrame({"__lf_slot": range(size), "__lf_shard": owner}), "__lf_slot int, __lf_shard int")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (slot_col, shard_col)]
    placed = df.withColumn("__lf_slot", slot_of([F.col(f"`{k}`") for k in keys], size))
    return placed.join(F.broadcast(table), "__lf_slot").select(*kept, F.col("__lf_slot").alias(slot_col), F.col("__lf_shard").alias(shard_col))
