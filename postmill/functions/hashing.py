"""Hashes and partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shard(key: Column, shards: int) -> Column:
    """sha256 of the key as a whole number, mod shards: one fold over its hex digits."""
    digits = F.sha2(key.cast("string"), 256)
    digit = lambda i: F.instr(F.lit("0123456789abcdef"), F.substring(digits, i, F.lit(1))) - 1
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.lit(0).cast("bigint"), lambda a, i: (a * 16 + digit(i)) % shards)


def token_hash(token: Column) -> Column:
    return F.sha2(token, 256)


def cv_key(text: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16)


def strided(csv: Column, index: int, shards: int) -> Column:
    """Every shards-th entry of a comma-separated list from index on; the whole list where that is none."""
    entries = F.filter(F.transform(F.split(F.coalesce(csv, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    own = F.filter(entries, lambda x, p: p % shards == index)
    return F.when(F.size(own) > 0, own).otherwise(entries)


def key_list(csv: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(csv, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))
