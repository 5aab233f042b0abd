"""Keyed tables of files: batches that may come twice, compaction, and claims that only one of several runs gets.

All lie in a folder that driver and executors share. Nothing but folder names is looked at on the driver.
"""

from __future__ import annotations

import random
import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def files_of(spark: SparkSession, path: str):
    """The file system that has the path, and the path in it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


class KeyedTable:
    """One row per key, written in numbered batches.

    Each batch is merged by key, dealt into buckets by the keys' hash and written to a folder of its own number; one that is
    run again overwrites that folder, so it changes nothing, whether it had failed halfway or not. Readers take the newest
    base and the whole batches after it (those with a success mark) and merge them by rule. compact() writes a new base and removes
    what it holds; a batch up to the base's number is passed over when it comes again. One run at a time writes and compacts; any
    number read, but a reader that has begun before a compaction must end before the next.

    rule: first (the row of the earliest batch stays), last (the greatest order, then the latest batch) or sum (sums are added
    up, tops are maxima). order breaks ties within a batch, too. Null keys are keys.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], rule: str = "last", order: str | None = None, sums=(), tops=(), buckets: int = 16):
        if rule not in ("first", "last", "sum"):
            raise ValueError(f"unknown rule {rule}")
        self.spark, self.path, self.schema, self.keys, self.rule = spark, path.rstrip("/"), schema, keys, rule
        self.order, self.sums, self.tops, self.buckets = order, list(sums), list(tops), buckets
        self.names = [f.name for f in spark.createDataFrame([], schema).schema.fields]

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the whole folders of a kind, ascending."""
        files, place = files_of(self.spark, f"{self.path}/{kind}")
        if not files.exists(place):
            return []
        whole = [x.getPath() for x in files.listStatus(place) if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName()) for p in whole)

    def upto(self) -> int:
        """The number of the newest base; -1 without one."""
        return max(self._numbers("bases"), default=-1)

    def _merged(self, rows: DataFrame) -> DataFrame:
        """One row per key of rows with _batch, folded in each task before rows are dealt by key."""
        if self.rule == "sum":
            return rows.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in self.sums], *[F.max(c).alias(c) for c in self.tops]).select(*self.names)
        row = F.struct(*self.names)
        order = [F.col(self.order)] if self.order else [F.lit(0)]
        best = F.min_by(row, F.struct("_batch", *order)) if self.rule == "first" else F.max_by(row, F.struct(*order, "_batch"))
        return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)]).agg(best.alias("_row")).select("_row.*")

    def _put(self, rows: DataFrame, place: str) -> None:
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).alias("bucket")
        rows.select(*self.names, bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(place)

    def write(self, batch: DataFrame, number: int) -> bool:
        """Writes a batch; False if the base has it already."""
        if number <= self.upto():
            return False
        self._put(self._merged(batch.select(*self.names).withColumn("_batch", F.lit(number))), f"{self.path}/batches/{number}")
        return True

    def _read(self, kind: str, number: int) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.path}/{kind}/{number}").drop("bucket").withColumn("_batch", F.lit(number))

    def read(self, before: int | None = None) -> DataFrame:
        """The table as it is, or as it was before a batch that the base does not have yet."""
        base = self.upto()
        parts = [self._read("bases", base)] if base >= 0 else []
        parts += [self._read("batches", n) for n in self._numbers("batches") if n > base and (before is None or n < before)]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return self._merged(rows)

    def compact(self, keep: Column | None = None) -> int:
        """Puts all whole batches into a new base, of rows for which keep holds, and removes what was before it."""
        numbers = self._numbers("batches")
        newest = max(numbers, default=-1)
        if newest <= self.upto():
            return self.upto()
        rows = self.read()
        self._put(rows if keep is None else rows.where(keep), f"{self.path}/bases/{newest}")
        for kind, gone in (("bases", lambda n: n < newest), ("batches", lambda n: n <= newest)):
            files, place = files_of(self.spark, f"{self.path}/{kind}")
            if files.exists(place):
                for x in files.listStatus(place):
                    if gone(int(x.getPath().getName())):
                        files.delete(x.getPath(), True)
        return newest


class Claims:
    """Shares of the users for runs that start at the same time: each share belongs to one run until it is released or too old.

    A user's share is the hash of the key. A claim is a file, named by share and turn, that is made only if it is not there
    yet; of runs that try at once one succeeds. Whoever finds a share's latest turn released, or older than ttl_seconds, tries the
    next turn, so an old claim is never taken from under a newer one. Files of past turns stay until purge().
    """

    def __init__(self, spark: SparkSession, path: str, shares: int = 64, ttl_seconds: int = 3600):
        self.spark, self.path, self.shares, self.ttl = spark, path.rstrip("/"), shares, ttl_seconds
        self.held: dict[int, int] = {}

    def _made(self, name: str) -> bool:
        """Makes the file, or tells that another has."""
        files, place = files_of(self.spark, f"{self.path}/{name}")
        jvm = self.spark._jvm
        try:
            if files.getUri().getScheme() == "file":
                # on a local or mounted file system only this call is atomic
                attributes = self.spark._sc._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0)
                jvm.java.nio.file.Files.createFile(jvm.java.io.File(place.toUri().getPath()).toPath(), attributes)
            else:
                files.create(place, False).close()
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        return True

    def _turns(self) -> dict[int, tuple[int, float, bool]]:
        """Of each share the latest turn, when it was claimed and whether it is released."""
        files, place = files_of(self.spark, self.path)
        files.mkdirs(place)
        found: dict[int, tuple[int, float, bool]] = {}
        released = set()
        for x in files.listStatus(place):
            name = x.getPath().getName()
            share, turn = map(int, name.removesuffix(".done").split("-"))
            if name.endswith(".done"):
                released.add((share, turn))
            elif share not in found or turn > found[share][0]:
                found[share] = (turn, x.getModificationTime() / 1000, False)
        return {s: (t, at, (s, t) in released) for s, (t, at, _) in found.items()}

    def take(self, most: int | None = None, now: float | None = None) -> list[int]:
        """Claims free shares, up to most of them, and gives those that this run got."""
        turns, got = self._turns(), []
        now = time.time() if now is None else now
        # runs that start at once begin at different shares
        for share in random.sample(range(self.shares), self.shares):
            turn, at, done = turns.get(share, (0, 0.0, True))
            if (most is None or len(got) < most) and (done or at + self.ttl < now) and self._made(f"{share}-{turn + 1}"):
                self.held[share] = turn + 1
                got.append(share)
        return sorted(got)

    def release(self, shares=None) -> None:
        """Gives shares back (all that this run holds, unless told): others may claim them from now on."""
        for share in list(self.held) if shares is None else shares:
            self._made(f"{share}-{self.held.pop(share)}.done")

    def purge(self, older_than: float) -> None:
        """Removes files of past turns that were made before that time."""
        turns = self._turns()
        files, place = files_of(self.spark, self.path)
        for x in files.listStatus(place):
            share, turn = map(int, x.getPath().getName().removesuffix(".done").split("-"))
            if turn < turns[share][0] and x.getModificationTime() / 1000 < older_than:
                files.delete(x.getPath(), False)

    def mine(self, users: DataFrame, key: str = "user_id") -> DataFrame:
        """The users whose shares this run holds."""
        return users.where(F.pmod(F.xxhash64(key), F.lit(self.shares)).isin(list(self.held)) if self.held else F.lit(False))
