"""The runs' stateful steps as streams: seen postings, time-to-live caches, exact call peaks, and ticks by micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from postmill.operators.tables import KeyedTable
from postmill.values import LOOKBACK_DAYS


def unseen(postings: DataFrame, days: int = LOOKBACK_DAYS["seen"], at: str = "ts", keys=("user_id", "job_url")) -> DataFrame:
    """Each key once within the lookback; the state of older keys goes as the watermark passes."""
    return postings.withWatermark(at, f"{days} days").dropDuplicatesWithinWatermark(list(keys))


def calls_per_window(calls: DataFrame, keys: list[str], at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Calls of each key in windows of 60 seconds that start each second: their largest is the peak."""
    return calls.withWatermark(at, late).groupBy(F.window(at, "60 seconds", "1 second").alias("w"), *keys).agg(F.count(F.lit(1)).alias("calls"))


def peaks(calls: DataFrame, key: str, at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """key, peak: the most calls of a key in any 60 seconds, exact, with an update for each micro-batch that the key is in.

    State is the peak and the calls per second that may still meet others: calls come late by up to late, and those count in the
    windows of their own second. Later ones are left out. A key's state goes when the watermark is a minute past its last
    call; its next update starts anew, so who keeps the updates keeps the largest (KeyedTable with tops does).
    """

    def step(own: tuple, batches: Iterator, state: GroupState):
        import numpy as np
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        seconds, counts, peak = state.get if state.exists else ([], [], 0)
        held = dict(zip(seconds, counts, strict=True))
        for batch in batches:
            for t, n in zip(*np.unique(batch["seconds"].to_numpy(), return_counts=True), strict=True):
                held[int(t)] = held.get(int(t), 0) + int(n)
        times = np.array(sorted(held), np.int64)
        sums = np.concatenate([[0], np.cumsum([held[int(t)] for t in times])])
        peak = max(peak, int((sums[1:] - sums[np.searchsorted(times, times - 60)]).max()))
        passed = state.getCurrentWatermarkMs() // 1000
        kept = [int(t) for t in times if t >= passed - 60]
        end = (int(times[-1]) + 61) * 1000
        if kept and end > state.getCurrentWatermarkMs():
            state.update((kept, [held[t] for t in kept], peak))
            state.setTimeoutTimestamp(end)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({key: [own[0]], "peak": [peak]})

    marked = calls.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    seconds = marked.select(F.col(key).cast("string").alias(key), at, F.unix_timestamp(F.col(at)).alias("seconds"))
    return seconds.groupBy(key).applyInPandasWithState(step, f"{key} string, peak bigint", "seconds array<bigint>, counts array<bigint>, peak bigint", "update", GroupStateTimeout.EventTimeTimeout)


def cache_misses(requests: DataFrame, key: str, at: str = "ts", ttl_seconds: int = 18 * 3600) -> DataFrame:
    """key, ts of requests that a cache with this time to live does not answer; each of them renews its entry. A key's state goes
    when the watermark has passed its entry's end: a later request would be a miss anyway."""

    def step(own: tuple, batches: Iterator, state: GroupState):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        held = state.get[0] if state.exists else None
        missed = []
        for t in sorted(x for batch in batches for x in batch["seconds"].tolist()):
            if held is None or t - held > ttl_seconds:
                missed.append(t)
                held = t
        state.update((held,))
        end = (held + ttl_seconds + 1) * 1000
        if end > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(end)
        else:
            state.remove()
        yield pd.DataFrame({key: [own[0]] * len(missed), "seconds": missed})

    marked = requests.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, f"{ttl_seconds} seconds")
    seconds = marked.select(F.col(key).cast("string").alias(key), at, F.unix_timestamp(F.col(at)).alias("seconds"))
    return seconds.groupBy(key).applyInPandasWithState(step, f"{key} string, seconds bigint", "held bigint", "append", GroupStateTimeout.EventTimeTimeout)


def written(stream: DataFrame, place: str, mode: str = "append") -> str:
    """Runs a stream over all that has arrived, each micro-batch to a folder of its own below place (a batch that is run
    again overwrites its own), and gives the path of the results. place: a folder that driver and executors share."""
    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/rows/batch={n}")

    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return f"{place}/rows"


def ticks(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs each micro-batch of what has arrived as one batch job; a batch that fails is run again from the checkpoint."""
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def seen_table(spark: SparkSession, path: str) -> KeyedTable:
    """user_id, job_url and when it was evaluated first."""
    return KeyedTable(spark, path, "user_id string, job_url string, evaluated_at timestamp", ["user_id", "job_url"], "first", "evaluated_at")


def mark_evaluated(batch: DataFrame, number: int, table: KeyedTable) -> None:
    """Only evaluated rows enter the seen table, so the others come again. A batch that is run again changes nothing."""
    table.write(batch.where("evaluated").select("user_id", "job_url", F.col("ts").alias("evaluated_at")), number)


def rolling_history(batch: DataFrame, number: int, table: KeyedTable, place: str, every: int = 20, keep: Column | None = None) -> None:
    """Upserts a micro-batch into a history, and writes its rows with known, whether the history had their key before, to a folder of
    the batch's number below place. The table is compacted, and what keep does not hold for goes, each so many batches."""
    past = table.read(before=number).select(*table.keys, F.lit(True).alias("known"))
    told = batch.join(past, table.keys, "left").withColumn("known", F.coalesce("known", F.lit(False)))
    # a batch that the base has was written whole before, and its rows told
    if number > table.upto():
        told.write.mode("overwrite").parquet(f"{place}/batch={number}")
        table.write(batch, number)
        if number % every == every - 1:
            table.compact(keep)
