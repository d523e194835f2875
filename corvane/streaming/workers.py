"""Worker registry: last heartbeat by worker, expiry, and choice of a worker; batch and stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.sampling import uniform


def registry(beats: DataFrame, worker: str, at: str, now: Column, ttl_seconds: int, fields: tuple[str, ...] = ()) -> DataFrame:
    """The workers alive at ``now``, with the fields of their last beat."""
    last = beats.where(F.col(at) <= now).groupBy(worker).agg(F.max(at).alias("last_beat"), *(F.max_by(f, at).alias(f) for f in fields))
    return last.where(F.unix_timestamp(F.col("last_beat").cast("timestamp")) >= F.unix_timestamp(now.cast("timestamp")) - ttl_seconds)


def stream_registry(beats: DataFrame, worker: str, at: str, ttl_seconds: int) -> DataFrame:
    """A stream of ``worker, last_beat, alive``: a row on each batch of beats, and one when a worker's event-time limit has passed.

    ``beats`` needs a watermark on ``at``.
    """
    types = dict(beats.dtypes)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({worker: [key[0]], "last_beat": [pd.Timestamp(last, unit="ms")], "alive": [False]})
            return
        last = state.get[0] if state.exists else 0
        for rows in batches:
            last = max(last, int(pd.to_datetime(rows[at]).max().value // 1_000_000))
        state.update((last,))
        state.setTimeoutTimestamp(max(last + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({worker: [key[0]], "last_beat": [pd.Timestamp(last, unit="ms")], "alive": [True]})

    return beats.groupBy(worker).applyInPandasWithState(run, f"`{worker}` {types[worker]}, last_beat timestamp, alive boolean", "last long", "append", "EventTimeTimeout")


def least_loaded(workers: DataFrame, worker: str, queue: str, speed: str) -> DataFrame:
    """The worker whose queue over speed is least; ties go to the least name."""
    return workers.agg(F.min_by(worker, F.struct(F.col(queue) / F.col(speed), worker)).alias(worker))


def lottery(workers: DataFrame, worker: str, speed: str, requests: DataFrame, request: str, seed: int) -> DataFrame:
    """A worker for each request, with chance in proportion to its speed; the worker table is small."""
    from pyspark.sql import Window

    along = Window.orderBy(worker).rowsBetween(Window.unboundedPreceding, 0)
    bounds = workers.select(worker, speed, F.sum(speed).over(along).alias("__high"), F.sum(speed).over(Window.partitionBy()).alias("__total"))
    drawn = requests.withColumn("__u", uniform(seed, F.col(request)))
    hit = (F.col("__u") * F.col("__total") < F.col("__high")) & (F.col("__u") * F.col("__total") >= F.col("__high") - F.col(speed))
    return drawn.join(F.broadcast(bounds), hit).select(*requests.columns, worker)


def windowed_counts(events: DataFrame, at: str, group: str, value: str, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums of tumbling windows of a stream or a batch, late rows beyond ``late`` left out of a stream."""
    timed = events.withColumn("__at", F.col(at).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("__at", late)
    out = timed.groupBy(F.window("__at", length), group).agg(F.count("*").alias("n"), F.sum(F.round(F.col(value) * 100).cast("long")).alias("cents"))
    return out.select(F.col("window.start").alias("start"), group, "n", "cents")


def sessions(events: DataFrame, at: str, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user, closed by a gap."""
    timed = events.withColumn("__at", F.col(at).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("__at", late)
    out = timed.groupBy(F.session_window("__at", gap), user).agg(F.count("*").alias("n"))
    return out.select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
