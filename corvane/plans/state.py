"""Queries of keyed state over ordered rows, in batch and as streams run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import load, new_path
from corvane.streaming import tracks as T
from corvane.streaming import workers as K


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as track observations: slot is the user, frame the event, score the value over 200."""
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("slot"), F.col("event_id").alias("frame"), (F.col("value") / 200).alias("score"))


def q51_track_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track ids of every user's events: born at a high value, lost after three low ones."""
    return T.track_ids(_observed(spark, sf_dir), ["slot"], "frame", "score", 0.6, 3).select("slot", "frame", "track")


def q52_heartbeat_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users seen in the twelve hours before the 20th, with their last event."""
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return K.registry(load(spark, sf_dir, "events"), "user_id", "ts", now, 12 * 3600, ("event_id",)).select("user_id", "event_id")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = load(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _run_out(df: DataFrame, mode: str) -> DataFrame:
    """A stream's rows once its input is used up, written to the shared folder and read back."""
    spark = df.sparkSession
    path = new_path(spark, "stream")
    if mode == "append":
        sink = df.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append")
    else:
        def put(rows: DataFrame, epoch: int) -> None:
            rows.write.mode("overwrite").parquet(f"{path}/rows")

        sink = df.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/state").outputMode(mode)
    sink.queryName(f"q{uuid.uuid4().hex[:8]}").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/rows")


def q62_stream_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts and sums by event type from a stream of the events."""
    return _run_out(K.windowed_counts(_event_stream(spark, sf_dir), "ts", "event_type", "value"), "complete").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "cents")


def q84_stream_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracks of q51 from a stream with keyed state."""
    seen = _event_stream(spark, sf_dir).select(F.col("user_id").alias("slot"), F.col("event_id").alias("frame"), (F.col("value") / 200).alias("score"))
    return _run_out(T.stream_tracks(seen, "slot", "frame", "score", 0.6, 3), "append")


def q85_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user with a gap of two hours."""
    out = K.sessions(load(spark, sf_dir, "events"), "ts", "user_id", "2 hours")
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def q86_least_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier with the least load: items over balance."""
    load_of = load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("queue"))
    rows = load_of.join(load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.greatest("s_acctbal", F.lit(1.0)).alias("speed")), "l_suppkey")
    return K.least_loaded(rows, "l_suppkey", "queue", "speed")


QUERIES = {k: v for k, v in globals().items() if k[0] == "q" and k[1:3].isdigit()}

_TRACKS = """with o as (select user_id slot, event_id frame, value / 200 >= 0.6 act, row_number() over (partition by user_id order by event_id) n from events),
l as (select *, max(case when act then n end) over (partition by slot order by frame) la, max(case when act then n end) over (partition by slot order by frame rows between unbounded preceding and 1 preceding) pa from o),
b as (select *, sum(case when act and (pa is null or n - pa - 1 >= 3) then 1 else 0 end) over (partition by slot order by frame) births from l)
select slot, frame, cast(case when la is null or n - la >= 3 then -1 else births - 1 end as bigint) track from b"""

ORACLE_SQL = {
    "q51_track_lifecycle": _TRACKS,
    "q84_stream_tracks": _TRACKS,
    "q52_heartbeat_expiry": """with l as (select user_id, max(ts) t, max_by(event_id, ts) event_id from events where ts <= timestamp '2024-01-20' group by 1)
select user_id, event_id from l where epoch(date_trunc('second', t)) >= epoch(timestamp '2024-01-20') - 43200""",
    "q62_stream_window": "select strftime(date_trunc('day', ts), '%Y-%m-%d') \"day\", event_type, count(*) n, cast(sum(cast(round(value * 100) as bigint)) as bigint) cents from events group by 1, 2",
    "q85_sessions": """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 2 hours then 0 else 1 end f from events),
s as (select user_id, sum(f) over (partition by user_id order by ts rows unbounded preceding) s from g), c as (select user_id, s, count(*) n from s group by 1, 2)
select user_id, count(*) sessions, max(n) longest from c group by 1""",
    "q86_least_loaded": """with q as (select l_suppkey, count(*) n from lineitem group by 1) select l_suppkey from q join supplier on l_suppkey = s_suppkey order by n / greatest(s_acctbal, 1.0), l_suppkey limit 1""",
}
