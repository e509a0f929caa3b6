"""Users' trajectories from a stream of interaction events: sessions that end by inactivity, kept in state until the watermark passes."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.streaming.drain import replay


def trajectory_stream(events: DataFrame, gap: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """(user_id, started, ended, events, clicks, dwell, abandoned) of each session of events (user_id, ts, event_type, value).

    Late events join their session until the watermark, lateness behind the newest event, has passed its end by the gap.
    """
    click = F.col("event_type") == "click"
    one = lambda t: F.max((F.col("event_type") == t).cast("int"))
    s = events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), "user_id").agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("events"), F.count(F.when(click, 1)).alias("clicks"), F.avg(F.when(click, F.col("value"))).alias("dwell"),
        ((one("error") == 1) & (one("purchase") == 0)).alias("abandoned"))
    return s.drop("session_window")


def trajectories(spark: SparkSession, events: DataFrame, gap: str = "1 day", lateness: str = "1 hour", root: str | None = None) -> DataFrame:
    """trajectory_stream() of a bounded table of events, to its end; see replay(). Events without a time are left out, as they end no session."""
    return replay(spark, events.filter("ts is not null"), lambda e: trajectory_stream(e, gap, lateness), "ts", {"ts": "9990-01-01 00:00:00"}, "trajectories", root)
