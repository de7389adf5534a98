"""The test tables in the roles that the queries give them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as frames: user_id is the video, t the seconds since the first of January 2024."""
    ev = table(spark, sf_dir, "events")
    t = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / F.lit(1e6)
    return ev.select("event_id", "user_id", "event_type", "value", "ts", t.alias("t"))


#: The same in SQL.
FRAMES = "f AS (SELECT event_id, user_id, event_type, value, ts, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6 AS t FROM events)"
