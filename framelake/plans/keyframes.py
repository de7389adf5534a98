"""Keyframe, index and probe queries over events, lineitem and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.operators import frames as ops
from framelake.operators.order import quantiles
from framelake.plans.tables import FRAMES, frames, table

GAP, DIFF, CAP = 86_400.0, 50.0, 15


def keyframe_gap(spark, sf_dir):
    return ops.keyframes(frames(spark, sf_dir), by="user_id", seconds=F.col("t"), value=F.col("value"), key="event_id", min_gap=GAP)


def keyframe_gap_diff(spark, sf_dir):
    return ops.keyframes(frames(spark, sf_dir), by="user_id", seconds=F.col("t"), value=F.col("value"), key="event_id", min_gap=GAP / 4, min_diff=DIFF, max_frames=CAP, usable=F.col("event_type") != "error")


def sample_clock_bucket(spark, sf_dir):
    return ops.sample_clock(frames(spark, sf_dir), by="user_id", seconds=F.col("t"), every=172_800.0).select("user_id", "event_id", "tick")


def seek_candidates(spark, sf_dir):
    v = frames(spark, sf_dir).groupBy("user_id").agg((F.floor(F.max("t")) / 100000).alias("duration"))
    return ops.seek_candidates(v, every=2.5, skip=1.0).select("user_id", "i", "seek")


def extraction_counters(spark, sf_dir):
    f = frames(spark, sf_dir)
    return ops.counters(f, kept=F.col("value") >= DIFF, usable=F.col("event_type") != "error")


def group_summary_min_by(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("video"), (F.col("l_orderkey") * 1000 + F.col("l_partkey")).alias("frame_idx"), F.col("l_quantity").cast("long").alias("size_bytes"), F.col("l_linenumber").cast("double").alias("mtime"),
    )
    li = li.groupBy("video", "frame_idx").agg(F.max("size_bytes").alias("size_bytes"), F.max("mtime").alias("mtime"))
    return ops.summary(li, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("video")))


def dataset_totals(spark, sf_dir):
    return ops.totals(group_summary_min_by(spark, sf_dir))


def probe_summary(spark, sf_dir):
    """AGG-03."""
    o, by = table(spark, sf_dir, "orders"), ["o_orderpriority"]
    ends = o.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"))
    halves = quantiles(o, {"median_price": F.col("o_totalprice"), "median_key": F.col("o_custkey")}, [0.5], by=by)
    return ends.join(halves, by).withColumns({"median_price": F.round("median_price", 2), "median_key": F.col("median_key").cast("int")})


def value_spread(spark, sf_dir):
    """AGG-16/17: population deviation, sign of the third moment."""
    ev = table(spark, sf_dir, "events")
    return ev.groupBy("event_type").agg(F.round(F.stddev_pop("value"), 4).alias("std"), (F.avg(F.pow(F.col("value") - 100, 3)) < 0).alias("flipped"))


def background_share(spark, sf_dir):
    """STM-01 on short runs of numbers."""
    f = frames(spark, sf_dir).select(F.col("user_id").alias("video"), F.col("event_id").alias("idx"), F.array(F.col("value"), F.col("value") * 2).alias("pixels"))
    return ops.background_model(f, by="video", schema="video long, idx long, foreground double, error string").select("video", "idx", "foreground")


QUERIES = {f.__name__: f for f in (keyframe_gap, keyframe_gap_diff, sample_clock_bucket, seek_candidates, extraction_counters, group_summary_min_by, dataset_totals, probe_summary, value_spread, background_share)}
_SUMMARY = """li AS (SELECT l_suppkey AS video, l_orderkey * 1000 + l_partkey AS frame_idx, max(l_quantity::BIGINT) AS size_bytes, max(l_linenumber::DOUBLE) AS mtime FROM lineitem GROUP BY 1, 2),
g AS (SELECT video, count(*) AS frame_count, sum(size_bytes)::BIGINT AS total_bytes, arg_min(mtime, frame_idx) AS first_mtime, max(mtime) AS last_mtime FROM li GROUP BY 1),
s AS (SELECT s_suppkey AS video, coalesce(frame_count, 0) AS frame_count, coalesce(total_bytes, 0) AS total_bytes, coalesce(first_mtime, 0) AS first_mtime, coalesce(last_mtime, 0) AS last_mtime
      FROM supplier LEFT JOIN g ON g.video = s_suppkey)"""


def _gate(gap: float, diff: float, cap: int, where: str) -> str:
    return f"""
WITH RECURSIVE {FRAMES},
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn FROM f WHERE {where}),
k AS (
  SELECT user_id, rn, event_id, t AS lt, value AS lv, 1 AS ordinal, TRUE AS kept FROM o WHERE rn = 1
  UNION ALL
  SELECT o.user_id, o.rn, o.event_id, CASE WHEN c THEN o.t ELSE lt END, CASE WHEN c THEN o.value ELSE lv END, ordinal + c::INT, c
  FROM (SELECT o.*, k.lt, k.lv, k.ordinal, o.t - k.lt >= {gap} AND abs(o.value - k.lv) >= {diff} AND k.ordinal < {cap} AS c FROM k JOIN o ON o.user_id = k.user_id AND o.rn = k.rn + 1) o)
SELECT user_id, event_id, ordinal FROM k WHERE kept"""


SQL = {
    "keyframe_gap": _gate(GAP, 0.0, 1_000_000_000, "TRUE"),
    "keyframe_gap_diff": _gate(GAP / 4, DIFF, CAP, "event_type <> 'error'"),
    "sample_clock_bucket": f"WITH {FRAMES} SELECT user_id, arg_min(event_id, t) AS event_id, floor((t + 1e-9) / 172800.0)::BIGINT AS tick FROM f GROUP BY user_id, tick",
    "seek_candidates": f"""
WITH {FRAMES}, v AS (SELECT user_id, floor(max(t)) / 100000 AS duration FROM f GROUP BY 1),
p AS (SELECT *, unnest(range(0, floor(duration / 2.5)::INT + 1))::INT AS i FROM v)
SELECT user_id, i, 1.0::DOUBLE + i * 2.5::DOUBLE AS seek FROM p WHERE 1.0 + i * 2.5 <= duration""",
    "extraction_counters": "SELECT count(*) AS sampled, count(*) FILTER (value >= 50) AS saved, count(*) FILTER (event_type = 'error') AS skipped_no_object FROM events",
    "group_summary_min_by": f"WITH {_SUMMARY} SELECT * FROM s",
    "dataset_totals": f"WITH {_SUMMARY} SELECT count(*) AS video_count, sum(frame_count)::BIGINT AS frame_count, sum(total_bytes)::BIGINT AS total_bytes FROM s",
    "probe_summary": """
SELECT o_orderpriority, count(*) AS n, min(o_totalprice) AS least, max(o_totalprice) AS most, round(median(o_totalprice), 2) AS median_price, floor(median(o_custkey))::INT AS median_key
FROM orders GROUP BY 1""",
    "value_spread": "SELECT event_type, round(stddev_pop(value), 4) AS std, avg(pow(value - 100, 3)) < 0 AS flipped FROM events GROUP BY 1",
}
