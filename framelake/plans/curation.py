"""Curation queries: events stand for videos (user_id) of hives (event_type)."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import numbers
from framelake.operators import curate
from framelake.operators.order import ranked
from framelake.plans.tables import FRAMES, frames, table


def video_scores(spark, sf_dir):
    """AGG-09 shaped metrics per user: mean value, share of clicks, rows."""
    ev = table(spark, sf_dir, "events")
    return ev.groupBy("user_id").agg(
        F.min_by("event_type", F.struct("ts", "event_id")).alias("hive_id"),
        F.round(F.avg("value"), 4).alias("sharpness"),
        F.round(F.count_if(F.col("event_type") == "click") / F.count(F.lit(1)), 6).alias("motion"),
        F.count(F.lit(1)).cast("double").alias("brightness"),
    )


def curate_diverse_topn(spark, sf_dir):
    scored = video_scores(spark, sf_dir).withColumn("score", F.round(F.col("sharpness") * (1 + F.col("motion")), 4))
    kept = scored.where(curate.passes_thresholds(40.0, 0.1, 20.0))
    return curate.diverse_top_n(kept, group="hive_id", score="score", tie="user_id", n=4).select("user_id", "hive_id", "score", "rank")


def lag_motion(spark, sf_dir):
    from framelake.operators.frames import lag_difference

    return lag_difference(frames(spark, sf_dir), by="user_id", order=["ts", "event_id"], signature="value").select("event_id", F.round("motion", 6).alias("motion"))


def last_n_days(spark, sf_dir):
    days = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day")).distinct()
    return curate.last_n(days, by="event_type", order="day", n=3)


#: Above the number of (event_type, day) keys, so that rows are filled in behind the first ones.
FIRST = 200


def first_per_key_backfill(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    picked = curate.first_then_backfill(ev, keys=["event_type", "day"], order=F.struct("ts", "event_id"), n=FIRST)
    return picked.select("event_id", "event_type", "day", "is_first")


def floor_bucket_interleave(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "HH:mm:ss").alias("time"))
    return curate.interleaved(ev, by=["user_id"], time="time", k=4, seed="42").select("user_id", "time", "bucket", "place")


def miss_streak_break(spark, sf_dir):
    rows = curate.miss_streak(table(spark, sf_dir, "events"), by="user_id", order=["ts", "event_id"], ok=F.col("event_type") != "error", limit=2)
    return rows.select("event_id", "user_id", F.col("streak").cast("long").alias("streak"))


def success_cap(spark, sf_dir):
    rows = curate.capped_successes(table(spark, sf_dir, "events"), by="user_id", order=["ts", "event_id"], ok=F.col("event_type") == "purchase", cap=3)
    return rows.select("event_id", "user_id")


def manifest_last_write_wins(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", F.struct("ts", "event_id").alias("seq"))
    return curate.last_write_wins(ev, keys=["user_id", "day"], value="event_type", order="seq").withColumnRenamed("event_type", "status")


def downloaded_by_day(spark, sf_dir):
    """AGG-04."""
    last = manifest_last_write_wins(spark, sf_dir)
    return last.groupBy("day").agg(F.count_if(F.col("status") == "purchase").alias("downloaded"), F.count(F.lit(1)).alias("listed"))


def pending_anti_join(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), "c_mktsegment")
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("custkey"))
    return curate.pending(customers, done, ["custkey"])


def even_index_selection(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return n.select("user_id", F.posexplode(numbers.even_indices(F.col("n"), 6)).alias("pos", "idx"))


def linspace_frames(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    w = n.withColumn("w", numbers.clip_window(F.col("n"), F.lit(1.0), 25.0))
    return w.select("user_id", F.posexplode(numbers.linspace_indices(F.col("w.start"), F.col("w.end"), 5)).alias("pos", "idx"))


def timestamps_middle90(spark, sf_dir):
    d = frames(spark, sf_dir).groupBy("user_id").agg((F.max("t") - F.min("t")).alias("duration"))
    return d.select("user_id", F.posexplode(numbers.middle_timestamps(F.col("duration"), 5)).alias("pos", "at")).withColumn("at", F.round("at", 3))


def percent_rank_table(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return ranked(parts, F.col("p_retailprice").desc(), F.col("p_partkey")).select("p_partkey", "rank")


def seeded_sample(spark, sf_dir):
    return curate.sampled(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), seed="42", keys=["o_orderkey"], n=50)


def date_range_filter(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    return o.where(curate.in_date_range(F.col("day"), "1996-01-01", "1997-06-30")).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    curate_diverse_topn, lag_motion, last_n_days, first_per_key_backfill, floor_bucket_interleave, miss_streak_break, success_cap, manifest_last_write_wins, downloaded_by_day,
    pending_anti_join, even_index_selection, linspace_frames, timestamps_middle90, percent_rank_table, seeded_sample, date_range_filter,
)}
_LAST = "last AS (SELECT user_id, ts::DATE AS day, arg_max(event_type, struct_pack(ts := ts, e := event_id)) AS status FROM events GROUP BY 1, 2)"
SQL = {
    "curate_diverse_topn": """
WITH m AS (
  SELECT user_id, arg_min(event_type, struct_pack(ts := ts, e := event_id)) AS hive_id, round(avg(value), 4) AS sharpness,
         round(count(*) FILTER (event_type = 'click') / count(*), 6) AS motion, count(*)::DOUBLE AS brightness
  FROM events GROUP BY user_id),
s AS (SELECT *, round(sharpness * (1 + motion), 4) AS score FROM m WHERE sharpness >= 40 AND motion >= 0.1 AND brightness >= 20),
g AS (SELECT *, row_number() OVER (PARTITION BY hive_id ORDER BY score DESC, user_id) AS rn FROM s)
SELECT user_id, hive_id, score, row_number() OVER (ORDER BY score DESC, user_id) AS rank
FROM g WHERE rn = 1 ORDER BY score DESC, user_id LIMIT 4""",
    "lag_motion": "SELECT event_id, round(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 6) AS motion FROM events",
    "last_n_days": """
SELECT event_type, day FROM (SELECT DISTINCT event_type, ts::DATE AS day FROM events)
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY day DESC) <= 3""",
    "first_per_key_backfill": f"""
WITH e AS (SELECT *, ts::DATE AS day FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type, day ORDER BY ts, event_id) = 1 AS is_first FROM e)
SELECT event_id, event_type, day, is_first FROM r ORDER BY is_first DESC, ts, event_id LIMIT {FIRST}""",
    "floor_bucket_interleave": """
WITH d AS (SELECT DISTINCT user_id, strftime(ts, '%H:%M:%S') AS time FROM events),
j AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY time) - 1 AS j, count(*) OVER (PARTITION BY user_id) AS n, md5('42|' || user_id || '|' || time) AS h FROM d),
b AS (SELECT *, CASE WHEN n <= 1 THEN 0 ELSE ((j + 1) * 4 - 1) // n END::INT AS bucket FROM j),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id, bucket ORDER BY h) AS turn FROM b)
SELECT user_id, time, bucket, row_number() OVER (PARTITION BY user_id ORDER BY turn, bucket) AS place FROM t""",
    "miss_streak_break": """
WITH r AS (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
s AS (SELECT *, CASE WHEN event_type <> 'error' THEN 0 ELSE sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) END::BIGINT AS streak FROM r)
SELECT event_id, user_id, streak FROM s
QUALIFY coalesce(sum((streak = 2)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0""",
    "success_cap": """
SELECT event_id, user_id FROM events
QUALIFY coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 3""",
    "manifest_last_write_wins": f"WITH {_LAST} SELECT user_id, day, status FROM last",
    "downloaded_by_day": f"WITH {_LAST} SELECT day, count(*) FILTER (status = 'purchase') AS downloaded, count(*) AS listed FROM last GROUP BY day",
    "pending_anti_join": """
SELECT c_custkey AS custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""",
    "even_index_selection": """
WITH n AS (SELECT user_id, count(*)::INT AS n FROM events GROUP BY 1),
p AS (SELECT user_id, n, unnest(range(0, least(n, 6)))::INT AS pos FROM n)
SELECT user_id, pos, CASE WHEN n <= 6 THEN pos ELSE round_even(pos * (n - 1) / 5.0, 0)::INT END AS idx FROM p""",
    "linspace_frames": """
WITH n AS (SELECT user_id, count(*)::INT AS n FROM events GROUP BY 1),
w AS (SELECT user_id, ((n - least(n, 25)) // 2)::INT AS s, least(n, 25) AS m FROM n),
p AS (SELECT user_id, s, greatest(m, 5) AS span, unnest(range(0, 5))::INT AS pos FROM w)
SELECT user_id, pos, (s + floor(pos * ((span - 1) / 4.0)))::INT AS idx FROM p""",
    "timestamps_middle90": f"""
WITH {FRAMES}, d AS (SELECT user_id, max(t) - min(t) AS duration FROM f GROUP BY 1),
p AS (SELECT *, unnest(range(0, 5))::INT AS pos FROM d WHERE duration > 0)
SELECT user_id, pos, round(duration * 0.05 + pos * (duration * 0.9 / 4), 3) AS at FROM p""",
    "percent_rank_table": "SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part",
    "seeded_sample": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 50",
    "date_range_filter": "SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders WHERE o_orderdate::DATE BETWEEN '1996-01-01' AND '1997-06-30' GROUP BY 1",
}
