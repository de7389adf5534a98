"""Name, path, date and error queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import names
from framelake.plans.tables import table


def parse_build_names(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    name = F.concat_ws("@", F.concat(F.lit("hive-"), "user_id"), F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH-mm-ss"))
    p = ev.select("event_id", F.concat(name, F.when(F.col("event_id") % 3 == 0, ".h264").when(F.col("event_id") % 3 == 1, ".mp4").otherwise("")).alias("name"))
    p = p.withColumn("p", names.parse_video_name(F.col("name")))
    return p.select("event_id", "p.hive", F.col("p.day").cast("string").alias("day"), "p.time", names.build_video_name(F.col("p.hive"), F.col("p.day"), F.col("p.time")).alias("built"), names.hive_of(F.concat(F.lit("/a/"), "name")).alias("hive_of"))


def frame_names(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id")
    name = names.frame_name(F.col("event_id"), F.col("event_id") / 2)
    return ev.select("event_id", name.alias("frame"), names.mask_name(name).alias("mask"), names.safe_stem(F.concat(F.lit("a/b:"), "event_id")).alias("stem"), F.regexp_extract(name, names.FRAME_NAME, 1).cast("long").alias("idx"))


def url_rewrite(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", names.url_of_source(F.concat("url", F.lit(".h264")), "base/", "://").alias("rewritten"), names.percent_encoded(F.col("url")).alias("encoded"))


def slug_of(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    built = F.when(F.col("doc_id") % 5 > 0, F.concat(names.slug(F.col("source"), F.col("lang")), F.lit("___"), F.col("doc_id").cast("string"))).otherwise(F.col("source"))
    return d.select("doc_id", names.slug_of(built).alias("slug"), names.relative_to(F.concat(F.lit("/data/"), "source"), "/data").alias("relative"))


def json_props(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def error_classify(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("code", F.when(F.col("value") > 250, 200 + F.floor("value")).cast("int"))
    kind = F.when(F.col("event_type") == "error", "network").when(F.col("event_type") == "view", "value").otherwise("other")
    return ev.select("event_id", names.classify_error(F.col("code"), kind).alias("status"))


def parse_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "M/d/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon")
    time = F.when(F.col("o_orderkey") % 2 == 0, "3:04:05 pm").otherwise("15:04:05")
    return o.select("o_orderkey", names.parse_date(text).alias("day"), names.parse_time(time).alias("time"))


def retry_waits(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem").select("l_linenumber").distinct()
    return o.select("l_linenumber", names.backoff_seconds(F.col("l_linenumber"), F.lit(3.0), F.col("l_linenumber") - 5.0).alias("wait"))


def schedule_signatures(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    sig = names.signature(F.col("c_nationkey"), F.col("c_mktsegment"))
    return c.groupBy(sig.alias("signature")).agg(F.count(F.lit(1)).alias("n"))


def class_rules_real(spark, sf_dir):
    """JOIN-10 with the fixed class rules, over names made from table values."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.element_at(F.array(*map(F.lit, ("Dead Worker", "Asian Hornet", "DRONE bee", "pollen", "Guard", "B", "honeybee", "intruder_wasp"))), (F.col("n_nationkey") % 8 + 1).cast("int")).alias("name"))
    return n.select("n_nationkey", "name", names.map_class(F.col("name")).alias("bucket"))


QUERIES = {f.__name__: f for f in (parse_build_names, frame_names, url_rewrite, slug_of, json_props, error_classify, parse_dates, retry_waits, schedule_signatures, class_rules_real)}
SQL = {
    "parse_build_names": """
SELECT event_id, 'hive-' || user_id AS hive, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:%M:%S') AS time,
       'hive-' || user_id || '@' || strftime(ts, '%Y-%m-%d@%H-%M-%S') || '.mp4' AS built, 'hive-' || user_id AS hive_of FROM events""",
    "frame_names": """
WITH n AS (SELECT event_id, printf('frame_%06d_t%08.1fs', event_id, event_id / 2.0::DOUBLE) AS s FROM events)
SELECT event_id, s || '.jpg' AS frame, s || '_mask.png' AS mask, 'a_b-' || event_id AS stem, event_id AS idx FROM n""",
    "url_rewrite": """
SELECT page_id, 'base/' || ltrim(substr(url, instr(url, '://') + 3), '/') || '.mp4' AS rewritten, url_encode(url) AS encoded FROM pages""",
    "slug_of": "SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN source || '__' || lang ELSE '<unknown>' END AS slug, source AS relative FROM documents",
    "json_props": "SELECT event_id, (props ->> '$.k')::BIGINT AS k FROM events",
    "error_classify": """
WITH e AS (SELECT *, CASE WHEN value > 250 THEN (200 + floor(value))::INT END AS code FROM events)
SELECT event_id, CASE WHEN code IN (403, 404, 410) THEN 'unavailable' WHEN code IN (408, 429) OR code >= 500 THEN 'failed'
                      WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'unavailable' ELSE 'failed' END AS status FROM e""",
    "parse_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN o_orderdate::DATE END AS day, '15:04:05' AS time FROM orders",
    "retry_waits": """
SELECT DISTINCT l_linenumber, CASE WHEN l_linenumber > 5 THEN greatest(3.0, l_linenumber - 5.0) ELSE greatest(3.0, least(60.0, pow(2, l_linenumber))) END::DOUBLE AS wait FROM lineitem""",
    "schedule_signatures": """
SELECT sha256('{"c_nationkey":' || c_nationkey || ',"c_mktsegment":"' || c_mktsegment || '"}') AS signature, count(*) AS n FROM customer GROUP BY 1""",
    "class_rules_real": """
WITH n AS (SELECT n_nationkey, ['Dead Worker', 'Asian Hornet', 'DRONE bee', 'pollen', 'Guard', 'B', 'honeybee', 'intruder_wasp'][n_nationkey % 8 + 1] AS name FROM nation)
SELECT n_nationkey, name, ['worker', 'enemy', 'drone', NULL, 'worker', NULL, 'worker', 'enemy'][n_nationkey % 8 + 1] AS bucket FROM n""",
}
