"""Media, model and bookkeeping queries: events are frames, embeddings tokens, orders images, lineitem annotations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from framelake.operators import annotations as ops
from framelake.operators import curate, evaluate, vectors
from framelake.operators import frames as frame_ops
from framelake.operators.order import percentiles, ranked
from framelake.plans.tables import FRAMES, frames, table
from framelake.sources import media

STEP, STEPS, DAY = 172_800.0, 15, 86_400.0


def frames_at_times(spark, sf_dir):
    """SRC-07: the frame of each video that is shown at each of some times."""
    f = frames(spark, sf_dir).select("user_id", "event_id", "t")
    times = f.select("user_id").distinct().withColumn("at", F.explode(F.transform(F.sequence(F.lit(0), F.lit(STEPS)), lambda i: i * F.lit(STEP))))
    return frame_ops.frames_at(f, times, by="user_id", seconds="t", at="at", bucket=DAY).select("user_id", "at", F.coalesce("event_id", F.lit(-1)).alias("event_id"))


def wanted_frame_tokens(spark, sf_dir):
    """SRC-08: tokens of the frames that the labels name."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_idx"), F.col("embedding").alias("tokens"))
    wanted = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("frame_idx"))
    return frame_ops.wanted_tokens(e, wanted).select("frame_idx", "place", F.round(F.col("token").cast("double"), 6).alias("token"))


def positional_zip(spark, sf_dir):
    """JOIN-12: lines and quantities of an order by place."""
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("a"), F.sort_array(F.collect_list("l_quantity")).alias("b"))
    pairs = ops.zipped(F.col("a"), F.col("b"), ("line", "quantity"))
    return lists.select("l_orderkey", F.posexplode(pairs).alias("place", "p")).select("l_orderkey", "place", "p.line", "p.quantity")


def reassign_annotation_ids(spark, sf_dir):
    """WIN-07 for images and annotations."""
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), F.col("o_orderpriority").alias("split"))
    notes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), "l_linenumber")
    _, numbered = ops.renumbered(images, notes, part="split", image="image_id", annotation="l_linenumber")
    return numbered.select("image_id", "l_linenumber", "new_image_id", "new_id")


def annotation_defaults(spark, sf_dir):
    """PRJ-02."""
    li = table(spark, sf_dir, "lineitem")
    box = F.array(*[F.col(c).cast("double") for c in ("l_partkey", "l_suppkey", "l_quantity", "l_linenumber")])
    r = li.select(ops.annotation_record(F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.col("l_orderkey"), F.lit(1), box, F.when(F.col("l_linestatus") == "F", F.col("l_quantity")), F.lit(None)).alias("r"))
    return r.select("r.id", "r.image_id", "r.category_id", F.element_at("r.bbox", 3).alias("w"), "r.area", "r.iscrowd", F.size("r.segmentation").alias("segments"))


def dedupe_in_order(spark, sf_dir):
    """SET-05."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return curate.distinct_in_order(ev, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def slug_allow_list(spark, sf_dir):
    """FIL-07."""
    o = table(spark, sf_dir, "orders")
    return curate.allowed(o, "o_orderpriority", " 1-URGENT, ,5-LOW ").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def requested_in_order(spark, sf_dir):
    """JOIN-06: the place in the request stays."""
    return curate.requested(table(spark, sf_dir, "region"), ["EUROPE", "ATLANTIS", "ASIA", "EUROPE", "AFRICA"], "r_name").select("r_name", "place")


def valid_classes(spark, sf_dir):
    """FIL-08."""
    li = table(spark, sf_dir, "lineitem").withColumn("category_id", F.col("l_linenumber") - 2)
    return evaluate.in_classes(li, 3).groupBy("category_id").agg(F.count(F.lit(1)).alias("n"))


def score_threshold(spark, sf_dir):
    """FIL-09."""
    return ops.above(table(spark, sf_dir, "lineitem"), 0.05, "l_discount").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def detection_total(spark, sf_dir):
    """AGG-11."""
    return ops.grand_total(score_threshold(spark, sf_dir))


def skip_missing_images(spark, sf_dir):
    """FIL-13."""
    notes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), "l_returnflag")
    there = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("image_id"))
    return ops.with_image(notes, there, on="image_id").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def background_first_frame(spark, sf_dir):
    """JOIN-11: nations are folders, customers their frames."""
    back = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("folder"), F.lit(640).alias("width"), (F.col("n_regionkey") * 120).cast("int").alias("height"))
    first = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("folder"), F.col("c_name").alias("path"), F.lit(640).alias("width"), (F.col("c_custkey") % 5 * 120).cast("int").alias("height"))
    return ops.background_sizes(back, first, by="folder", path="path", width="width", height="height")


def frame_times(spark, sf_dir):
    """DAT-04."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(frame_ops.frame_time(F.col("p_partkey"), F.lit(29.97)), 6).alias("seconds"))


def video_properties(spark, sf_dir):
    """SRC-18: some recordings don't say their rate."""
    v = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("path")).agg(F.when(F.max("event_id") % 2 == 0, F.lit(25.0)).alias("fps"), F.count(F.lit(1)).alias("frames"))
    raw = v.select("path", "fps", "frames", F.lit(640).alias("w"), F.lit(480).alias("h"), F.lit(None).cast("string").alias("error"))
    return media.properties(raw).select("path", "fps", "frames", F.round("duration", 6).alias("duration"))


def skip_reasons(spark, sf_dir):
    """STM-05: videos that are done or too short."""
    f = frames(spark, sf_dir)
    videos = f.groupBy("user_id").agg((F.max("t") - F.min("t")).alias("duration"))
    done = f.where("event_type = 'purchase' and value > 150")
    return frame_ops.skipped(videos, done, by="user_id", duration="duration", least=2_000_000.0).select("user_id", "skip")


def token_split(spark, sf_dir):
    """ML-01."""
    reference, patches = media.tokens_split(F.col("embedding"), 2)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(reference.cast("double"), 6).alias("reference"), F.size(patches).alias("patches"), F.round(F.get(patches, F.lit(0)).cast("double"), 6).alias("first_patch"))


def batched_model(spark, sf_dir):
    """ML-02, ML-10, STM-08: a model that gives the length of a vector, in batches."""

    def load():
        return lambda rows: pd.DataFrame({"vec_id": rows["vec_id"], "length": np.round([float(np.linalg.norm(np.asarray(v, np.float64))) for v in rows["embedding"]], 4)})

    return media.batched(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), load, "vec_id long, length double")


def explained_variance(spark, sf_dir):
    """AGG-21, on the first axes."""
    out = vectors.explained_variance(table(spark, sf_dir, "embeddings"), vector="embedding", projections=[F.get("embedding", F.lit(i)).cast("double") for i in range(3)])
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def rank_documents(spark, sf_dir):
    """WIN-02 with a payload: all documents by length."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", "text")
    return ranked(d, F.col("n_chars").desc(), F.col("doc_id")).select("doc_id", "rank", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def price_percentiles(spark, sf_dir):
    """AGG-15 by group."""
    return percentiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", 0.95, by=["l_returnflag"], name="p95").withColumn("p95", F.round("p95", 4))


QUERIES = {f.__name__: f for f in (
    frames_at_times, wanted_frame_tokens, positional_zip, reassign_annotation_ids, annotation_defaults, dedupe_in_order, slug_allow_list, requested_in_order, valid_classes, score_threshold,
    detection_total, skip_missing_images, background_first_frame, frame_times, video_properties, skip_reasons, token_split, batched_model, explained_variance, rank_documents, price_percentiles,
)}
SQL = {
    "frames_at_times": f"""
WITH {FRAMES}, s AS (SELECT user_id, unnest(range(0, {STEPS + 1})) * {STEP}::DOUBLE AS at FROM (SELECT DISTINCT user_id FROM f))
SELECT s.user_id, s.at, coalesce(arg_max(event_id, struct_pack(t := t, e := event_id)), -1) AS event_id FROM s LEFT JOIN f ON f.user_id = s.user_id AND f.t <= s.at GROUP BY 1, 2""",
    "wanted_frame_tokens": """
SELECT vec_id AS frame_idx, unnest(range(0, len(embedding)))::INT AS place, round(unnest(embedding)::DOUBLE, 6) AS token FROM embeddings
WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)""",
    "positional_zip": """
WITH a AS (SELECT l_orderkey, l_linenumber AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS place FROM lineitem),
b AS (SELECT l_orderkey, l_quantity AS quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) - 1 AS place FROM lineitem)
SELECT l_orderkey, place::INT AS place, line, quantity FROM a JOIN b USING (l_orderkey, place)""",
    "reassign_annotation_ids": """
WITH i AS (SELECT o_orderkey AS image_id, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS new_image_id FROM orders)
SELECT image_id, l_linenumber, new_image_id, row_number() OVER (ORDER BY new_image_id, l_linenumber) AS new_id FROM lineitem JOIN i ON l_orderkey = image_id""",
    "annotation_defaults": """
SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS image_id, 1 AS category_id, l_quantity::DOUBLE AS w, CASE WHEN l_linestatus = 'F' THEN l_quantity::DOUBLE ELSE 0.0 END AS area, 0 AS iscrowd, 0 AS segments
FROM lineitem""",
    "dedupe_in_order": "SELECT user_id, event_type, arg_min(event_id, struct_pack(ts := ts, e := event_id)) AS event_id FROM events GROUP BY 1, 2",
    "slug_allow_list": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1",
    "requested_in_order": "SELECT r_name, place FROM region JOIN (VALUES ('EUROPE', 0), ('ATLANTIS', 1), ('ASIA', 2), ('AFRICA', 3)) AS w(name, place) ON name = r_name",
    "valid_classes": "SELECT (l_linenumber - 2)::INT AS category_id, count(*) AS n FROM lineitem WHERE l_linenumber - 2 BETWEEN 0 AND 2 GROUP BY 1",
    "score_threshold": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_discount >= 0.05 GROUP BY 1",
    "detection_total": "SELECT count(*) AS total FROM lineitem WHERE l_discount >= 0.05",
    "skip_missing_images": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1",
    "background_first_frame": """
WITH f AS (SELECT c_nationkey AS folder, min(c_name) AS first_frame, arg_min(c_custkey % 5 * 120, c_name)::INT AS frame_height FROM customer GROUP BY 1)
SELECT folder, first_frame, 640 AS width, (n_regionkey * 120)::INT AS height, 640 AS frame_width, frame_height, n_regionkey * 120 < frame_height AS too_small FROM f JOIN nation ON n_nationkey = folder""",
    "frame_times": "SELECT p_partkey, round(p_partkey / 29.97::DOUBLE, 6) AS seconds FROM part",
    "video_properties": """
WITH v AS (SELECT user_id AS path, CASE WHEN max(event_id) % 2 = 0 THEN 25.0 ELSE 30.0 END::DOUBLE AS fps, count(*) AS frames FROM events GROUP BY 1)
SELECT path, fps, frames, round(frames / fps, 6) AS duration FROM v""",
    "skip_reasons": f"""
WITH {FRAMES}, v AS (SELECT user_id, max(t) - min(t) AS duration, bool_or(event_type = 'purchase' AND value > 150) AS done FROM f GROUP BY 1)
SELECT user_id, CASE WHEN done THEN 'present' WHEN duration < 2000000 THEN 'short' END AS skip FROM v""",
    "token_split": "SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS reference, (len(embedding) - 2)::INT AS patches, round(embedding[3]::DOUBLE, 6) AS first_patch FROM embeddings",
    "batched_model": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS length FROM embeddings",
    "explained_variance": """
WITH a AS (SELECT var_pop(x) AS v FROM (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings))
SELECT round(var_pop(embedding[1]::DOUBLE) / any_value(v), 6) AS axis_0, round(var_pop(embedding[2]::DOUBLE) / any_value(v), 6) AS axis_1, round(var_pop(embedding[3]::DOUBLE) / any_value(v), 6) AS axis_2
FROM embeddings, a""",
    "rank_documents": "SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank, md5(text) AS text_md5 FROM documents",
    "price_percentiles": "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY 1",
}
