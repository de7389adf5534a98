"""Rasters made from events: blocks of events by id are pictures, their values pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.operators import background
from framelake.operators import frames as frame_ops
from framelake.operators import pixels as ops
from framelake.plans.tables import table

#: Pixels of a row, and of a raster; frames are smaller, and a video has some.
WIDE, AREA = 50, 2_500
FRAME_WIDE, FRAME_AREA, VIDEO_FRAMES = 25, 500, 5
SMALL_HIGH, SMALL_WIDE = 6, 9
#: Frames of a video that a background is learnt from.
LONG_VIDEO = 20


def masks(spark, sf_dir: str, on: Column) -> DataFrame:
    """(raster, y, x, v) with 255 where `on` is true, 127 for some of the others."""
    i = F.col("event_id")
    v = F.when(on, 255).when(F.col("value") > 150, 127).otherwise(0)
    return table(spark, sf_dir, "events").select(F.floor(i / AREA).alias("raster"), F.floor(i % AREA / WIDE).cast("int").alias("y"), (i % WIDE).cast("int").alias("x"), v.alias("v"))


def gray_frames(spark, sf_dir: str) -> DataFrame:
    """(video, idx, y, x, v, h, w); the last frame may be less high."""
    i = F.col("event_id")
    ev = table(spark, sf_dir, "events").select(F.floor(i / FRAME_AREA).alias("idx"), F.floor(i % FRAME_AREA / FRAME_WIDE).cast("int").alias("y"), (i % FRAME_WIDE).cast("int").alias("x"), (F.floor("value") % 256).cast("int").alias("v"))
    high = ev.groupBy("idx").agg((F.max("y") + 1).alias("h"))
    return ev.join(high, "idx").select(F.floor(F.col("idx") / VIDEO_FRAMES).alias("video"), "idx", "y", "x", "v", "h", F.lit(FRAME_WIDE).alias("w"))


def component_boxes(spark, sf_dir):
    """IMG-07 on pixel rows."""
    return ops.component_boxes(masks(spark, sf_dir, F.col("value") < 20), raster="raster", min_area=2)


def pixel_distances(spark, sf_dir):
    """IMG-08 on pixel rows: distances within the foreground."""
    return ops.distances(masks(spark, sf_dir, F.col("value") < 90), raster="raster").where("d > 0")


def farthest_pixels(spark, sf_dir):
    return ops.farthest(masks(spark, sf_dir, F.col("value") < 90), raster="raster")


def frame_scores(spark, sf_dir):
    """IMG-01..03 on pixel rows, in tiles."""
    s = ops.scored_frames(gray_frames(spark, sf_dir), by="video", idx="idx", height=SMALL_HIGH, width=SMALL_WIDE, tile=8)
    return s.select("video", "idx", *[F.round(c, 6).alias(c) for c in ("sharpness", "brightness", "motion")])


def video_scores(spark, sf_dir):
    """AGG-09: the scores of whole videos."""
    s = ops.scored_frames(gray_frames(spark, sf_dir), by="video", idx="idx", height=SMALL_HIGH, width=SMALL_WIDE, tile=8)
    m = frame_ops.video_metrics(s, by="video")
    return m.select("video", *[F.round(c, 5).alias(c) for c in ("sharpness", "brightness", "motion", "score")])


def mixture_blocks(spark, sf_dir: str) -> DataFrame:
    """A still picture with some noise, on which errors are bright spots; every tenth frame is dimmer."""
    i = F.col("event_id")
    idx, y, x = F.floor(i / FRAME_AREA), F.floor(i % FRAME_AREA / FRAME_WIDE).cast("int"), (i % FRAME_WIDE).cast("int")
    v = F.when(F.col("event_type") == "error", 230).otherwise(100 + 3 * (x % 7) + F.floor("value") % 5)
    f = table(spark, sf_dir, "events").select(F.floor(idx / LONG_VIDEO).alias("video"), idx.alias("idx"), y.alias("y"), x.alias("x"), F.when(idx % 10 == 9, F.floor(v * 0.8)).otherwise(v).cast("int").alias("v"))
    f = f.withColumns({"h": F.lit(FRAME_AREA // FRAME_WIDE), "w": F.lit(FRAME_WIDE)})
    return background.background_blocks(f, by="video", idx="idx", channels=["v"], rule=background.Rule(history=100), blur=3, tile=10)


def mixture_foreground(spark, sf_dir):
    """STM-01: foreground and shadow of each frame."""
    return background.shares(mixture_blocks(spark, sf_dir), by="video", idx="idx")


def mixture_background(spark, sf_dir):
    """STM-01, SNK-09: the background of each video."""
    return background.background_pixels(mixture_blocks(spark, sf_dir), by="video")


def moving_boxes(spark, sf_dir):
    """STM-01, IMG-07: components of the mixture's foreground in each frame."""
    masks_ = background.mask_pixels(mixture_blocks(spark, sf_dir), by="video", idx="idx")
    return ops.component_boxes(masks_, raster="idx", min_area=4)


QUERIES = {f.__name__: f for f in (mixture_foreground, mixture_background, moving_boxes, component_boxes, pixel_distances, farthest_pixels, frame_scores, video_scores)}


def _mask(on: str) -> str:
    return f"m AS MATERIALIZED (SELECT event_id // {AREA} AS raster, (event_id % {AREA} // {WIDE})::INT AS y, (event_id % {WIDE})::INT AS x, {on} AS fg FROM events)"


#: The distance of two pixels dx and dy apart: the longest of its weights along straight, diagonal and knight's steps.
_D = f"""{_mask('value < 90')},
p AS (SELECT a.raster, a.y, a.x, greatest(abs(a.x - b.x), abs(a.y - b.y)) AS l, least(abs(a.x - b.x), abs(a.y - b.y)) AS s FROM m a JOIN m b USING (raster) WHERE a.fg AND NOT b.fg),
d AS (SELECT raster, y, x, min(CASE WHEN l >= 2 * s THEN (l - 2 * s) * {ops.NEAR} + s * {ops.KNIGHT} ELSE (l - s) * {ops.KNIGHT} + (2 * s - l) * {ops.DIAGONAL} END) / {ops.UNIT}.0::DOUBLE AS d FROM p GROUP BY ALL)"""
_F = f"""e AS (SELECT event_id // {FRAME_AREA} AS idx, (event_id % {FRAME_AREA} // {FRAME_WIDE})::INT AS y, (event_id % {FRAME_WIDE})::INT AS x, floor(value)::INT % 256 AS v FROM events),
g AS MATERIALIZED (SELECT e.*, max(y) OVER (PARTITION BY idx) + 1 AS h, {FRAME_WIDE} AS w FROM e),
n AS (SELECT g.*, CASE WHEN h = 1 THEN 0 WHEN y = 0 THEN 1 ELSE y - 1 END AS up, CASE WHEN h = 1 THEN 0 WHEN y = h - 1 THEN h - 2 ELSE y + 1 END AS down,
             CASE WHEN x = 0 THEN 1 ELSE x - 1 END AS l, CASE WHEN x = w - 1 THEN w - 2 ELSE x + 1 END AS r FROM g),
a AS (SELECT n.idx, n.v, u.v + d.v + l.v + r.v - 4 * n.v AS lap FROM n JOIN g u ON u.idx = n.idx AND u.y = n.up AND u.x = n.x JOIN g d ON d.idx = n.idx AND d.y = n.down AND d.x = n.x
      JOIN g l ON l.idx = n.idx AND l.y = n.y AND l.x = n.l JOIN g r ON r.idx = n.idx AND r.y = n.y AND r.x = n.r),
sh AS (SELECT idx, (count(*) * sum(lap * lap)::HUGEINT - sum(lap)::HUGEINT * sum(lap)::HUGEINT)::DOUBLE / (count(*)::DOUBLE * count(*)) AS sharpness, sum(v)::DOUBLE / count(*) AS brightness FROM a GROUP BY idx),
c AS (SELECT idx, i, j, sum(v * (least((i + 1) * h, (y + 1) * {SMALL_HIGH}) - greatest(i * h, y * {SMALL_HIGH})) * (least((j + 1) * w, (x + 1) * {SMALL_WIDE}) - greatest(j * w, x * {SMALL_WIDE})))::BIGINT AS s,
             max(h * w)::BIGINT AS d FROM g, range({SMALL_HIGH}) AS ri(i), range({SMALL_WIDE}) AS rj(j)
      WHERE (i + 1) * h > y * {SMALL_HIGH} AND i * h < (y + 1) * {SMALL_HIGH} AND (j + 1) * w > x * {SMALL_WIDE} AND j * w < (x + 1) * {SMALL_WIDE} GROUP BY ALL),
t AS (SELECT idx, idx // {VIDEO_FRAMES} AS video, i, j, s // d + (2 * (s % d) > d OR (2 * (s % d) = d AND (s // d) % 2 = 1))::INT AS v FROM c),
o AS (SELECT video, idx, avg(abs(v - before)) AS motion FROM (SELECT *, lag(v) OVER (PARTITION BY video, i, j ORDER BY idx) AS before FROM t) GROUP BY ALL)"""
SQL = {
    "component_boxes": f"""
WITH RECURSIVE {_mask('value < 20')},
q AS MATERIALIZED (SELECT raster, y, x FROM m WHERE fg),
t AS (SELECT raster, y, x, y AS fy, x AS fx FROM q
      UNION SELECT t.raster, q.y, q.x, t.fy, t.fx FROM t JOIN q ON q.raster = t.raster AND abs(q.y - t.y) <= 1 AND abs(q.x - t.x) <= 1),
r AS (SELECT raster, y, x, min((fy, fx)) AS first FROM t GROUP BY ALL)
SELECT raster, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS area, first[1] AS first_y, first[2] AS first_x FROM r GROUP BY raster, first HAVING count(*) >= 2""",
    "pixel_distances": f"WITH {_D} SELECT raster, y::BIGINT AS y, x::BIGINT AS x, d FROM d",
    "farthest_pixels": f"WITH {_D} SELECT raster, b.y AS y, b.x AS x, -b.d AS d FROM (SELECT raster, min(struct_pack(d := -d, y := y, x := x)) AS b FROM d GROUP BY raster) "
    "UNION ALL SELECT raster, 0, 0, NULL FROM m GROUP BY raster HAVING bool_and(fg)",
    "frame_scores": f"WITH {_F} SELECT video, idx, round(sharpness, 6) AS sharpness, round(brightness, 6) AS brightness, round(motion, 6) AS motion FROM sh JOIN o USING (idx)",
    "video_scores": f"""
WITH {_F}, z AS (SELECT video, avg(sharpness) AS sharpness, avg(brightness) AS brightness, coalesce(avg(motion), 0) AS motion FROM sh JOIN o USING (idx) GROUP BY video)
SELECT video, round(sharpness, 5) AS sharpness, round(brightness, 5) AS brightness, round(motion, 5) AS motion, round(sharpness * (1 + motion), 5) AS score FROM z""",
}
