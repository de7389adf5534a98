"""Crops, swaps, blurs, borders and heat maps of rasters made from events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.operators import crop_rows as ops
from framelake.plans.rasters import FRAME_AREA, FRAME_WIDE, gray_frames
from framelake.plans.tables import table

#: Background side, window side, output side; patch sizes; tokens of a group, of which the first squares count.
BACK, WINDOW, OUTPUT = 10, 12, 8
PATCH_HIGH, PATCH_WIDE, TOKENS, MAP_HIGH, MAP_WIDE = 8, 16, 30, 9, 13
HIGH = FRAME_AREA // FRAME_WIDE
RGB = ["r", "g", "b"]


def colour_frames(spark, sf_dir: str) -> DataFrame:
    """(idx, y, x, r, g, b, mask, place) of frames with all their pixels; the mask has shadow and foreground."""
    i, v = F.col("event_id"), F.col("value")
    full = table(spark, sf_dir, "events").groupBy(F.floor(i / FRAME_AREA).alias("idx")).count().where(F.col("count") == FRAME_AREA).select("idx")
    made = table(spark, sf_dir, "events").select(
        F.floor(i / FRAME_AREA).alias("idx"), (i % FRAME_AREA).alias("place"), F.floor(i % FRAME_AREA / FRAME_WIDE).cast("int").alias("y"), (i % FRAME_WIDE).cast("int").alias("x"),
        (F.floor("value") % 256).cast("int").alias("r"), (F.floor(v * 3) % 256).cast("int").alias("g"), (F.col("user_id") * 7 % 256).cast("int").alias("b"), F.when(v < 45, 255).when(v < 60, 127).otherwise(0).alias("mask"),
    )
    return made.join(full, "idx").withColumns({"h": F.lit(HIGH), "w": F.lit(FRAME_WIDE)})


def crops_of(spark, sf_dir: str) -> DataFrame:
    """Two windows a frame, some of which leave it, over backgrounds of another size."""
    frames = colour_frames(spark, sf_dir)
    back = frames.where(F.col("place") < BACK * BACK).select("idx", F.floor(F.col("place") / BACK).alias("y"), (F.col("place") % BACK).alias("x"), *RGB, F.lit(BACK).alias("h"), F.lit(BACK).alias("w"))
    windows = frames.where("place < 2").select(
        (F.col("idx") * 2 + F.col("place")).alias("crop"), "idx", (F.col("idx") * 3 % 30 - 6 + F.col("place")).cast("int").alias("x1"), (F.col("idx") * 5 % 23 - 6 - F.col("place")).cast("int").alias("y1"), F.lit(WINDOW).alias("size"), "h", "w",
    )
    return ops.swapped_crops(frames, frames.select("idx", "y", "x", "mask"), back, windows, by=["idx"], crop="crop", channels=RGB, output=OUTPUT)


def swapped_crops(spark, sf_dir):
    """IMG-09, IMG-06, PRJ-04: crops with swapped backgrounds, their own pixels and masks."""
    return crops_of(spark, sf_dir)


def crop_measures(spark, sf_dir):
    """DQ-02..06 on pixel rows."""
    m = ops.crop_measures(crops_of(spark, sf_dir), crop="crop", channels=RGB)
    return m.select("crop", "center_x", "center_y", *[F.round(c, 6).alias(c) for c in ("coverage", "swap_diff", "background_std", "luminance", "background_luminance")])


def blurred_frames(spark, sf_dir):
    """IMG-04 in tiles."""
    return ops.blurred(gray_frames(spark, sf_dir), by=["idx"], tile=8)


def padded_frames(spark, sf_dir):
    """MTH-08: frames filled up to whole patches."""
    return ops.padded(gray_frames(spark, sf_dir), by=["idx"], channels=["v"], high=PATCH_HIGH, wide=PATCH_WIDE)


def token_heatmaps(spark, sf_dir):
    """IMG-13: groups of tokens that hold more than their square."""
    tokens = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / TOKENS).alias("frame"), (F.col("event_id") % TOKENS).alias("place"), "value")
    maps = ops.heatmaps(tokens, by="frame", place="place", value="value", height=MAP_HIGH, width=MAP_WIDE, strict=False)
    return maps.select("frame", "y", "x", (F.round("v", 6) + 0.0).alias("v"))


QUERIES = {f.__name__: f for f in (swapped_crops, crop_measures, blurred_frames, padded_frames, token_heatmaps)}


def _area(source: str, key: str, size: tuple[str, str], new: tuple[int, int], columns: list[str]) -> str:
    """Means over the areas of new pixels, rounded half to even."""
    (h, w), (nh, nw) = size, new
    part = f"(least((i + 1) * {h}, (y + 1) * {nh}) - greatest(i * {h}, y * {nh})) * (least((j + 1) * {w}, (x + 1) * {nw}) - greatest(j * {w}, x * {nw}))"
    sums = ", ".join(f"sum({c} * {part})::BIGINT AS {c}" for c in columns)
    even = lambda c: f"({c} // ({h} * {w}) + (2 * ({c} % ({h} * {w})) > {h} * {w} OR (2 * ({c} % ({h} * {w})) = {h} * {w} AND ({c} // ({h} * {w})) % 2 = 1))::INT)::INT AS {c}"
    return f"""SELECT {key}, i AS y, j AS x, {", ".join(map(even, columns))} FROM (SELECT {key}, i, j, {sums} FROM {source}, range({nh}) AS ri(i), range({nw}) AS rj(j)
      WHERE (i + 1) * {h} > y * {nh} AND i * {h} < (y + 1) * {nh} AND (j + 1) * {w} > x * {nw} AND j * {w} < (x + 1) * {nw} GROUP BY ALL)"""


_OWN = ["r_own", "g_own", "b_own"]
_CROPS = f"""e AS MATERIALIZED (SELECT event_id // {FRAME_AREA} AS idx, event_id % {FRAME_AREA} AS place, event_id % {FRAME_AREA} // {FRAME_WIDE} AS y, event_id % {FRAME_WIDE} AS x, floor(value)::BIGINT % 256 AS r, floor(value * 3)::BIGINT % 256 AS g,
      user_id * 7 % 256 AS b, CASE WHEN value < 45 THEN 255 WHEN value < 60 THEN 127 ELSE 0 END AS mask, count(*) OVER (PARTITION BY event_id // {FRAME_AREA}) AS n FROM events),
k AS (SELECT idx, place // {BACK} AS y, place % {BACK} AS x, r, g, b FROM e WHERE place < {BACK * BACK} AND n = {FRAME_AREA}),
kb AS ({_area("k", "idx", (str(BACK), str(BACK)), (HIGH, FRAME_WIDE), RGB)}),
s AS MATERIALIZED (SELECT e.idx, e.y, e.x, e.mask, e.r AS r_own, e.g AS g_own, e.b AS b_own, {", ".join(f"CASE WHEN e.mask >= 127 THEN e.{c} ELSE kb.{c} END AS {c}" for c in RGB)} FROM e JOIN kb USING (idx, y, x) WHERE n = {FRAME_AREA}),
win AS (SELECT idx * 2 + place AS crop, idx, idx * 3 % 30 - 6 + place AS x1, idx * 5 % 23 - 6 - place AS y1 FROM e WHERE place < 2 AND n = {FRAME_AREA}),
cut AS MATERIALIZED (SELECT crop, cy AS y, cx AS x, mask, r, g, b, r_own, g_own, b_own FROM win, range({WINDOW}) AS a(cy), range({WINDOW}) AS c(cx), s
      WHERE s.idx = win.idx AND s.y = greatest(0, least(y1 + cy, {HIGH - 1})) AND s.x = greatest(0, least(x1 + cx, {FRAME_WIDE - 1}))),
sm AS ({_area("cut", "crop", (str(WINDOW), str(WINDOW)), (OUTPUT, OUTPUT), RGB + _OWN)}),
mk AS (SELECT crop, i AS y, j AS x, mask FROM cut, range({OUTPUT}) AS ri(i), range({OUTPUT}) AS rj(j) WHERE y = i * {WINDOW} // {OUTPUT} AND x = j * {WINDOW} // {OUTPUT}),
cr AS MATERIALIZED (SELECT crop, y::INT AS y, x::INT AS x, r, g, b, r_own, g_own, b_own, mask FROM sm JOIN mk USING (crop, y, x))"""
_WEIGHTS = "[" + ", ".join(map(str, ops.blur_weights(9))) + "]"
_TURN = lambda q, n: f"CASE WHEN {n} = 1 THEN 0 ELSE least((({q}) % (2 * ({n} - 1)) + 2 * ({n} - 1)) % (2 * ({n} - 1)), 2 * ({n} - 1) - (({q}) % (2 * ({n} - 1)) + 2 * ({n} - 1)) % (2 * ({n} - 1))) END"
_GRAY = f"""e AS (SELECT event_id // {FRAME_AREA} AS idx, event_id % {FRAME_AREA} // {FRAME_WIDE} AS y, event_id % {FRAME_WIDE} AS x, floor(value)::BIGINT % 256 AS v FROM events),
g AS MATERIALIZED (SELECT e.*, max(y) OVER (PARTITION BY idx) + 1 AS h, {FRAME_WIDE} AS w FROM e)"""


def _taps(new: int) -> str:
    """(size, q, i, c): what each old place gives to each new one, by the cubic kernel."""
    a = ops.CUBIC
    return f"""(SELECT size, q, greatest(0, least(f + d, size - 1)) AS i, sum(CASE WHEN d = -1 THEN w0 WHEN d = 0 THEN w1 WHEN d = 1 THEN w2 ELSE 1 - w0 - w1 - w2 END) AS c FROM (
      SELECT size, q, f, (({a} * (t + 1) - 5 * {a}) * (t + 1) + 8 * {a}) * (t + 1) - 4 * {a} AS w0, (({a} + 2) * t - ({a} + 3)) * t * t + 1 AS w1, (({a} + 2) * (1 - t) - ({a} + 3)) * (1 - t) * (1 - t) + 1 AS w2 FROM (
      SELECT size, q, floor((q + 0.5::DOUBLE) * size / {new} - 0.5)::BIGINT AS f, (q + 0.5::DOUBLE) * size / {new} - 0.5 - floor((q + 0.5::DOUBLE) * size / {new} - 0.5) AS t FROM (SELECT DISTINCT n AS size FROM z), range({new}) AS r(q))), range(-1, 3) AS o(d) GROUP BY ALL)"""


SQL = {
    "swapped_crops": f"WITH {_CROPS} SELECT * FROM cr",
    "crop_measures": f"""
WITH {_CROPS},
p AS (SELECT a.crop, a.y, a.x, greatest(abs(a.x - b.x), abs(a.y - b.y)) AS l, least(abs(a.x - b.x), abs(a.y - b.y)) AS s FROM cr a JOIN cr b USING (crop) WHERE a.mask = 255 AND b.mask <> 255),
d AS (SELECT crop, y, x, min(CASE WHEN l >= 2 * s THEN (l - 2 * s) * 10000 + s * 21969 ELSE (l - s) * 21969 + (2 * s - l) * 14000 END) AS d FROM p GROUP BY ALL),
t AS (SELECT crop, min((-d, y, x)) AS b FROM d GROUP BY crop UNION ALL SELECT crop, (0, 0, 0) FROM cr GROUP BY crop HAVING bool_and(mask = 255)),
m AS (SELECT crop, count(*) FILTER (mask > 0) / count(*)::DOUBLE AS coverage, 3.0::DOUBLE * count(*) FILTER (mask = 0) AS n,
      sum(abs(r - r_own) + abs(g - g_own) + abs(b - b_own)) FILTER (mask = 0) AS diff, sum(r + g + b) FILTER (mask = 0) AS s, sum(r * r + g * g + b * b) FILTER (mask = 0) AS ss,
      avg(round_even((299 * r + 587 * g + 114 * b) / 1000.0::DOUBLE, 0)) AS luminance, avg(round_even((299 * r + 587 * g + 114 * b) / 1000.0::DOUBLE, 0)) FILTER (mask = 0) AS background_luminance FROM cr GROUP BY crop)
SELECT m.crop, t.b[3]::INT AS center_x, t.b[2]::INT AS center_y, round(coverage, 6) AS coverage, round(diff / nullif(n, 0), 6) AS swap_diff, round(sqrt(n * ss - s::DOUBLE * s) / nullif(n, 0), 6) AS background_std,
       round(luminance, 6) AS luminance, round(background_luminance, 6) AS background_luminance FROM m LEFT JOIN t USING (crop)""",
    "blurred_frames": f"""
WITH {_GRAY}, o AS (SELECT unnest(range(-4, 5)) AS d, unnest({_WEIGHTS}) AS k),
a AS (SELECT idx, y, x, h, w, d, k, {_TURN("y + d", "h")} AS at FROM g, o),
v AS MATERIALIZED (SELECT a.idx, a.y, a.x, a.h, a.w, sum(g.v * a.k)::BIGINT AS s FROM a JOIN g ON g.idx = a.idx AND g.y = a.at AND g.x = a.x GROUP BY ALL),
b AS (SELECT idx, y, x, k, {_TURN("x + d", "w")} AS at FROM v, o)
SELECT b.idx, b.y::INT AS y, b.x::INT AS x, ((sum(v.s * b.k)::BIGINT + {ops.BLUR_UNIT**2 // 2}) // {ops.BLUR_UNIT**2})::INT AS v FROM b JOIN v ON v.idx = b.idx AND v.y = b.y AND v.x = b.at GROUP BY ALL""",
    "padded_frames": f"""
WITH {_GRAY}, z AS (SELECT idx, h, w, (h + {PATCH_HIGH - 1}) // {PATCH_HIGH} * {PATCH_HIGH} AS nh, (w + {PATCH_WIDE - 1}) // {PATCH_WIDE} * {PATCH_WIDE} AS nw FROM g GROUP BY ALL),
q AS (SELECT *, {_TURN("y", "h")} AS sy, {_TURN("x", "w")} AS sx FROM (SELECT idx, h, w, nh, nw, y, unnest(range(nw)) AS x FROM (SELECT *, unnest(range(nh)) AS y FROM z)))
SELECT q.idx, q.y::INT AS y, q.x::INT AS x, g.v::INT AS v, nh::INT AS h, nw::INT AS w FROM q JOIN g ON g.idx = q.idx AND g.y = q.sy AND g.x = q.sx""",
    "token_heatmaps": f"""
WITH a AS (SELECT event_id // {TOKENS} AS frame, event_id % {TOKENS} AS place, value, floor(sqrt(count(*) OVER (PARTITION BY event_id // {TOKENS})))::BIGINT AS n FROM events),
z AS MATERIALIZED (SELECT frame, n, place // n AS i, place % n AS j, (value - min(value) OVER f) / (max(value) OVER f - min(value) OVER f + 1e-6::DOUBLE) AS v FROM a WHERE place < n * n WINDOW f AS (PARTITION BY frame))
SELECT frame, ty.q::INT AS y, tx.q::INT AS x, round(greatest(0, least(1, sum(v * ty.c * tx.c))), 6) + 0.0::DOUBLE AS v
FROM z JOIN {_taps(MAP_HIGH)} ty ON ty.size = n AND ty.i = z.i JOIN {_taps(MAP_WIDE)} tx ON tx.size = n AND tx.i = z.j GROUP BY frame, ty.q, tx.q""",
}
