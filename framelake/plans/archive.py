"""An archive of recordings made from the tables: its files, lists, manifests and names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake import sources
from framelake.functions import names
from framelake.operators import crop_rows, curate, frames, pixels, quality, raster
from framelake.plans import crops, rasters
from framelake.plans.rasters import FRAME_AREA, FRAME_WIDE
from framelake.plans.tables import table
from framelake.scratch import Scratch
from framelake.sources import sinks

ROOT = "/archive"
NOW = "2024-01-05 12:00:00"


def files(spark, sf_dir: str) -> DataFrame:
    """(path, folder, name, size_bytes, mtime): a frame for each event, masks beside some, and a background in some folders."""
    folder = lambda user: F.concat(F.lit(f"{ROOT}/v"), user.cast("string"))
    ev = table(spark, sf_dir, "events").select("event_id", "value", folder(F.col("user_id")).alias("folder"), names.frame_name(F.col("event_id"), F.col("event_id") / 2).alias("frame"))
    size = (F.lit(1000) + F.col("event_id") % 77).cast("long")
    both = F.array_compact(F.array(F.col("frame"), F.when(F.col("value") < 40, names.mask_name(F.col("frame")))))
    shots = ev.select("folder", F.explode(both).alias("name"), size.alias("size_bytes"), (F.col("event_id") * 0.25).alias("mtime"))
    backs = table(spark, sf_dir, "events").where("user_id % 3 = 0").select(folder(F.col("user_id")).alias("folder"), F.lit("background.png").alias("name"), F.lit(9).cast("long").alias("size_bytes"), F.lit(0.5).cast("double").alias("mtime")).distinct()
    return shots.withColumn("mtime", F.col("mtime").cast("double")).unionByName(backs).withColumn("path", F.concat_ws("/", "folder", "name"))


def archive_samples(spark, sf_dir):
    """SRC-01, JOIN-01: frames with the masks that lie beside them."""
    return sources.samples(files(spark, sf_dir))


def archive_backgrounds(spark, sf_dir):
    """SRC-02."""
    return sources.backgrounds(files(spark, sf_dir))


def frame_index_summary(spark, sf_dir):
    """SRC-15, FIL-04, AGG-01: the frames of each customer's recordings by their names; zeros for those without."""
    videos = table(spark, sf_dir, "customer").select(F.concat(F.lit("v"), F.col("c_custkey").cast("string")).alias("video"))
    return frames.summary(sources.frame_index(files(spark, sf_dir)), videos)


def archive_totals(spark, sf_dir):
    """SNK-03, AGG-02: the manifest of a version, without the time at which it was made."""
    totals = frames.totals(frames.summary(sources.frame_index(files(spark, sf_dir))))
    return sinks.dataset_manifest(totals, "v1", ROOT, None).drop("created_at")


def frame_places(spark, sf_dir):
    """SRC-16, SRT-04: the place of each frame in its folder."""
    return sources.frame_groups(sources.frame_index(files(spark, sf_dir)).select("frame_path", "frame_idx"), ROOT)


def listed_but_missing(spark, sf_dir):
    """SRC-05: listed folders' backgrounds that aren't there."""
    listed = table(spark, sf_dir, "customer").select(F.concat(F.lit(f"{ROOT}/v"), F.col("c_custkey").cast("string"), F.lit("/background.png")).alias("path"))
    return sources.missing_from(listed, files(spark, sf_dir))


def manifest_lines(spark, sf_dir: str, scratch: Scratch) -> str:
    """Two batches of records that were appended, after older lines of which some are broken, are of an unknown status, or have a key that is no text."""
    path = f"{scratch.root}/manifest"
    i, k = F.col("event_id"), F.floor(F.col("event_id") / 2)
    status = F.when(i % 7 == 0, "queued").when(i % 3 == 0, "failed").otherwise("downloaded")
    keys = F.concat(F.lit("h"), (k % 50).cast("string")).alias("hive"), F.concat(F.lit("d"), F.floor(k / 50).cast("string")).alias("day"), F.lit("t").alias("time")
    ev = table(spark, sf_dir, "events").select("event_id", status.alias("status"), *keys)
    old = F.format_string('{"status": "unavailable", "hive": %s, "day": "%s", "time": "t"%s', F.when(i % 5 == 0, k.cast("string")).otherwise(F.concat(F.lit('"'), "hive", F.lit('"'))), "day", F.when(i % 11 == 0, "").otherwise("}"))
    ev.where("event_id % 2 = 0").select(old.alias("value")).write.text(path)
    for batch in (0, 1):
        sinks.append_manifest(ev.where(F.col("event_id") % 2 == batch).drop("event_id"), path, batch)
    return path


def manifest_state(spark, sf_dir):
    """SNK-01, SRC-09, FIL-14, WIN-08: the last valid record of each key, and how many there are."""
    rows = sources.manifest(spark, manifest_lines(spark, sf_dir, Scratch(spark, "manifest")))
    last = curate.last_write_wins(rows, keys=["hive", "day", "time"], value="status", order="seq")
    return last.join(rows.groupBy("hive", "day", "time").agg(F.count(F.lit(1)).alias("n")), ["hive", "day", "time"])


def overlay_pixels(spark, sf_dir):
    """JOIN-14: frames blended with red where their mask is set; a mask lacks the pixels where nothing is."""
    f = crops.colour_frames(spark, sf_dir).withColumnRenamed("idx", "frame")
    return raster.overlay(f.select("frame", "y", "x", F.col("r").alias("c1"), F.col("g").alias("c2"), F.col("b").alias("c3")), f.where("mask > 0 or x % 2 = 0").select("frame", "y", "x", F.col("mask").alias("v")))


def swap_ratio(spark, sf_dir):
    """AGG-13."""
    return quality.swap_ratio(table(spark, sf_dir, "events").select((F.col("value") < 30).alias("swapped")))


def same_names(spark, sf_dir):
    """SET-06: whether odd and even events have the same types, and the same users."""
    ev = table(spark, sf_dir, "events").select("event_type", "user_id", (F.col("event_id") % 2).alias("half"))
    parts = [quality.same_names(ev.where("half = 0"), ev.where("half = 1"), c).select(F.lit(c).alias("what"), "same") for c in ("event_type", "user_id")]
    return parts[0].unionByName(parts[1])


def items_at(spark, sf_dir):
    """UDF-02, SRT-09: orders at places of their order, from both ends, of at least as many as asked for."""
    o = curate.enough(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 10, True)
    found = [sources.item(o, at, "o_orderkey").withColumn("at", F.lit(at)) for at in (0, 9, -1)]
    return found[0].unionByName(found[1]).unionByName(found[2])


def threshold_names(spark, sf_dir):
    """STR-11, SNK-18: names of masks by threshold, and where a download goes."""
    i = F.col("event_id")
    ev = table(spark, sf_dir, "events").select("event_id", names.frame_name(i, i / 2).alias("frame"), (i % 101 / 100).alias("t"), F.concat(F.lit("/d/x"), (i % 9).cast("string"), F.when(i % 2 == 0, ".mp4").otherwise("")).alias("path"), (i % 5 == 0).alias("is_dir"))
    return ev.select("event_id", names.threshold_name(names.stem(F.col("frame")), F.col("t")).alias("name"), names.download_destination(F.col("path"), F.col("is_dir"), F.col("frame")).alias("target"))


def retry_after(spark, sf_dir):
    """DAT-03: seconds, dates of the HTTP form, and what is neither."""
    i, now = F.col("event_id"), F.lit(NOW).cast("timestamp")
    ts = F.col("ts").cast("timestamp")
    text = F.when(i % 3 == 0, (i % 100 / 4).cast("string")).when(i % 3 == 1, F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).otherwise("soon")
    return table(spark, sf_dir, "events").select("event_id", names.retry_after_seconds(text, now).alias("seconds"))


def hub_pairs(spark, sf_dir):
    """SRC-20: workspaces and projects of lines, of which some are none."""
    lines = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise(F.concat_ws("/", F.concat(F.lit("w"), (F.col("p_partkey") % 9).cast("string")), "p_name")).alias("value"))
    return sources.pairs(lines)


def rewritten_videos(spark, sf_dir):
    """SNK-08/17: recordings of which some are written again, which replaces those and leaves the others."""
    path = f"{Scratch(spark, 'videos').root}/frames"
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("frame_idx"), "value", F.concat(F.lit("h"), (F.col("user_id") % 20).cast("string")).alias("video"))
    sinks.replace_videos(ev.where("frame_idx % 2 = 0"), path)
    sinks.replace_videos(ev.where("frame_idx % 2 = 1 and video in ('h1', 'h2', 'h3')"), path)
    return spark.read.parquet(path)


def new_videos(spark, sf_dir):
    """SNK-07: frames of recordings that aren't there yet."""
    ev = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("video"))
    return sinks.skip_existing(ev, table(spark, sf_dir, "events").where("value > 250").select(F.col("user_id").alias("video")))


def probe_lines(spark, sf_dir):
    """SNK-02/13/14: probe rows written as lines, with nulls, and read again."""
    path = f"{Scratch(spark, 'probe').root}/lines"
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 > 0, F.col("value")).alias("duration"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('no "video"\n'), "event_type")).alias("errors"))
    sinks.probe_report(rows, path)
    return spark.read.schema(rows.schema).json(path)


def picked_components(spark, sf_dir):
    """FIL-05/06, SRT-08: one component of each raster that has any, by the raster's number."""
    boxes = pixels.component_boxes(rasters.masks(spark, sf_dir, F.col("value") < 20), raster="raster", min_area=2)
    listed = boxes.groupBy("raster").agg(F.sort_array(F.collect_list(F.struct("first_y", "first_x", "x", "y", "w", "h", "area"))).alias("boxes"))
    return listed.select("raster", curate.pick_one(F.col("boxes"), F.col("raster")).alias("b")).select("raster", "b.x", "b.y", "b.w", "b.h", "b.area")


def enlarged_patches(spark, sf_dir):
    """IMG-16, JOIN-13: full grids of 5 x 4 patches as rasters of 11 x 14."""
    i = F.col("event_id")
    p = table(spark, sf_dir, "events").select(F.floor(i / 20).alias("frame"), (i % 20).alias("place"), (F.floor("value") % 256).cast("int").alias("r"), (F.col("user_id") % 256).cast("int").alias("g"))
    full = p.groupBy("frame").count().where("count = 20").select("frame")
    return crop_rows.enlarged(p.join(full, "frame", "left_semi"), by="frame", place="place", rows=5, columns=4, channels=["r", "g"], height=11, width=14)


def frame_variants(spark, sf_dir):
    """SNK-12, IMG-11: two forms of each frame, as it is and with its channels reversed."""
    f = table(spark, sf_dir, "events").select(F.col("user_id").alias("video"), F.col("event_id").alias("frame_idx"), F.array(F.floor("value"), F.col("event_id") % 7, F.lit(3).cast("long")).alias("pixel"))
    forms = sinks.video_variants(f, {"rgb": F.col("pixel"), "bgr": raster.channels_reversed(F.col("pixel"))})
    return forms.select("video", "frame_idx", "variant", F.concat_ws(",", F.transform("pixels", lambda v: v.cast("string"))).alias("pixels"))


def last_backgrounds(spark, sf_dir):
    """SNK-09: the model after the last frame of each recording."""
    return sinks.background_rows(table(spark, sf_dir, "events").select(F.col("user_id").alias("video"), F.col("event_id").alias("idx"), F.col("value").alias("background")))


QUERIES = {f.__name__: f for f in (
    archive_samples, archive_backgrounds, frame_index_summary, archive_totals, frame_places, listed_but_missing, manifest_state, overlay_pixels, swap_ratio, same_names, items_at, threshold_names, retry_after, hub_pairs,
    rewritten_videos, new_videos, probe_lines, picked_components, enlarged_patches, frame_variants, last_backgrounds,
)}
_STEM = "printf('frame_%06d_t%08.1fs', event_id, event_id / 2.0::DOUBLE)"
_FILES = f"""ev AS (SELECT event_id, value, user_id, '{ROOT}/v' || user_id AS folder, {_STEM} AS stem, 1000 + event_id % 77 AS size, event_id * 0.25::DOUBLE AS mtime FROM events),
shots AS (SELECT 'v' || user_id AS video, folder || '/' || stem || '.jpg' AS frame_path, event_id AS frame_idx, size, mtime FROM ev)"""
SQL = {
    "archive_samples": f"WITH {_FILES} SELECT 'v' || user_id AS video_id, stem AS frame_id, folder || '/' || stem || '.jpg' AS frame_path, folder || '/' || stem || '_mask.png' AS mask_path FROM ev WHERE value < 40",
    "archive_backgrounds": f"SELECT DISTINCT 'v' || user_id AS video_id, '{ROOT}/v' || user_id || '/background.png' AS path FROM events WHERE user_id % 3 = 0",
    "frame_index_summary": f"""
WITH {_FILES}, s AS (SELECT video, count(*) AS frame_count, sum(size)::BIGINT AS total_bytes, min_by(mtime, frame_idx) AS first_mtime, max(mtime) AS last_mtime FROM shots GROUP BY video)
SELECT 'v' || c_custkey AS video, coalesce(frame_count, 0) AS frame_count, coalesce(total_bytes, 0) AS total_bytes, coalesce(first_mtime, 0) AS first_mtime, coalesce(last_mtime, 0) AS last_mtime
FROM customer LEFT JOIN s ON s.video = 'v' || c_custkey""",
    "archive_totals": f"WITH {_FILES} SELECT count(DISTINCT video) AS video_count, count(*) AS frame_count, sum(size)::BIGINT AS total_bytes, 'v1' AS version, '{ROOT}' AS frames_dir, NULL::VARCHAR AS git_commit FROM shots HAVING count(*) > 0",
    "frame_places": f"WITH {_FILES} SELECT frame_path, frame_idx, '{ROOT}/' || video AS folder, row_number() OVER (PARTITION BY video ORDER BY frame_idx)::INT AS place FROM shots",
    "listed_but_missing": f"SELECT '{ROOT}/v' || c_custkey || '/background.png' AS path FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id % 3 = 0)",
    "manifest_state": """
WITH k AS (SELECT event_id AS i, event_id // 2 AS k FROM events),
r AS (SELECT k, i % 2 AS batch, CASE WHEN i % 3 = 0 THEN 'failed' ELSE 'downloaded' END AS status FROM k WHERE i % 7 <> 0
      UNION ALL SELECT k, -1, 'unavailable' FROM k WHERE i % 2 = 0 AND i % 5 <> 0 AND i % 11 <> 0)
SELECT 'h' || k % 50 AS hive, 'd' || k // 50 AS day, 't' AS time, max_by(status, batch) AS status, count(*) AS n FROM r GROUP BY k""",
    "overlay_pixels": f"""
WITH e AS (SELECT *, count(*) OVER (PARTITION BY event_id // {FRAME_AREA}) AS n FROM events),
f AS (SELECT event_id // {FRAME_AREA} AS frame, (event_id % {FRAME_AREA} // {FRAME_WIDE})::INT AS y, (event_id % {FRAME_WIDE})::INT AS x, floor(value)::INT % 256 AS r, floor(value * 3)::INT % 256 AS g, (user_id * 7 % 256)::INT AS b, value < 60 AS m FROM e WHERE n = {FRAME_AREA})
SELECT frame, y, x, CASE WHEN m THEN round_even(0.5::DOUBLE * r, 0)::INT ELSE r END AS c1, CASE WHEN m THEN round_even(0.5::DOUBLE * g, 0)::INT ELSE g END AS c2,
       CASE WHEN m THEN round_even(0.5::DOUBLE * b + 127.5, 0)::INT ELSE b END AS c3 FROM f""",
    "swap_ratio": "SELECT sum((value < 30)::INT)::DOUBLE / greatest(1, count(*)) AS swap_ratio FROM events",
    "same_names": "\nUNION ALL ".join(
        f"SELECT '{c}' AS what, NOT EXISTS (SELECT {c} FROM events WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(DISTINCT event_id % 2) < 2) AS same" for c in ("event_type", "user_id")
    ),
    "items_at": """
WITH o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, o_totalprice, a::INT AS at FROM o, (VALUES (0), (9), (-1)) AS w(a) WHERE place = CASE WHEN a < 0 THEN a + n ELSE a END""",
    "threshold_names": f"""
SELECT event_id, printf('%s_t%03d', {_STEM}, round_even(event_id % 101 / 100.0::DOUBLE * 100, 0)::INT) AS name,
       CASE WHEN event_id % 5 = 0 OR event_id % 2 = 1 THEN '/d/x' || event_id % 9 || CASE WHEN event_id % 2 = 0 THEN '.mp4' ELSE '' END || '/' || {_STEM} || '.jpg' ELSE '/d/x' || event_id % 9 || '.mp4' END AS target FROM events""",
    "retry_after": f"""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id % 100 / 4.0::DOUBLE WHEN 1 THEN greatest(0.0::DOUBLE, epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '{NOW}')) ELSE 0.0::DOUBLE END AS seconds FROM events""",
    "hub_pairs": "SELECT 'w' || p_partkey % 9 AS workspace, split_part(p_name, '/', 1) AS project FROM part WHERE p_partkey % 4 <> 0 UNION ALL SELECT split_part(p_name, '/', 1), split_part(p_name, '/', 2) FROM part WHERE p_partkey % 4 = 0 AND contains(p_name, '/')",
    "rewritten_videos": "SELECT event_id AS frame_idx, value, 'h' || user_id % 20 AS video FROM events WHERE event_id % 2 = CASE WHEN user_id % 20 IN (1, 2, 3) THEN 1 ELSE 0 END",
    "new_videos": "SELECT event_id, user_id AS video FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 250)",
    "probe_lines": "SELECT event_id, CASE WHEN event_id % 4 > 0 THEN value END AS duration, CASE WHEN event_id % 4 = 0 THEN 'no \"video\"' || chr(10) || event_type END AS errors FROM events",
    "picked_components": f"""
WITH c AS ({rasters.SQL["component_boxes"]}),
n AS (SELECT *, row_number() OVER (PARTITION BY raster ORDER BY first_y, first_x) - 1 AS place, count(*) OVER (PARTITION BY raster) AS n FROM c)
SELECT raster, x, y, w, h, area FROM n WHERE place = ('0x' || substr(md5(raster::VARCHAR), 1, 8))::BIGINT % n""",
    "enlarged_patches": """
WITH p AS (SELECT event_id // 20 AS frame, event_id % 20 AS place, (floor(value)::INT % 256) AS r, (user_id % 256)::INT AS g, count(*) OVER (PARTITION BY event_id // 20) AS n FROM events)
SELECT frame, i::INT AS y, j::INT AS x, r, g FROM p, range(11) AS a(i), range(14) AS b(j) WHERE n = 20 AND place = i * 5 // 11 * 4 + j * 4 // 14""",
    "frame_variants": """
WITH f AS (SELECT user_id AS video, event_id AS frame_idx, floor(value)::BIGINT AS a, event_id % 7 AS b FROM events)
SELECT video, frame_idx, 'rgb' AS variant, a || ',' || b || ',3' AS pixels FROM f UNION ALL SELECT video, frame_idx, 'bgr', '3,' || b || ',' || a FROM f""",
    "last_backgrounds": "SELECT user_id AS video, max_by(value, event_id) AS background FROM events GROUP BY 1",
}
