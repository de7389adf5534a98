"""Keyframes from ordered frame streams: clocks, gates and state machines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from framelake.functions.checks import non_negative, positive
from framelake.functions.numbers import mean_abs_diff
from framelake.operators.order import folded


def lag_difference(frames: DataFrame, *, by: str, order: list[str], signature: str) -> DataFrame:
    """WIN-03: frames with `motion`, the mean absolute difference to the frame before; a number or an array."""
    before = F.lag(signature).over(Window.partitionBy(by).orderBy(*order))
    is_array = frames.schema[signature].dataType.typeName() == "array"
    return frames.withColumn("_before", before).withColumn("motion", mean_abs_diff(F.col(signature), F.col("_before")) if is_array else F.abs(F.col(signature) - F.col("_before"))).drop("_before")


def video_metrics(frames: DataFrame, *, by: str) -> DataFrame:
    """AGG-09: mean sharpness, brightness and motion (0 for a single frame), and the score."""
    m = frames.groupBy(by).agg(F.avg("sharpness").alias("sharpness"), F.avg("brightness").alias("brightness"), F.coalesce(F.avg("motion"), F.lit(0.0)).alias("motion"))
    return m.withColumn("score", F.col("sharpness") * (1 + F.col("motion")))


def sample_clock(frames: DataFrame, *, by: str, seconds: Column, every: float, start: float = 0.0) -> DataFrame:
    """STM-02: the first frame of each clock tick, from `start`."""
    positive(every=every)
    tick = F.floor((seconds + 1e-9 - start) / every)
    ticked = frames.withColumn("tick", tick).where(seconds + 1e-9 >= start)
    return ticked.withColumn("_rn", F.row_number().over(Window.partitionBy(by, "tick").orderBy(seconds))).where("_rn = 1").drop("_rn")


def keyframes(frames: DataFrame, *, by: str, seconds: Column, value: Column, key: str, min_gap: float, min_diff: float = 0.0, max_frames: int = 0, usable: Column | None = None) -> DataFrame:
    """WIN-15, STM-03/04, SRT-05: the frames that a greedy gate keeps, with their ordinal.

    A frame is kept if min_gap has passed since the last kept one, its value (a
    number or an array) differs from that one's by min_diff at least (arrays: in
    the mean), it is usable, and fewer than max_frames are kept (0: no cap); a
    rejected frame leaves the state alone. A frame without a time is not kept. One
    shuffle by group; its sorted frames are streamed past a state of constant size.
    """
    non_negative(min_gap=min_gap, min_diff=min_diff, max_frames=max_frames)
    ok = F.lit(True) if usable is None else usable
    value = value if isinstance(frames.select(value).schema[0].dataType, ArrayType) else value.cast("double")
    rows = frames.select(F.col(by), seconds.cast("double").alias("_t"), F.col(key).alias("_k"), value.alias("_v"), ok.alias("_ok"))
    kinds = [frames.schema[c].dataType.simpleString() for c in (by, key)]

    def step(state: list, row: tuple) -> tuple | None:
        group, t, k, v, fits = row
        if not fits or t is None or max_frames and state[2] >= max_frames:
            return None
        if state[2] and (t - state[0] < min_gap or (change := difference(v, state[1])) is None or change < min_diff):
            return None
        state[:] = t, v, state[2] + 1
        return group, k, state[2]

    return folded(rows, by=by, order=["_t", "_k"], start=lambda: [None, None, 0], step=step, schema=f"{by} {kinds[0]}, {key} {kinds[1]}, ordinal int")


def difference(a: float | list[float] | None, b: float | list[float] | None) -> float | None:
    if a is None or b is None:
        return None
    return sum(abs(x - y) for x, y in zip(a, b, strict=True)) / max(1, len(a)) if isinstance(a, list) else abs(a - b)


def frames_at(frames: DataFrame, times: DataFrame, *, by: str, seconds: str, at: str, bucket: float = 60.0) -> DataFrame:
    """SRC-07: each sample time (by, at) with the frame that is shown then: the last whose time is not later; null before the first.

    An as-of join in time buckets, so that a long recording is spread over tasks:
    a time looks among the frames of its own bucket, else it takes the last frame
    of the buckets before, of which a window sees one row each.
    """
    others = [c for c in frames.columns if c != by]
    cell = lambda c: F.floor(F.col(c) / bucket).cast("long")
    f = frames.select(by, cell(seconds).alias("_cell"), F.struct(F.col(seconds).alias("_s"), *others).alias("_f"))
    last = f.groupBy(by, "_cell").agg(F.max("_f").alias("_last"))
    t = times.withColumn("_cell", cell(at))
    wanted = t.select(by, "_cell").distinct().join(last, [by, "_cell"], "full")
    before = Window.partitionBy(by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = wanted.select(F.col(by).alias("_by"), F.col("_cell").alias("_c"), F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    kind = f.schema["_f"].dataType
    both = f.select(by, "_cell", F.col("_f._s").alias("_at"), F.lit(0).alias("_q"), "_f", F.lit(None).cast(t.schema[at].dataType).alias("_t")).unionByName(
        t.select(by, "_cell", F.col(at).cast(kind["_s"].dataType).alias("_at"), F.lit(1).alias("_q"), F.lit(None).cast(kind).alias("_f"), F.col(at).alias("_t"))
    )
    inside = Window.partitionBy(by, "_cell").orderBy("_at", "_q", "_f").rowsBetween(Window.unboundedPreceding, 0)
    own = both.withColumn("_own", F.last("_f", ignorenulls=True).over(inside)).where("_q = 1")
    found = own.join(carried, (F.col(by) == F.col("_by")) & (F.col("_cell") == F.col("_c")), "left").withColumn("_hit", F.coalesce("_own", "_carried"))
    return found.select(by, F.col("_t").alias(at), *[F.col(f"_hit.{c}").alias(c) for c in others])


def wanted_tokens(frames: DataFrame, wanted: DataFrame, *, idx: str = "frame_idx", tokens: str = "tokens") -> DataFrame:
    """SRC-08: the tokens of the wanted frames, a row each, with their place."""
    kept = frames.join(wanted.select(idx).distinct(), idx, "left_semi")
    return kept.select(*[c for c in frames.columns if c != tokens], F.posexplode(tokens).alias("place", "token"))


def frame_time(idx: Column, fps: Column) -> Column:
    """DAT-04: seconds of a frame."""
    return idx / fps


def seek_candidates(videos: DataFrame, *, every: float, skip: float = 0.0) -> DataFrame:
    """STM-03: a row for each seek time of videos (duration)."""
    positive(every=every)
    n = F.floor(F.col("duration") / every).cast("int")
    return videos.withColumn("i", F.explode(F.sequence(F.lit(0), n))).withColumn("seek", skip + F.col("i") * every).where("seek <= duration")


def background_model(frames: DataFrame, *, by: str, schema: str, rate: float = 0.05, distance: float = 2.5) -> DataFrame:
    """STM-01, STM-05, STM-10: per-video running mean and variance of frames (idx, pixels array): foreground share of each.

    A documented stand-in for an adaptive mixture. A video's frames are streamed in
    order past its model. A frame that fails becomes a row with `error`, and ends its
    video, not the others.
    """

    def step(state: dict, row: tuple) -> tuple | None:
        key, idx, pixels = row
        if "error" in state:
            return None
        try:
            x = np.asarray(pixels, np.float64)
            if not state:
                state.update(mean=x.copy(), var=np.full_like(x, 225.0))
            if x.shape != state["mean"].shape:
                raise ValueError(f"{len(x)} pixels, not {len(state['mean'])}")
            hit = (x - state["mean"]) ** 2 > distance**2 * state["var"]
            state["mean"] += rate * (x - state["mean"])
            state["var"] = np.maximum(4.0, state["var"] + rate * ((x - state["mean"]) ** 2 - state["var"]))
            return key, idx, float(hit.mean()), None
        except (ValueError, TypeError) as e:  # pixels that are no numbers, or of another size
            state["error"] = str(e)
            return key, idx, None, str(e)

    return folded(frames.select(by, "idx", "pixels"), by=by, order=["idx"], start=dict, step=step, schema=schema)


def skipped(videos: DataFrame, done: DataFrame, *, by: str, duration: str, least: float) -> DataFrame:
    """STM-05: why a video is left out: `present` or `short`; null for those to be worked on."""
    have = done.select(F.col(by).alias("_by")).distinct()
    joined = videos.join(have, F.col(by) == F.col("_by"), "left")
    return joined.withColumn("skip", F.when(F.col("_by").isNotNull(), "present").when(F.col(duration) < least, "short")).drop("_by")


def summary(frames: DataFrame, videos: DataFrame | None = None) -> DataFrame:
    """AGG-01: frame count, bytes, mtime of the lowest index and latest mtime by video; zeros for empty videos."""
    s = frames.groupBy("video").agg(F.count(F.lit(1)).alias("frame_count"), F.sum("size_bytes").alias("total_bytes"), F.min_by("mtime", "frame_idx").alias("first_mtime"), F.max("mtime").alias("last_mtime"))
    return s if videos is None else videos.select("video").distinct().join(s, "video", "left").na.fill(0)


def totals(summaries: DataFrame) -> DataFrame:
    """AGG-02: one row, or none without videos."""
    t = summaries.agg(F.count(F.lit(1)).alias("video_count"), F.sum("frame_count").alias("frame_count"), F.sum("total_bytes").alias("total_bytes"))
    return t.where("video_count > 0")


def observed(frames: DataFrame, kept: Column, usable: Column) -> tuple[DataFrame, Observation]:
    """AGG-20: the frames that are kept and usable, and their counters (sampled, saved, skipped_no_object), which the pass that writes them fills: nothing is read twice.

    A frame counts as skipped if it would be kept but isn't usable. The counters are
    there once an action on the frames has ended, and hold for the first one.
    """
    seen = Observation("counters")
    good, fits = F.coalesce(kept, F.lit(False)), F.coalesce(usable, F.lit(False))
    rows = frames.withColumns({"_kept": good, "_usable": fits}).observe(seen, F.count(F.lit(1)).alias("sampled"), F.count_if(F.col("_kept") & F.col("_usable")).alias("saved"), F.count_if(F.col("_kept") & ~F.col("_usable")).alias("skipped_no_object"))
    return rows.where("_kept and _usable").drop("_kept", "_usable"), seen


def counters(frames: DataFrame, kept: Column, usable: Column) -> DataFrame:
    """AGG-20."""
    return frames.agg(F.count(F.lit(1)).alias("sampled"), F.count_if(kept).alias("saved"), F.count_if(~usable).alias("skipped_no_object"))
