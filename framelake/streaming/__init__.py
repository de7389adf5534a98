"""Streams and resumable work: keyframes with state by video, a schedule that is walked in waves, windowed counts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from framelake.functions.checks import non_negative, positive
from framelake.sources import next_day_index
from framelake.sources.sinks import save_state
from framelake.streaming.ledger import Ledger

#: Added to seconds for the watermark, which begins at 0 and drops what isn't above it.
ORIGIN = 1_000_000_000
RECORD = "hive string, day string, time string, status string, path string, reason string"


class KeyframeGate(StatefulProcessor):
    """The gate of `keyframes` for one video: a value with the last kept frame, and a list of frames that wait for the watermark."""

    def __init__(self, min_gap: float, min_diff: float, max_frames: int, waits: bool, ttl_ms: int | None):
        self.min_gap, self.min_diff, self.max_frames, self.waits, self.ttl_ms = min_gap, min_diff, max_frames, waits, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t double, v double, n int", self.ttl_ms)
        self.waiting = handle.getListState("waiting", "key long, t double, v double", self.ttl_ms)

    def kept(self, video: int, rows: list[tuple[int, float, float]]) -> pd.DataFrame:
        last_t, last_v, n = self.last.get() if self.last.exists() else (None, None, 0)
        out = []
        for key, t, v in sorted(rows, key=lambda r: (r[1], r[0])):
            if (not self.max_frames or n < self.max_frames) and (last_t is None or t - last_t >= self.min_gap and abs(v - last_v) >= self.min_diff):
                last_t, last_v, n = t, v, n + 1
                out.append((video, key, n))
        if last_t is not None:
            self.last.update((last_t, last_v, n))
        return pd.DataFrame(out, columns=["video", "key", "ordinal"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(k), float(t), float(v)) for part in rows for k, t, v in zip(part["key"], part["t"], part["v"]) if pd.notna(t) and pd.notna(v)]
        if not self.waits:
            yield self.kept(int(key[0]), new)
            return
        if new:
            self.waiting.appendList(new)
            for second in {int(t // 1) + 1 for _, t, _ in new}:
                self.handle.registerTimer((second + ORIGIN) * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs() / 1000 - ORIGIN
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        rest = [r for r in rows if r[1] >= upto]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        yield self.kept(int(key[0]), [r for r in rows if r[1] < upto])


def keyframe_stream(frames: DataFrame, *, min_gap: float, min_diff: float = 0.0, max_frames: int = 0, late: str | None = None, keep_state: float | None = None) -> DataFrame:
    """STM-04 on a stream of (video long, key long, t double: seconds, v double): kept frames (video, key, ordinal), with state by video.

    With `late`, frames wait until the watermark, which trails the latest time by that
    much, has passed them, and are then taken in time order: the result is that of the
    batch form, whatever the order within `late`; later frames are dropped. Without,
    a micro-batch is taken in time order as it comes. State that isn't touched for
    keep_state seconds goes. Frames without a time or value are not kept. Needs the
    RocksDB state store, which is set unless the session names one.
    """
    non_negative(min_gap=min_gap, min_diff=min_diff, max_frames=max_frames)
    conf, name = frames.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (conf.get(name, "") or ""):
        conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    gate = KeyframeGate(min_gap, min_diff, max_frames, late is not None, None if keep_state is None else int(keep_state * 1000))
    rows = frames.select("video", "key", "t", "v")
    if late is not None:
        rows = rows.withColumn("at", F.timestamp_micros(((F.col("t") + ORIGIN) * 1e6).cast("long"))).withWatermark("at", late)
    mode = "EventTime" if late is not None else "ProcessingTime" if keep_state is not None else "None"
    return rows.groupBy("video").transformWithStateInPandas(gate, "video long, key long, ordinal int", "append", mode)


def run_scheduler(stream: DataFrame, fetch, ledger: Ledger, checkpoint: str):
    """STM-06, SNK-01/05: each micro-batch of (hive, day, time) is fetched by partition and recorded once; position is the checkpoint's.

    fetch(iterator of Pandas frames) yields frames (hive, day, time, status, path,
    reason). A batch that runs again after a break is fetched again, but the ledger
    holds its records once.
    """

    def write(batch: DataFrame, number: int) -> None:
        if not ledger.has(number + 1):
            ledger.write(batch.mapInPandas(fetch, RECORD), number + 1)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_DAY = ["hive", "day"]


def days_left(schedule: DataFrame, records: DataFrame, run: str, *, per_day: int, miss_limit: int) -> tuple[DataFrame, DataFrame]:
    """(days, candidates) of a schedule (position, hive, day, time, place) after the records (`RECORD`, run, place, batch, number).

    days: position, hive, day, room (videos the day may still get), tries (attempts that
    are sure to be made) and left (candidates). Candidates are neither downloaded nor
    unavailable by their last record, nor tried in this run. A day whose attempts in this
    run end with miss_limit misses has no tries left; 0 is no limit.
    """
    last = records.groupBy(*_DAY, "time").agg(F.max_by("status", F.struct("batch", "number")).alias("status"))
    done = last.where(F.col("status").isin("downloaded", "unavailable")).select(*_DAY, "time")
    now = records.where(F.col("run") == run)
    left = schedule.join(done.union(now.select(*_DAY, "time")).distinct(), [*_DAY, "time"], "left_anti")
    had = last.where("status = 'downloaded'").groupBy(*_DAY).agg(F.count(F.lit(1)).alias("had"))
    at = F.struct("batch", "place")
    best = now.groupBy(*_DAY).agg(F.max(F.when(F.col("status") == "downloaded", at)).alias("best"))
    missed = now.join(best, _DAY).where(F.col("best").isNull() | (at > F.col("best"))).groupBy(*_DAY).agg(F.count(F.lit(1)).alias("missed"))
    days = left.groupBy("position", *_DAY).agg(F.count(F.lit(1)).alias("left")).join(had, _DAY, "left").join(missed, _DAY, "left").fillna(0, ["had", "missed"])
    room = F.lit(per_day) - F.col("had")
    tries = F.least(room, F.lit(miss_limit) - F.col("missed")) if miss_limit else room
    return days.select("position", *_DAY, room.alias("room"), tries.alias("tries"), "left").where("tries > 0"), left


def wave(days: DataFrame, candidates: DataFrame, room: int) -> DataFrame:
    """The candidates that a walk day by day is sure to try before `room` videos are there, of the days and candidates left.

    A day is begun only if the days before it can't fill the room, and of its
    candidates the first `tries` are sure; so fetching all of these at once tries
    nothing that one fetch after the other would not.
    """
    most = F.least("room", "left")
    before = F.coalesce(F.sum(most).over(Window.orderBy("position").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # of a block of days
    begun = days.withColumn("before", before).where(F.col("before") < room).select("position", F.least("tries", room - F.col("before")).alias("n"))
    numbered = candidates.join(begun, "position").withColumn("_rn", F.row_number().over(Window.partitionBy("position").orderBy("place")))
    return numbered.where("_rn <= n").drop("_rn", "n")


def walk_schedule(schedule: DataFrame, fetch, ledger: Ledger, state: str, signature: str, *, target: int, per_day: int, miss_limit: int = 0, block: int = 1_000) -> int:
    """STM-06, WIN-10: a schedule (position from 0, hive, day, time, place) from the saved position on, until `target` videos are there; how many are.

    Attempts and records are those of a walk day by day, but each wave of attempts that
    are sure to be made is one distributed fetch (as in `run_scheduler`), a numbered
    batch of the ledger (schema `RECORD` and run string, place int). Of days, a block
    is looked at together. Caps: per_day and target videos, and miss_limit misses
    in a row for a day. The position of the first day that is open is saved before a
    wave, and its end after a block, so a run that breaks off takes its wave up again; a
    schedule that is at its end while videos are missing begins anew in the next run.
    """
    positive(per_day=per_day, block=block)
    non_negative(target=target, miss_limit=miss_limit)
    spark, run = schedule.sparkSession, uuid.uuid4().hex
    end = (schedule.agg(F.max("position")).first()[0] or 0) + 1 if not schedule.isEmpty() else 0
    there = lambda: ledger.records().groupBy(*_DAY, "time").agg(F.max_by("status", F.struct("batch", "number")).alias("s")).where("s = 'downloaded'").count()
    total, batch = there(), ledger.next_batch()
    at = next_day_index(spark, state, signature)
    if at >= end and total < target:
        at = 0
    while at < end and total < target:
        some = schedule.where((F.col("position") >= at) & (F.col("position") < at + block))
        days, left = days_left(some, ledger.records(), run, per_day=per_day, miss_limit=miss_limit)
        first = days.agg(F.min("position")).first()[0]
        if first is None:
            at = min(end, at + block)
            save_state(spark, state, signature, at)
            continue
        at = first
        save_state(spark, state, signature, at)
        tried = wave(days, left, target - total)
        places = tried.select(*_DAY, "time", "place")
        done = tried.select(*_DAY, "time").mapInPandas(fetch, RECORD).join(places, [*_DAY, "time"])
        ledger.write(done.withColumn("run", F.lit(run)), batch)
        batch, total = batch + 1, there()
    return total


def retrying(fetch_one, *, attempts: int = 5, delay: float = 0.0, sleep=None):
    """STM-07: fetch_one with waits of 2 ** attempt up to 60 seconds after passing errors (status 429)."""
    import time

    wait = sleep or time.sleep

    def run(item):
        for k in range(attempts):
            out = fetch_one(item)
            if out.get("code") != 429 or k == attempts - 1:
                return out
            after = out.get("retry_after") or 0
            wait(max(delay, after) if after > 0 else max(delay, min(60.0, 2.0**k)))

    return run


def windowed_counts(events: DataFrame, *, time: str, label: str, width: str, late: str) -> DataFrame:
    """An extension: counts by tumbling window and label, with a watermark for late rows."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), label).agg(F.count(F.lit(1)).alias("n"))
