"""Streams with state, the ledger and the walk of a schedule, broken off and taken up again."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from framelake import streaming
from framelake.operators import frames
from framelake.sources import next_day_index
from framelake.streaming.ledger import Ledger

SCHEMA = f"{streaming.RECORD}, run string, place int"


def run_stream(df, tmp_path, name):
    q = df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return q


def test_keyframes_of_rows_out_of_order(spark, tmp_path):
    """Rows come in three files, out of order by less than the lateness; a last file moves the watermark past all."""
    rng = random.Random(2)
    rows = sorted(((v, 1000 * v + i, i * 1.5, float(rng.randrange(9))) for v in range(3) for i in range(60)), key=lambda r: r[2] + rng.random() * 20)
    schema = "video long, key long, t double, v double"
    df = spark.createDataFrame(rows, schema)
    for k in range(3):
        spark.createDataFrame(rows[60 * k : 60 * k + 60], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(9, 1, 1e6, 0.0), (9, 2, None, 1.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run_stream(streaming.keyframe_stream(stream, min_gap=5, min_diff=2, max_frames=8, late="100 seconds"), tmp_path, "out")
    want = frames.keyframes(df, by="video", seconds=F.col("t"), value=F.col("v"), key="key", min_gap=5, min_diff=2, max_frames=8).collect()
    found = spark.read.parquet(str(tmp_path / "out")).where("video < 9").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, want))


def test_state_that_is_kept_for_a_time(spark, tmp_path):
    schema = "video long, key long, t double, v double"
    spark.createDataFrame([(1, i, float(i), float(i)) for i in range(10)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    run_stream(streaming.keyframe_stream(stream, min_gap=3, keep_state=3600), tmp_path, "out")
    assert sorted(r.key for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 3, 6, 9]


def test_a_batch_is_held_once(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"), "k int")
    assert ledger.records().collect() == [] and ledger.next_batch() == 1
    rows = spark.createDataFrame([(1,), (2,)], "k int")
    assert ledger.write(rows, 1) and not ledger.write(rows, 1)
    # What a run that broke off before its entry has left isn't seen, and is replaced.
    spark.createDataFrame([(7,), (8,), (9,)], "k int").write.json(str(tmp_path / "l/records/batch=2"))
    assert sorted(r.k for r in ledger.records().collect()) == [1, 2] and ledger.next_batch() == 2
    assert ledger.write(spark.createDataFrame([(3,)], "k int"), 2)
    assert sorted((r.batch, r.k) for r in ledger.records().collect()) == [(1, 1), (1, 2), (2, 3)]


def test_a_scheduler_stream_that_breaks_off(spark, tmp_path, monkeypatch):
    schema = "hive string, day string, time string"
    for k in range(3):
        spark.createDataFrame([(f"h{k}", "d", f"{i}") for i in range(4)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ledger = Ledger(spark, str(tmp_path / "l"), streaming.RECORD)

    def fetch(parts):
        for p in parts:
            yield p.assign(status="downloaded", path="p", reason=None)

    broken = Ledger(spark, str(tmp_path / "l"), streaming.RECORD)
    calls = []

    def breaks(records, batch):  # writes half of the second batch, and no entry
        calls.append(batch)
        if batch == 2:
            records.limit(2).withColumn("number", F.lit(0)).write.json(f"{ledger.root}/records/batch=2")
            raise OSError("broken off")
        return Ledger.write(broken, records, batch)

    monkeypatch.setattr(broken, "write", breaks)
    with pytest.raises(Exception, match="broken off"):
        streaming.run_scheduler(stream(), fetch, broken, str(tmp_path / "c")).awaitTermination(240)
    assert calls == [1, 2] and ledger.records().count() == 4
    for _ in range(2):  # taken up again; once more changes nothing
        streaming.run_scheduler(stream(), fetch, ledger, str(tmp_path / "c")).awaitTermination(240)
        assert sorted((r.hive, r.time) for r in ledger.records().collect()) == [(f"h{k}", f"{i}") for k in range(3) for i in range(4)]


def made():
    """(outcome of one attempt, fetch of many); inside a function, so that workers needn't import this file."""

    def outcome(hive, day, time):
        return random.Random(f"{hive}{day}{time}").choice(["downloaded", "downloaded", "unavailable", "failed"])

    def fetch(parts):
        for p in parts:
            yield p.assign(status=[outcome(*r) for r in p[["hive", "day", "time"]].itertuples(index=False)], path=None, reason=None)

    return outcome, fetch


outcome, outcomes = made()


def plain_walk(days, statuses, at, *, target, per_day, miss_limit, breaks=None):
    """(attempts of this run, position): one fetch after the other; statuses is changed."""
    total, tried = sum(s == "downloaded" for s in statuses.values()), []
    if at >= len(days) and total < target:
        at = 0
    while at < len(days) and total < target:
        hive, day, times = days[at]
        got, missed = sum(s == "downloaded" for k, s in statuses.items() if k[:2] == (hive, day)), 0
        for time in times:
            if total >= target or got >= per_day or miss_limit and missed >= miss_limit:
                break
            key = (hive, day, time)
            if statuses.get(key) in ("downloaded", "unavailable") or key in tried:
                continue
            statuses[key] = outcome(*key)
            tried.append(key)
            good = statuses[key] == "downloaded"
            total, got, missed = total + good, got + good, 0 if good else missed + 1
        at += 1
    return tried, at


@pytest.mark.parametrize("target, per_day, miss_limit, block", [(17, 3, 2, 4), (1000, 2, 0, 100)])
def test_a_walk_in_waves_is_a_walk_day_by_day(spark, tmp_path, target, per_day, miss_limit, block):
    days = [(f"h{i % 3}", f"d{i // 3}", [f"t{(i * k) % 11}-{k}" for k in range(i % 8)]) for i in range(14)]
    rows = [(i, h, d, t, k) for i, (h, d, times) in enumerate(days) for k, t in enumerate(times)] + [(14, "h", "last", "t", 0)]
    days.append(("h", "last", ["t"]))
    schedule = spark.createDataFrame(rows, "position long, hive string, day string, time string, place int")
    ledger, state = Ledger(spark, str(tmp_path / "l"), SCHEMA), str(tmp_path / "state.json")
    statuses, seen, at = {}, 0, 0
    for n in range(2):  # the second run begins anew if the schedule is at its end
        tried, at = plain_walk(days, statuses, at, target=target, per_day=per_day, miss_limit=miss_limit)
        total = streaming.walk_schedule(schedule, outcomes, ledger, state, "s", target=target, per_day=per_day, miss_limit=miss_limit, block=block)
        records = ledger.records().orderBy("batch").collect()
        runs = list(dict.fromkeys(r.run for r in records))
        own = [(r.hive, r.day, r.time) for r in records if r.run == runs[-1]] if len(records) > seen else []
        assert sorted(own) == sorted(tried) and len(own) == len(set(own))
        assert total == sum(s == "downloaded" for s in statuses.values()) and total <= target
        seen = len(records)
        if target > 1000:
            assert next_day_index(spark, state, "s") == 15


def test_a_walk_that_breaks_off_inside_a_wave(spark, tmp_path, monkeypatch):
    rows = [(i, "h", f"d{i}", f"t{k}", k) for i in range(6) for k in range(5)]
    schedule = spark.createDataFrame(rows, "position long, hive string, day string, time string, place int")
    ledger, state = Ledger(spark, str(tmp_path / "l"), SCHEMA), str(tmp_path / "state.json")
    real, calls = Ledger.write, []

    def breaks(self, records, batch):
        calls.append(batch)
        if len(calls) == 3:
            records.limit(1).withColumn("number", F.lit(0)).write.json(f"{self.root}/records/batch={batch}")
            raise KeyboardInterrupt
        return real(self, records, batch)

    monkeypatch.setattr(Ledger, "write", breaks)
    with pytest.raises(KeyboardInterrupt):
        streaming.walk_schedule(schedule, outcomes, ledger, state, "s", target=9, per_day=3, miss_limit=0, block=2)
    assert ledger.records().count() > 0
    total = streaming.walk_schedule(schedule, outcomes, ledger, state, "s", target=9, per_day=3, miss_limit=0, block=2)
    last = {(r.hive, r.day, r.time): r.status for r in ledger.records().orderBy("batch", "number").collect()}
    by_day = pd.Series([k[1] for k, s in last.items() if s == "downloaded"]).value_counts()
    assert total == 9 == sum(s == "downloaded" for s in last.values()) and by_day.max() <= 3
    keys = [(r.batch, r.hive, r.day, r.time) for r in ledger.records().collect()]
    assert len(keys) == len(set(keys))


def test_waits_between_attempts():
    """STM-07: 429 is tried again after growing waits, or those that the answer names; other answers return."""
    waits, answers = [], [{"code": 429}, {"code": 429, "retry_after": 7}, {"code": 429, "retry_after": 0}, {"code": 200}]
    assert streaming.retrying(lambda item: answers.pop(0), delay=1.5, sleep=waits.append)("x") == {"code": 200} and waits == [1.5, 7, 4.0]
    waits.clear()
    assert streaming.retrying(lambda item: {"code": 429}, attempts=3, sleep=waits.append)("x") == {"code": 429} and waits == [1.0, 2.0]
    assert streaming.retrying(lambda item: {"code": 404}, sleep=waits.append)("x") == {"code": 404} and len(waits) == 2
