"""Operators against exact cases and plain Python or NumPy models."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framelake import sources
from framelake.functions import names, numbers
from framelake.operators import annotations, curate, evaluate, frames, quality, raster, vectors
from framelake.sources import sinks


def test_components_cases():
    m = np.zeros((100, 100), np.uint8)
    m[10:40, 10:40] = m[60:90, 60:90] = m[5:7, 5:7] = 255
    assert raster.components(m, 50) == [(10, 10, 30, 30, 900), (60, 60, 30, 30, 900)]
    assert raster.components(m, 1000) == []
    assert raster.components(np.full((3, 3), 127, np.uint8)) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.booleans(), min_size=7, max_size=7), min_size=1, max_size=7))
def test_components_flood(cells):
    on = np.array(cells)
    todo, found = {tuple(p) for p in np.argwhere(on)}, []
    while todo:
        seen, stack = set(), [min(todo)]
        while stack:
            y, x = stack.pop()
            if (y, x) in todo:
                todo.remove((y, x))
                seen.add((y, x))
                stack += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        ys, xs = zip(*seen)
        found.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(seen)))
    assert sorted(raster.components(np.where(on, 255, 0).astype(np.uint8))) == sorted(found)


def test_mask_kernels():
    assert raster.mask_classes(np.array([[0, 127, 255], [255, 0, 127]], np.uint8)).tolist() == [[0, 1, 2], [2, 0, 1]]
    assert raster.normalised_mask(np.array([0, 100, 127, 128, 255], np.uint8)).tolist() == [0, 0, 127, 255, 255]
    image, mask = np.zeros((100, 100, 3), np.uint8), np.zeros((100, 100), np.uint8)
    image[40:60, 40:60] = (255, 0, 0)
    mask[40:60, 40:60] = 255
    crop = raster.swapped(image, mask, np.full((50, 50, 3), 50, np.uint8))[30:70, 30:70]
    assert (crop[10:30, 10:30] == (255, 0, 0)).all() and (crop[0] == 50).all()
    assert (raster.resized_area(np.arange(16.0).reshape(4, 4), 2, 2) == [[2.5, 4.5], [10.5, 12.5]]).all()
    assert raster.cropped(image, -2, -2, 4).shape == (4, 4, 3) and raster.laplacian_variance(np.full((5, 5), 9)) == 0
    assert raster.motion(np.array([0], np.uint8), np.array([255], np.uint8)) == 255


def test_crop_center():
    m = np.zeros((32, 32), np.uint8)
    m[11:21, 11:21] = 255
    for seed in range(20):
        x, y, px, py = raster.crop_center(m, 8, np.random.default_rng(seed))
        assert 4 <= x < 28 and 4 <= y < 28 and 13 <= px <= 18 and 13 <= py <= 18
    for bad, size in ((np.zeros((32, 32), np.uint8), 8), (m, 40)):
        with pytest.raises(ValueError):
            raster.crop_center(bad, size, np.random.default_rng(0))


def test_mask_rows(spark):
    m = np.zeros((4, 4), np.uint8)
    m[1:3, 1:3] = 255
    masks = spark.createDataFrame([(1, bytearray(m.tobytes()), 4, 4), (2, bytearray(16), 4, 4), (3, None, 4, 4)], "key long, mask binary, h int, w int")
    assert [tuple(r) for r in raster.mask_components(masks).collect()] == [(1, 1, 1, 2, 2, 4)]
    assert [r.key for r in raster.with_components(masks).collect()] == [1]


def test_names(spark):
    rows = [("h-1@2025-06-01@12-30-00.mp4",), ("bad",), (None,), ("a@2025-13-01@00-00-00",)]
    r = spark.createDataFrame(rows, "n string").select(names.parse_video_name(F.col("n")).alias("p")).collect()
    assert (r[0].p.hive, str(r[0].p.day), r[0].p.time) == ("h-1", "2025-06-01", "12:30:00") and r[1].p is None and r[2].p is None and r[3].p.day is None
    one = spark.range(1).select(
        names.url_of_source(F.lit("/x/media//a.h264"), "http://h/", "media/").alias("url"), names.url_of_source(F.lit("none"), "b", "media/").alias("no"), names.percent_encoded(F.lit("a b~*+")).alias("enc"),
        names.frame_name(F.lit(3), F.lit(12.25)).alias("frame"), names.stem(F.lit("/a/b.c.jpg")).alias("stem"), names.parse_time(F.lit("3:04:05 pm")).alias("t"), names.parse_date(F.lit("6/1/2025")).alias("d"),
        names.download_destination(F.lit("/d/x.mp4"), F.lit(False), F.lit("n")).alias("file"), names.download_destination(F.lit("/d"), F.lit(False), F.lit("n")).alias("dir"),
        names.retry_after_seconds(F.lit("12"), F.current_timestamp()).alias("wait"), names.float_list(F.lit("0.1, ,0.5")).alias("floats"), names.threshold_name(F.lit("f"), F.lit(0.25)).alias("thr"),
    ).first()
    assert (one.url, one.no, one.enc, one.frame, one.stem, one.t, str(one.d)) == ("http://h/a.mp4", None, "a%20b~%2A%2B", "frame_000003_t000012.2s.jpg", "b.c", "15:04:05", "2025-06-01")
    assert (one.file, one.dir, one.wait, one.floats, one.thr) == ("/d/x.mp4", "/d/n", 12.0, [0.1, 0.5], "f_t025")


def test_buckets(spark):
    for n, k in ((1, 3), (5, 1), (7, 3), (10, 4), (3, 8)):
        rows = spark.createDataFrame([("h", f"{i:02d}:00:00") for i in range(n)], "hive string, time string")
        got = curate.interleaved(rows, by=["hive"], time="time", k=k, seed="s").orderBy("time").collect()
        want = [0] * n if k <= 1 or n <= 1 else [next(b for b in range(k) if b * n // k <= i < (b + 1) * n // k) for i in range(n)]
        assert [r.bucket for r in got] == want and sorted(r.place for r in got) == list(range(1, n + 1))


@pytest.mark.parametrize("cap", [0, 3])
def test_keyframes(spark, cap):
    rng = np.random.default_rng(1)
    rows = [(int(v), k, float(t), float(x), bool(o)) for k, (v, t, x, o) in enumerate(zip(rng.integers(0, 5, 200), rng.integers(0, 100, 200), rng.random(200) * 10, rng.random(200) > 0.2))]
    df = spark.createDataFrame(rows, "video long, key long, t double, v double, ok boolean")
    got = {(r.video, r.key): r.ordinal for r in frames.keyframes(df, by="video", seconds=F.col("t"), value=F.col("v"), key="key", min_gap=5, min_diff=1, max_frames=cap, usable=F.col("ok")).collect()}
    want = {}
    for video in range(5):
        last, n = None, 0
        for _, k, t, v, ok in sorted((r for r in rows if r[0] == video), key=lambda r: (r[2], r[1])):
            if ok and (not cap or n < cap) and (last is None or t - last[0] >= 5 and abs(v - last[1]) >= 1):
                last, n = (t, v), n + 1
                want[video, k] = n
    assert got == want


def test_keyframe_stream(spark, tmp_path):
    from framelake.streaming import keyframe_stream

    rows = [(v, 100 * v + i, float(i * 3 % 50), float(i % 7)) for v in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "video long, key long, t double, v double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = keyframe_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), min_gap=5, min_diff=1, max_frames=6)
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = frames.keyframes(df, by="video", seconds=F.col("t"), value=F.col("v"), key="key", min_gap=5, min_diff=1, max_frames=6)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {tuple(r) for r in batch.collect()}


def test_pca_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6)) * [5, 3, 2, 1, 0.5, 0.1] + 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    b = vectors.fit_basis(df, vector="v", quantile=0.8)
    axis = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][0]
    axis = axis if np.mean((x @ axis) ** 3) >= 0 else -axis
    assert np.allclose(b.axis_a, axis, atol=1e-6) and np.isclose(b.threshold, np.quantile(x @ axis, 0.8))
    front = x[x @ axis >= b.threshold]
    three = np.linalg.svd(front - front.mean(0), full_matrices=False)[2][:3]
    assert np.allclose(np.abs((b.axes_b * three).sum(1)), 1, atol=1e-6)
    lo, hi = np.percentile(front @ b.axes_b.T, [1, 99], axis=0)
    assert np.allclose(b.lo, lo) and np.allclose(b.hi, hi)
    out = vectors.apply_basis(df, b, vector="v").collect()
    assert sum(r.foreground for r in out) == len(front) and all(0 <= r.r <= 1 for r in out)
    with pytest.raises(ValueError):
        vectors.fit_basis(df.limit(3), vector="v")


def test_average_precision(spark):
    truth = spark.createDataFrame([(1, 0, [0.0, 0.0, 10.0, 10.0], 100.0, 0), (1, 0, [20.0, 0.0, 10.0, 10.0], 100.0, 0), (2, 0, [0.0, 0.0, 10.0, 10.0], 100.0, 0), (2, 0, [50.0, 0.0, 10.0, 10.0], 100.0, 1)], "image_id long, category_id int, bbox array<double>, area double, iscrowd int")
    kind = "image_id long, category_id int, bbox array<double>, score double"
    perfect = spark.createDataFrame([(r.image_id, 0, r.bbox, 0.9 - i / 10) for i, r in enumerate(truth.where("iscrowd = 0").collect())], kind)
    assert evaluate.summary(evaluate.average_precision(evaluate.matched(truth, perfect))).first().ap == pytest.approx(1.0)
    mixed = spark.createDataFrame([(1, 0, [0.0, 0.0, 10.0, 10.0], 0.9), (1, 0, [0.0, 0.0, 10.0, 10.0], 0.8), (2, 0, [0.0, 0.0, 10.0, 10.0], 0.7), (2, 0, [51.0, 0.0, 9.0, 10.0], 0.95)], kind)
    ap = evaluate.average_precision(evaluate.matched(truth, mixed)).where("threshold = 0.5").first()
    # places 1 and 3 of 3 that count are right, of 3 truths: 34 points at 1 and 33 at 2/3
    assert ap.positives == 3 and ap.ap == pytest.approx((34 + 33 * 2 / 3) / 101)
    none = evaluate.average_precision(evaluate.matched(truth.where("iscrowd = 1"), mixed)).first()
    assert none.ap is None


def test_sources_and_sinks(spark, tmp_path):
    d = tmp_path / "v1"
    d.mkdir()
    for n in ("frame_000002_t000001.0s.jpg", "frame_000002_t000001.0s_mask.png", "frame_000010_t000002.0s.jpg", "background.png", "note.txt"):
        (d / n).write_bytes(b"x" * 3)
    files = sources.listing(spark, str(tmp_path))
    assert [(r.video_id, r.frame_id) for r in sources.samples(files).collect()] == [("v1", "frame_000002_t000001.0s")]
    assert [r.frame_idx for r in sources.frame_index(files).orderBy("frame_idx").collect()] == [2, 10] and sources.backgrounds(files).count() == 1
    s = frames.summary(sources.frame_index(files), spark.createDataFrame([("v1",), ("v2",)], "video string")).orderBy("video").collect()
    assert [(r.frame_count, r.total_bytes) for r in s] == [(2, 6), (0, 0)]
    ok = {"status": "failed", "hive": "h", "day": "d", "time": "t"}
    lines = [json.dumps(ok), "not json", "[1]", json.dumps({**ok, "hive": None}), json.dumps({**ok, "status": "odd"}), json.dumps({**ok, "status": "downloaded"})]
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    m = sources.manifest(spark, str(tmp_path / "m.jsonl"))
    assert m.count() == 2 and curate.last_write_wins(m, keys=["hive", "day", "time"], value="status", order="seq").first().status == "downloaded"
    (tmp_path / "l.txt").write_text("# head\n\n /a.mp4 \n/b.mp4\n")
    assert [r.path for r in sources.video_list(spark, str(tmp_path / "l.txt")).orderBy("line").collect()] == ["/a.mp4", "/b.mp4"]
    doc = {"images": [{"id": 1, "file_name": "a"}], "annotations": [{"id": 1, "image_id": 1, "category_id": 2, "bbox": [0, 0, 1, 1]}], "categories": [{"id": 2, "name": "bee"}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    assert [t.count() for t in sources.coco(spark, str(tmp_path / "c.json"))] == [1, 1, 1]
    assert sources.next_day_index(spark, str(tmp_path / "none.json"), "s") == 0
    (tmp_path / "state.json").write_text('{"signature": "s", "next_day_index": 4}')
    assert sources.next_day_index(spark, str(tmp_path / "state.json"), "s") == 4 and sources.next_day_index(spark, str(tmp_path / "state.json"), "other") == 0
    ranked = spark.createDataFrame([(2, "/b"), (1, "/a")], "rank int, path string")
    sinks.curated_list(ranked, str(tmp_path / "list"), "best")
    assert [r.value for r in spark.read.text(str(tmp_path / "list")).collect()] == ["# best", "/a", "/b"]


def test_merge_and_quality(spark):
    images = spark.createDataFrame([(1,), (2,), (3,)], "image_id long")
    notes = annotations.bucketed(spark.createDataFrame([(1, "Worker bee"), (1, "pollen"), (2, "pollen")], "image_id long, name string"), "name")
    kept_images, kept = annotations.merged(images, notes)
    assert [r.image_id for r in kept_images.collect()] == [1] and [r.bucket for r in kept.collect()] == ["worker"]
    assert annotations.dropped_classes(notes, "name").first().n == 2
    rows = spark.createDataFrame([(1, 16.0, 0.5, None, 9.0, 40.0, 50.0, True), (2, 0.0, 0.99, 9.0, 9.0, 1.0, 50.0, False)], "k int, center_x double, coverage double, swap_diff double, background_std double, luminance double, background_luminance double, swapped boolean")
    failed = {r.rule: r.failed for r in quality.failures(quality.rule_rows(rows, "k", quality.crop_rules(32))).collect()}
    assert failed == {"centering": 1, "coverage": 1, "swap_diff": 1, "background_std": 0, "luminance": 1, "background_luminance": 0}
    assert annotations.class_label(F.lit(-1), F.array(F.lit("a"), F.lit("b"))) is not None
    ids = annotations.reassigned_ids(spark.createDataFrame([("b", 1), ("a", 5), ("a", 2)], "p string, i int"), part="p", order=["i"], name="n").collect()
    assert {(r.p, r.i): r.n for r in ids} == {("a", 2): 1, ("a", 5): 2, ("b", 1): 3}


def test_even_indices(spark):
    for n in (1, 2, 6, 7, 23):
        got = spark.range(1).select(numbers.even_indices(F.lit(n), 6).alias("i")).first().i
        assert got == (list(range(n)) if n <= 6 else [round(i * (n - 1) / 5) for i in range(6)])


def test_crops(spark):
    from framelake.operators.crops import CropRule, crops

    image, mask = np.full((64, 64, 3), 200, np.uint8), np.zeros((64, 64), np.uint8)
    mask[24:40, 24:40] = 255
    rows = [(0, "v1", "a", bytearray(image.tobytes()), bytearray(mask.tobytes()), 64, 64), (1, "v1", "b", bytearray(image.tobytes()), bytearray(64 * 64), 64, 64), (2, "v1", "c", None, None, 64, 64)]
    items = spark.createDataFrame(rows, "idx long, video_id string, frame_id string, frame binary, mask binary, h int, w int")
    pool = spark.createDataFrame([("v2", bytearray(b"\x32" * (32 * 32 * 3)), 32, 32)], "video_id string, frame binary, h int, w int")
    run = lambda **k: {r.idx: r for r in crops(items, pool, CropRule(size=32, **k)).collect()}
    one = run(swap_probability=1.0)
    assert one[0].swapped and set(bytes(one[0].image)) == {200, 50} and set(bytes(one[0].classes)) == {0, 2} and one[0].peak == [16, 16]
    assert one[1].error == "no component" and one[2].error
    assert not run(swap_probability=0.0)[0].swapped and one == run(swap_probability=1.0)
    assert len({tuple(run(epoch=e)[0].bbox) for e in range(6)}) > 1


def test_frame_time_and_class_range(spark):
    d = spark.createDataFrame([(0, 25.0, -1), (10, 25.0, 0), (45, 30.0, 2), (50, 25.0, 3)], "idx long, fps double, category_id int")
    kept = evaluate.in_classes(d, 3).select("idx", frames.frame_time(F.col("idx"), F.col("fps")).alias("t")).collect()
    assert sorted((r.idx, r.t) for r in kept) == [(10, 0.4), (45, 1.5)]
