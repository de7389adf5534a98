"""Media, order and bookkeeping operators against plain models."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framelake import sources
from framelake.functions import checks
from framelake.operators import annotations, curate, frames, order, quality, raster
from framelake.sources import media, sinks


def test_ranks_of_rows_with_a_payload(spark):
    rows = spark.range(0, 60_000, 1, 12).select("id", (F.xxhash64("id") % 1000).alias("v"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 5).alias("payload"))
    found = order.ranked(rows, F.col("v").desc(), F.col("id")).select("id", "v", "rank").collect()
    want = {r.id: k for k, r in enumerate(sorted(found, key=lambda r: (-r.v, r.id)), 1)}
    assert {r.id: r["rank"] for r in found} == want and len(want) == 60_000


@pytest.mark.parametrize("p", [0.0, 0.5, 0.9, 1.0])
def test_percentiles(spark, p):
    rng = np.random.default_rng(2)
    rows = [(str(g), None if i % 50 == 7 else float(x)) for g in (*"abc", None) for i, x in enumerate(rng.integers(0, 40, 200))]
    df = spark.createDataFrame(rows, "g string, x double")
    found = {r.g: r.q for r in order.percentiles(df, "x", p, by=["g"], name="q").collect()}
    assert found == {g: pytest.approx(np.quantile([x for h, x in rows if h == g and x is not None], p)) for g in {g for g, _ in rows}}
    assert order.percentiles(df, "x", p, by=[], name="q").first().q == pytest.approx(np.quantile([x for _, x in rows if x is not None], p))
    with pytest.raises(ValueError):
        order.percentiles(df, "x", 1.5, by=[], name="q")


def test_frames_at(spark):
    rng = np.random.default_rng(1)
    shown = [(int(v), float(t), k) for k, (v, t) in enumerate(zip(rng.integers(0, 3, 200), rng.random(200) * 1000))]
    times = [(v, float(t)) for v in range(4) for t in rng.random(30) * 1100 - 50]
    found = frames.frames_at(spark.createDataFrame(shown, "video long, t double, k long"), spark.createDataFrame(times, "video long, at double"), by="video", seconds="t", at="at", bucket=37.0)
    want = {(v, a): max(((t, k) for w, t, k in shown if w == v and t <= a), default=(None, None))[1] for v, a in times}
    assert {(r.video, r.at): r.k for r in found.collect()} == want and None in want.values()


def test_keyframes_of_arrays(spark):
    rows = [(1, k, float(k), [float(k // 3), 0.0]) for k in range(9)]
    df = spark.createDataFrame(rows, "video long, key long, t double, v array<double>")
    found = frames.keyframes(df, by="video", seconds=F.col("t"), value=F.col("v"), key="key", min_gap=1, min_diff=0.5)
    assert sorted((r.key, r.ordinal) for r in found.collect()) == [(0, 1), (3, 2), (6, 3)]
    with pytest.raises(ValueError):
        frames.keyframes(df, by="video", seconds=F.col("t"), value=F.col("v"), key="key", min_gap=-1)


def test_background_error_ends_one_video(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 2.0]), (1, 1, [1.0]), (1, 2, [1.0, 2.0]), (2, 0, [3.0])], "video long, idx long, pixels array<double>")
    found = frames.background_model(df, by="video", schema="video long, idx long, foreground double, error string").collect()
    assert sorted((r.video, r.idx, r.foreground, r.error is None) for r in found) == [(1, 0, 0.0, True), (1, 1, None, False), (2, 0, 0.0, True)]


def test_lists_of_videos(spark, tmp_path):
    for name in ("b.WEBM", "a.mp4", "c.h264", "d.txt"):
        (tmp_path / name).write_bytes(b"x")
    there = [r.name for r in sources.videos(spark, str(tmp_path)).collect()]
    assert there == ["a.mp4", "b.WEBM"]
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.txt").write_text("x")
    with pytest.raises(ValueError):
        sources.find_videos(spark, str(tmp_path / "empty"))
    assert sources.find_videos(spark, str(tmp_path / "c.h264")).count() == 1 and sources.find_videos(spark, str(tmp_path)).count() == 2
    (tmp_path / "list").write_text("# head\n\n /v/z.mp4 \n/v/a.webm\r\n#x\n/v/m.mp4\n")
    listed = sources.video_list(spark, str(tmp_path / "list"))
    assert [(r.line, r.path) for r in listed.orderBy("line").collect()] == [(2, "/v/z.mp4"), (3, "/v/a.webm"), (5, "/v/m.mp4")]
    files = spark.createDataFrame([("/v/z.mp4",), ("/v/a.webm",), ("/v/m.mp4",), ("/v/x.txt",)], "path string")
    assert sources.checked_list(listed, files).count() == 3
    for bad in (spark.createDataFrame([(0, "/v/none.mp4")], "line int, path string"), spark.createDataFrame([(0, "/v/x.txt")], "line int, path string")):
        with pytest.raises(Exception, match="not found|no video"):
            sources.checked_list(bad, files).collect()


def test_the_last_record_wins(spark, tmp_path):
    key = {"hive": "h", "day": "2025-06-01", "time": "10:00:00"}
    (tmp_path / "m.jsonl").write_text("\n".join(json.dumps(key | {"status": s, "reason": str(i)}) for i, s in enumerate(["failed", "downloaded", "nonsense", "unavailable"])) + "\n{bad\n")
    m = sources.manifest(spark, str(tmp_path / "m.jsonl"))
    assert [r.reason for r in m.orderBy("seq").collect()] == ["0", "1", "3"]
    assert curate.last_write_wins(m, keys=["hive", "day", "time"], value="status", order="seq").first().status == "unavailable"
    for batch, status in enumerate(["failed", "downloaded", "failed", "unavailable", "downloaded"]):
        sinks.append_manifest(spark.createDataFrame([("h", "2025-06-01", "10:00:00", status)], "hive string, day string, time string, status string"), str(tmp_path / "log"), batch)
    log = sources.manifest(spark, str(tmp_path / "log"))
    assert log.count() == 5 and curate.last_write_wins(log, keys=["hive", "day", "time"], value="status", order="seq").first().status == "downloaded"


def test_state_and_downloads(spark, tmp_path):
    at = str(tmp_path / "state.json")
    assert sources.next_day_index(spark, at, "s") == 0
    for n in (3, 5):
        sinks.save_state(spark, at, "s", n)
        assert sources.next_day_index(spark, at, "s") == n and sources.next_day_index(spark, at, "t") == 0
    (tmp_path / "have.mp4").write_bytes(b"old")

    def fetch(path):
        if "bad" in path:
            raise OSError("gone")
        return b"data"

    wanted = spark.createDataFrame([(str(tmp_path / n),) for n in ("have.mp4", "new.mp4", "bad.mp4")], "path string")
    found = {r.path.rpartition("/")[2]: (r.size_bytes, r.status, r.reason) for r in sinks.fetched(wanted, fetch).collect()}
    assert found == {"have.mp4": (3, "downloaded", None), "new.mp4": (4, "downloaded", None), "bad.mp4": (None, "failed", "gone")}
    assert sorted(p.name for p in tmp_path.glob("*.mp4*")) == ["have.mp4", "new.mp4"]


def test_groups_items_and_complete(spark):
    index = spark.createDataFrame([(f"/d/v{v}/frame_{i}.jpg", i) for v in (1, 2) for i in (3, 1, 2)], "frame_path string, frame_idx long")
    found = sources.frame_groups(index, "/d").orderBy("folder", "place").collect()
    assert [(r.folder, r.frame_idx) for r in found] == [(f"/d/v{v}", i) for v in (1, 2) for i in (1, 2, 3)]
    assert sources.frame_groups(index, "/d/v1/").count() == 3
    with pytest.raises(ValueError):
        sources.frame_groups(index, "/none")
    assert sources.item(index, -1, "frame_path").first().frame_path == "/d/v2/frame_3.jpg" and sources.item(index, 0, "frame_path").first().frame_idx == 1
    with pytest.raises(IndexError):
        sources.item(index, 6, "frame_path")
    files = spark.createDataFrame([("/x/a/train/_annotations.coco.json", "_annotations.coco.json"), ("/x/b/other/_annotations.coco.json", "_annotations.coco.json")], "path string, name string")
    assert [r.slug for r in sources.complete(files).collect()] == ["a"]


def test_hub_versions_and_plan(spark):
    doc = "_annotations.coco.json"
    paths = [f"/raw/w__whole/train/{doc}", f"/raw/w__whole/test/{doc}", "/raw/w__whole/other/x", f"/raw/w__half/train/{doc}", "/raw/w__half/valid/1.jpg", f"/raw/w__late/test/{doc}", "/raw/w__gone/train/1.jpg", "x"]
    files = spark.createDataFrame([(p, p.rpartition("/")[2]) for p in paths], "path string, name string")
    assert [r.slug for r in sources.complete(files).collect()] == ["w__whole"]
    versions = spark.createDataFrame([("w", p, i, n, name) for p in ("whole", "half", "late") for i, (n, name) in enumerate([(3, "best"), (2, "b"), (10, "b")])], "workspace string, project string, place int, number int, name string")
    registry = spark.createDataFrame([("w", "whole", None), ("w", "half", "10"), ("w", "late", "b"), ("w", "late", "latest"), ("w", "gone", "1"), ("w", "half", "99999999999999999999"), ("w", "half", "10")], "workspace string, project string, version string")
    chosen = sources.chosen_versions(registry, versions)
    plan = lambda **options: {(r.project, r.version): (r.number, r.name, r.action, r.clean) for r in sources.fetch_plan(chosen, files, **options).collect()}
    missing = (None, None, "fail", True)
    rest = {("gone", "1"): missing, ("half", "99999999999999999999"): missing}
    assert plan() == rest | {("whole", None): (3, "best", "skip", False), ("half", "10"): (10, "b", "get", False), ("late", "b"): (2, "b", "get", False), ("late", "latest"): (3, "best", "get", False)}
    assert plan(overwrite=True) == rest | {("whole", None): (3, "best", "get", True), ("half", "10"): (10, "b", "get", True), ("late", "b"): (2, "b", "get", True), ("late", "latest"): (3, "best", "get", True)}
    assert chosen.count() == 6 and sources.fetch_plan(chosen.where("false"), files).count() == sources.complete(files.where("false")).count() == 0


def test_audit_report(spark):
    images = spark.createDataFrame([("train", "a"), ("train", "b"), ("val", None)], "split string, source string")
    labels = spark.createDataFrame([("train", "a", "x%")] * 7 + [("train", "b", "y"), ("test", "b", "z")], "split string, source string, label string")
    rows = sinks.audit_report(images, labels, ["x%", "y", "none"])
    lines = {(r.section, r.name): r.line for r in rows.collect()}
    assert lines["1 images", "train"] == "  train: 2" and lines["1 images", "test"] == "  test : 0" and lines["2 annotations", "test"] == "  test : 1"
    assert [lines["3 classes", c] for c in ("x%", "y", "none")] == [f"  {c:<6} {n:>6}  {100.0 * n / 8:5.1f}%" for c, n in (("x%", 7), ("y", 1), ("none", 0))]
    assert lines["4 splits", "train"] == "  train: x%=7, y=1, none=0"
    assert lines["5 sources", "b"] == f"  {'b':<48} {1:>7} {2:>7}  {0:>7}  {1:>7}  {0:>7}" and ("5 sources", None) in lines
    empty = sinks.audit_report(images.where("false"), labels.where("false"), ["x%"]).collect()
    assert [tuple(r) for r in empty] == [("3 classes", "x%", f"  {'x%':<6} {0:>6}  {0.0:5.1f}%")]


def test_decoder_probe_and_model(spark):
    def decode(path):
        for k in range(3):
            if path == "b" and k == 2:
                raise ValueError("cut off")
            yield k, k / 2, np.full((2, 3, 3), k, np.uint8)

    videos = spark.createDataFrame([("a",), ("b",)], "path string")
    found = media.decoded(videos, decode, rows_back=2).collect()
    assert sorted((r.video, r.idx if r.idx is not None else -1, r.error) for r in found) == [("a", 0, None), ("a", 1, None), ("a", 2, None), ("b", -1, "cut off"), ("b", 0, None), ("b", 1, None)]
    probe = lambda p: {"fps": 0, "frames": 60, "w": 4, "h": 2} if p == "a" else {}[p]
    found = {r.path: r for r in media.probed(videos, probe).collect()}
    assert (found["a"].fps, found["a"].duration, found["a"].error) == (30.0, 2.0, None) and found["b"].error
    sizes = []

    def load():
        return lambda rows: pd.DataFrame({"n": [len(rows)] * len(rows)})

    sizes = [r.n for r in media.batched(spark.range(0, 70, 1, 1).toDF("id"), load, "n long", size=32).collect()]
    assert sorted(sizes) == [6] * 6 + [32] * 64


def test_catalogue(spark):
    answers = {"u/hives": ["h 1", "h2"], "u/hives/h 1/days": ["6/1/2025"], "u/hives/h2/days": {"no": "list"}, "u/hives/h 1/days/2025-06-01/times": ["3:04:00 pm", "10:00:00"]}
    with media.Catalogue(spark, answers.__getitem__, "u") as c:
        days = c.days(c.hives()).cache()
        assert [(r.hive, r.day, r.error is None) for r in days.orderBy("hive").collect()] == [("h 1", "2025-06-01", True), ("h2", None, False)]
        found = c.videos(c.times(days)).orderBy("time").collect()
    assert [(r.time, r.url) for r in found] == [("10:00:00", "u/h%201%402025-06-01%4010-00-00.mp4"), ("15:04:00", "u/h%201%402025-06-01%4015-04-00.mp4")]


def test_zip_renumber_and_sizes(spark):
    df = spark.createDataFrame([(1, [1, 2], ["a", "b"]), (2, [3], ["c"])], "k int, a array<int>, b array<string>")
    assert [(p.x, p.y) for r in df.select(annotations.zipped(F.col("a"), F.col("b"), ("x", "y")).alias("z")).collect() for p in r.z] == [(1, "a"), (2, "b"), (3, "c")]
    with pytest.raises(Exception, match="different lengths"):
        spark.createDataFrame([(1, [1, 2], ["a"])], df.schema).select(annotations.zipped(F.col("a"), F.col("b"), ("x", "y"))).collect()
    images = spark.createDataFrame([(9, "b"), (7, "a"), (8, "b")], "image_id long, split string")
    notes = spark.createDataFrame([(8, 1), (7, 2), (7, 1), (9, 5)], "image_id long, note long")
    i, n = annotations.renumbered(images, notes, part="split", image="image_id", annotation="note")
    assert {r.image_id: r.new_image_id for r in i.collect()} == {7: 1, 8: 2, 9: 3} and [(r.image_id, r.note) for r in n.orderBy("new_id").collect()] == [(7, 1), (7, 2), (8, 1), (9, 5)]
    back = spark.createDataFrame([("v", 10, 10), ("w", 5, 9)], "f string, w int, h int")
    shown = spark.createDataFrame([("v", "b", 99, 99), ("v", "a", 10, 10), ("w", "a", 5, 10)], "f string, p string, w int, h int")
    assert {r.f: (r.first_frame, r.too_small) for r in annotations.background_sizes(back, shown, by="f", path="p", width="w", height="h").collect()} == {"v": ("a", False), "w": ("a", True)}


def test_swapped_background_by_area():
    image, mask = np.zeros((2, 2, 3), np.uint8), np.array([[0, 127], [255, 0]], np.uint8)
    background = np.repeat(np.arange(16, dtype=np.uint8).reshape(4, 4, 1), 3, 2)
    found = raster.swapped(image, mask, background)
    assert found[..., 0].tolist() == [[2, 0], [0, 12]]  # 2.5 and 12.5, half to even
    crop, classes = raster.swapped_crop(np.full((8, 8, 3), 9, np.uint8), np.full((8, 8), 255, np.uint8), np.zeros((8, 8, 3), np.uint8), -2, -2, 4, 2)
    assert crop.tolist() == np.full((2, 2, 3), 9).tolist() and classes.tolist() == [[255, 255], [255, 255]]
    assert raster.from_unit(np.array([[[1.0]], [[0.5]], [[-1.0]]])).tolist() == [[[255, 127, 0]]]


def test_frame_metrics(spark):
    rng = np.random.default_rng(4)
    shown = [("v", k, rng.integers(0, 256, (130, 170, 3), np.uint8)) for k in range(3)] + [("w", 0, rng.integers(0, 256, (64, 64), np.uint8))]
    df = spark.createDataFrame([(v, k, *x.shape[:2], 3 if x.ndim == 3 else 1, bytearray(x.tobytes())) for v, k, x in shown], "video string, idx long, h int, w int, c int, pixels binary")
    found = {(r.video, r.idx): r for r in raster.frame_metrics(df, by="video").collect()}
    small = None
    for v, k, x in shown:
        g = raster.gray(x)
        now = raster.as_bytes(raster.resized_area(g, 120, 160))
        r = found[v, k]
        assert (r.sharpness, r.brightness) == (pytest.approx(raster.laplacian_variance(g)), pytest.approx(g.mean())) and np.allclose(r.signature, raster.signature(x).ravel())
        assert r.motion == (pytest.approx(np.abs(now.astype(int) - small.astype(int)).mean()) if k else None)
        small = now
    wide = np.pad(g.astype(float), 4, "reflect")
    x = np.arange(9) - 4
    kernel = np.exp(-(x**2) / (2 * (0.3 * 3 + 0.8) ** 2))
    kernel = np.outer(kernel, kernel) / kernel.sum() ** 2
    assert np.allclose(raster.blurred(g)[5, 7], (wide[5:14, 7:16] * kernel).sum())


def test_crop_metrics(spark):
    mask = np.zeros((32, 32), np.uint8)
    mask[8:24, 8:24] = 2
    image, original = np.full((32, 32, 3), 100, np.uint8), np.full((32, 32, 3), 90, np.uint8)
    rows = [(1, True, 32, *(bytearray(x.tobytes()) for x in (mask, image, original))), (2, True, 32, *(bytearray(x.tobytes()) for x in (mask * 0 + 2, image, original)))]
    found = {r.key: r for r in quality.crop_metrics(spark.createDataFrame(rows, "key long, swapped boolean, size int, mask binary, image binary, original binary")).collect()}
    r = found[1]
    assert (r.coverage, r.swap_diff, r.background_std, r.luminance, r.background_luminance) == (0.25, 10.0, 0.0, 100.0, 100.0) and 8 < r.center_x < 24
    assert found[2].swap_diff is None and found[2].coverage == 1.0


def test_checks():
    checks.positive(a=1)
    for bad in (lambda: checks.positive(a=0), lambda: checks.non_negative(a=-1), lambda: checks.in_range(0, 1, a=2), lambda: checks.positive(a=float("nan"))):
        with pytest.raises(ValueError):
            bad()


def test_allowed_requested_and_order(spark):
    df = spark.createDataFrame([("a", 3), ("b", 1), ("a", 2), (None, 0)], "k string, o int")
    assert curate.allowed(df, "k", " a ,").count() == 2 and curate.allowed(df, "k", " , ").count() == 4 and curate.allowed(df, "k", None).count() == 4
    assert sorted((r.k or "", r.o) for r in curate.distinct_in_order(df, ["k"], ["o"]).collect()) == [("", 0), ("a", 2), ("b", 1)]
    assert {r.k: r.place for r in curate.requested(df, ["z", "b", "a", "b"], "k").collect()} == {"b": 1, "a": 2}


def test_reports(spark, tmp_path):
    ranked = spark.createDataFrame([(1, "v", 1.0, 2.0, 3.0, "h")], "rank int, video string, sharpness double, motion double, brightness double, hive_id string")
    assert sinks.ranked_report(ranked).first().line == f"{1:>4}  {'v':<55}  {1:>8.2f}  {2:>8.3f}  {3:>8.2f}  h"
    sinks.probe_report(spark.createDataFrame([("a", None), ("b", "broken")], "path string, errors string"), str(tmp_path / "r"))
    assert {r.path: r.errors for r in spark.read.json(str(tmp_path / "r")).collect()} == {"a": None, "b": "broken"}
    shown = spark.createDataFrame([("v", 1, bytearray(b"x"), bytearray(b"y"))], "video string, frame_idx long, p binary, q binary")
    assert [(r.variant, bytes(r.pixels)) for r in sinks.video_variants(shown, {"one": F.col("p"), "two": F.col("q")}).collect()] == [("one", b"x"), ("two", b"y")]


def test_picks_of_other_groups(spark):
    import hashlib

    h = lambda x: hashlib.md5(f"s|{x}".encode()).hexdigest()
    for pool in ([(g, 10 * g + i) for g in range(5) for i in range(g)], [(1, 7), (1, 8)], [(2, 9)], []):
        items = [(i, i % 7) for i in range(200)]
        found = annotations.other_group_pick(spark.createDataFrame(items, "i long, g long"), spark.createDataFrame(pool, "g long, c long"), group="g", item="i", choice="c", seed="s")
        order = sorted(pool, key=lambda p: h(p[1]))
        for r in found.collect():
            usable = [c for g, c in order if g != r.g] or [c for _, c in order]
            assert r.background == (usable[int(h(r.i)[:8], 16) % len(usable)] if usable else None)
