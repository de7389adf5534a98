"""Record lines as a data source, documents in one file, and small operators with their errors."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake import sources
from framelake.operators import curate, evaluate, frames, quality, raster, vectors
from framelake.sources import records, sinks


def record(i, status="downloaded", **more):
    return {"status": status, "hive": f"h{i}", "day": "d", "time": "t", "reason": "é" * (i % 5)} | more


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("records")
    lines = [json.dumps(record(i, ["downloaded", "failed", "unavailable"][i % 3])) for i in range(200)]
    lines[7:7] = ["", "{bad", "[1]", json.dumps(record(1, hive=5)), json.dumps(record(1, "gone")), '{"status": "fail\\u0065d", "hive": "esc", "day": "d", "time": "t", "path": [1]}']
    (at / "a.jsonl").write_bytes(("\n".join(lines) + "\n").encode())
    (at / "b.jsonl").write_bytes(json.dumps(record(900, "failed")).encode())  # no line end
    (at / "c.jsonl").write_bytes(b"")
    (at / "_hidden").write_bytes(json.dumps(record(1)).encode())
    return at


def plain(at, status=None):
    out = []
    for file in ("a.jsonl", "b.jsonl"):
        offset = 0
        for line in (at / file).read_bytes().splitlines(keepends=True):
            try:
                r = json.loads(line)
                if isinstance(r, dict) and isinstance(r["hive"], str) and r["status"] in sources.STATUSES and status in (None, r["status"]):
                    out.append((str(at / file), offset, r["status"], r["hive"]))
            except ValueError:
                pass
            offset += len(line)
    return out


@pytest.mark.parametrize("size", [1, 64, 1000, 1 << 20])
def test_lines_in_ranges(spark, folder, size):
    records.register(spark)
    found = spark.read.format("record_lines").option("rangeBytes", max(size, 40)).load(str(folder))
    rows = found.orderBy("file", "offset").collect()
    assert [tuple(r)[:4] for r in rows] == plain(folder)
    assert {r.path for r in rows if r.hive == "esc"} == {"[1]"}
    # Each byte as the border of two ranges.
    if size == 1:
        data = str(folder / "a.jsonl")
        n = (folder / "a.jsonl").stat().st_size
        for cut in range(1, n, 97):
            both = [*records.lines_in(records.Range(data, 0, cut), None), *records.lines_in(records.Range(data, cut, n), None)]
            assert [r[:4] for r in both] == [r for r in plain(folder) if r[0] == data]


def test_a_filter_is_pushed(spark, folder):
    records.register(spark)
    found = spark.read.format("record_lines").load(str(folder)).where("status = 'failed' and hive <> 'h1'")
    assert [tuple(r)[:4] for r in found.orderBy("file", "offset").collect()] == [r for r in plain(folder, "failed") if r[3] != "h1"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hive" in plan.split("Filter")[1].split("\n")[0] and "failed" not in plan.split("Filter")[1].split("\n")[0], plan
    reader = records.RecordReader(str(folder), 100)
    other = records.EqualTo(("hive",), "h1")
    assert list(reader.pushFilters([records.EqualTo(("status",), "failed"), other])) == [other] and reader.status == "failed"


def test_a_stream_of_appended_lines(spark, tmp_path):
    records.register(spark)
    at = tmp_path / "in"
    at.mkdir()

    def run():
        stream = spark.readStream.format("record_lines").option("rangeBytes", 50).load(str(at))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(r.hive for r in spark.read.parquet(str(tmp_path / "out")).collect())

    line = lambda i: json.dumps(record(i)) + "\n"
    (at / "a").write_text(line(1) + line(2) + line(3)[:20])
    assert run() == ["h1", "h2"]
    with (at / "a").open("a") as f:
        f.write(line(3)[20:] + line(4))
    (at / "b").write_text(line(5))
    assert run() == ["h1", "h2", "h3", "h4", "h5"] and run() == ["h1", "h2", "h3", "h4", "h5"]


def test_documents_of_any_size(spark, tmp_path, monkeypatch):
    from framelake.operators import order

    monkeypatch.setattr(order, "SMALL", 100)  # several parts
    images = [{"id": i, "file_name": f"ü{i}.jpg", "license": None} for i in range(1_000)]
    notes = [{"id": i, "image_id": i % 7, "bbox": [1.0, 2.5, i, 4.0]} for i in range(333)]
    rng = random.Random(1)
    frame = lambda rows, schema: spark.createDataFrame(rng.sample([tuple(r.values()) for r in rows], len(rows)), schema).repartition(5)
    made = {
        "categories": spark.createDataFrame([(0, "x")], "id int, name string"), "images": frame(images, "id long, file_name string, license int"),
        "annotations": frame([{**r, "bbox": [float(x) for x in r["bbox"]]} for r in notes], "id long, image_id long, bbox array<double>"), "none": spark.createDataFrame([], "id int"),
    }
    at = tmp_path / "doc.json"
    at.write_text("old")
    sinks.write_document(made, str(at), order={k: ["id"] for k in made})
    assert json.loads(at.read_text()) == {"categories": [{"id": 0, "name": "x"}], "images": images, "annotations": notes, "none": []}
    images_, notes_, kinds = sources.coco(spark, str(at))
    assert images_.count() == 1_000 and notes_.count() == 333 and kinds.count() == 1


def test_counters_of_the_pass_that_writes(spark, tmp_path):
    df = spark.range(100).withColumn("v", F.when(F.col("id") % 10 > 0, F.col("id")))
    rows, seen = frames.observed(df, F.col("v") >= 50, F.col("id") % 4 > 0)
    rows.write.parquet(str(tmp_path / "f"))
    kept = [i for i in range(50, 100) if i % 10]
    assert seen.get == {"sampled": 100, "saved": sum(i % 4 > 0 for i in kept), "skipped_no_object": sum(i % 4 == 0 for i in kept)}
    assert spark.read.parquet(str(tmp_path / "f")).count() == seen.get["saved"]


def test_groups_that_keep_too_few_are_an_error(spark):
    df = spark.createDataFrame([(g, float(i)) for g in ("a", "b", None) for i in range(5)], "g string, v double")
    assert vectors.kept_by(df, by="g", value="v", threshold=2.0).count() == 9
    with pytest.raises(Exception, match="fewer than 3"):
        vectors.kept_by(df, by="g", value="v", threshold=3.0).collect()


def test_tokens_that_fill_no_grid_are_an_error(spark):
    df = spark.createDataFrame([(1, i) for i in range(6)], "g int, i int")
    assert [(r.row, r.col) for r in raster.checked_grid(df, by="g", place="i", rows=2, columns=3).orderBy("i").collect()] == [(i // 3, i % 3) for i in range(6)]
    for wrong in ([(1, i) for i in range(5)], [(1, i % 5) for i in range(6)], [(1, i + 1) for i in range(6)]):
        with pytest.raises(Exception, match="don't fill"):
            raster.checked_grid(spark.createDataFrame(wrong, "g int, i int"), by="g", place="i", rows=2, columns=3).collect()


def test_classes_and_recall(spark):
    rows = [(1, 0, t, 0.9 - i / 10, i, i % 2 == 0, False, 0) for t in (0.5, 0.75) for i in range(4)] + [(1, 0, t, None, -1, False, True, 4) for t in (0.5, 0.75)] + [(1, 1, 0.5, None, -1, False, True, 0)]
    m = spark.createDataFrame(rows, "image_id long, category_id int, threshold double, score double, rank int, tp boolean, ignored boolean, positives long")
    recall = evaluate.average_recall(m)
    assert {(r.category_id, r.threshold): r.recall for r in recall.collect()} == {(0, 0.5): 0.5, (0, 0.75): 0.5, (1, 0.5): None}
    ap = spark.createDataFrame([(0, 0.5, 0.4), (0, 0.75, 0.2), (1, 0.5, None)], "category_id int, threshold double, ap double")
    found = {r.category_id: tuple(r)[1:] for r in evaluate.per_class(ap, recall).collect()}
    assert found == {0: pytest.approx((0.3, 0.4, 0.2, 0.5)), 1: (None, None, None, None)}


def test_small_ones(spark, tmp_path):
    pair = lambda a, b: quality.same_names(spark.createDataFrame([(x,) for x in a], "n string"), spark.createDataFrame([(x,) for x in b], "n string"), "n").first().same
    assert pair("aab", ["b", "a", None]) and not pair("ab", "a") and not pair("a", "b") and pair("", "")
    assert quality.swap_ratio(spark.createDataFrame([(True,), (False,), (True,), (True,)], "swapped boolean")).first().swap_ratio == 0.75
    items = spark.createDataFrame([(i, list(range(i))) for i in range(6)], "i int, a array<int>").select("i", curate.pick_one(F.col("a"), F.col("i")).alias("p")).collect()
    assert all((r.p is None) == (r.i == 0) and (r.p is None or 0 <= r.p < r.i) for r in items)
    rows = spark.range(5)
    assert curate.enough(rows, 5, True).count() == 5 and curate.enough(rows, 9, False).count() == 5
    with pytest.raises(Exception, match="fewer than 6"):
        curate.enough(rows, 6, True).collect()
    px = spark.createDataFrame([(1, 0, x, 100, 10 * x, 7) for x in range(3)], "frame int, y int, x int, c1 int, c2 int, c3 int")
    found = raster.overlay(px, spark.createDataFrame([(1, 0, 1, 255), (1, 0, 2, 0)], "frame int, y int, x int, v int"), alpha=0.5, color=(0, 0, 255)).orderBy("x").collect()
    assert [tuple(r)[3:] for r in found] == [(100, 0, 7), (50, 5, 131), (100, 20, 7)]
    basis = vectors.Basis(np.arange(3.0), np.ones(3), 0.5, np.zeros(3), np.eye(3), np.zeros(3), np.ones(3))
    basis.save(spark, str(tmp_path / "basis"))
    again = vectors.Basis.load(spark, str(tmp_path / "basis"))
    assert all(np.array_equal(getattr(basis, k), getattr(again, k)) for k in basis.__dict__)
    seen = frames.video_metrics(spark.createDataFrame([(1, 2.0, 3.0, None), (1, 4.0, 5.0, 1.5), (2, 1.0, 1.0, None)], "v int, sharpness double, brightness double, motion double"), by="v").orderBy("v").collect()
    assert [tuple(r) for r in seen] == [(1, 3.0, 4.0, 1.5, 7.5), (2, 1.0, 1.0, 0.0, 1.0)]


def test_registry(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "r.yaml").write_text("- {workspace: w, project: p, version: 3}\n- {workspace: w, project: q, note: n}\n")
    assert [tuple(r) for r in sources.registry(spark, str(tmp_path / "r.yaml")).collect()] == [("w", "p", "3", None), ("w", "q", None, "n")]
    (tmp_path / "m.yaml").write_text("workspace: w\n")
    with pytest.raises(ValueError, match="list"):
        sources.registry(spark, str(tmp_path / "m.yaml"))


def test_first_rows_are_no_window(spark):
    df = spark.createDataFrame([(i % 4 if i % 5 else None, i) for i in range(50)], "k int, i int")
    found = curate.first_then_backfill(df, keys=["k"], order=F.col("i"), n=9)
    first = {}
    for i in range(50):
        first.setdefault(i % 4 if i % 5 else None, i)
    want = sorted(first.values()) + [i for i in range(50) if i not in first.values()]
    assert [r.i for r in found.collect()] == want[:9] and "Window" not in found._jdf.queryExecution().toString()
