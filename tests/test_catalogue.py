"""Every query of the catalogue that has SQL, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from framelake.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(rows):
    def one(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "-"
        return f"{x:.6g}" if isinstance(x, float) else str(x)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = con.sql(catalogue.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain(df.select(*want.columns).collect()) == plain(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL) - {"moving_boxes"}))
def test_query_without_sql(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_moving_boxes_of_a_whole_recording(spark):
    """Against the NumPy components of the same masks, on tables with recordings of 20 frames; the two frames of the smallest tables hold no foreground yet."""
    import numpy as np

    from framelake.operators import background, raster
    from framelake.plans import rasters

    sf = SF.replace("0.001", "0.01")
    masks = {}
    for r in background.mask_pixels(rasters.mixture_blocks(spark, sf), by="video", idx="idx").select("idx", "y", "x", "v").collect():
        masks.setdefault(r.idx, np.zeros((rasters.FRAME_AREA // rasters.FRAME_WIDE, rasters.FRAME_WIDE), np.uint8))[r.y, r.x] = r.v
    found = {}
    for r in catalogue.QUERIES["moving_boxes"](spark, sf).collect():
        found.setdefault(r.idx, []).append(((r.first_y, r.first_x), (r.x, r.y, r.w, r.h, r.area)))
    assert {k: [b for _, b in sorted(v)] for k, v in found.items()} == {k: b for k, m in masks.items() if (b := raster.components(m, 4))} and found
    assert catalogue.QUERIES["moving_boxes"](spark, SF).count() == 0 and catalogue.QUERIES["mixture_foreground"](spark, SF).agg({"foreground": "sum"}).first()[0] == 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_background_share_of_every_user(spark, tmp_path):
    """Against a plain running mean and variance; most ids are above those that the tables begin with."""
    from pyspark.sql import functions as F

    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("user_id", F.col("user_id") * 37)
    events.write.parquet(str(tmp_path / "events.parquet"))
    runs = {}
    for r in events.orderBy("event_id").collect():
        runs.setdefault(r.user_id, []).append((r.event_id, [r.value, r.value * 2]))
    want = {}
    for user, rows in runs.items():
        mean, var = list(rows[0][1]), [225.0, 225.0]
        for event, px in rows:
            want[user, event] = sum((x - m) ** 2 > 6.25 * v for x, m, v in zip(px, mean, var)) / 2
            mean = [m + 0.05 * (x - m) for x, m in zip(px, mean)]
            var = [max(4.0, v + 0.05 * ((x - m) ** 2 - v)) for x, m, v in zip(px, mean, var)]
    found = {(r.video, r.idx): r.foreground for r in catalogue.QUERIES["background_share"](spark, str(tmp_path)).collect()}
    assert found == want and max(runs) > 20 and len(set(want.values())) > 1


def test_frame_names_of_long_numbers(spark, tmp_path):
    """Against Python's own format; numbers of more digits than the padding stay whole, and those beyond 32 bits."""
    ids = [0, 7, 999_999, 1_000_000, 1_000_009, 1_999_999, 2_000_001, 5_999_999, 2**31 - 1, 2**31, 2**31 + 1, 2**40 + 1]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(str(tmp_path / "events.parquet"))
    found = catalogue.QUERIES["frame_names"](spark, str(tmp_path)).select("event_id", "frame", "mask", "idx").collect()
    stems = {i: f"frame_{i:06d}_t{i / 2:08.1f}s" for i in ids}
    assert sorted(map(tuple, found)) == [(i, stems[i] + ".jpg", stems[i] + "_mask.png", i) for i in ids]


@pytest.mark.parametrize("types", [None, ["click"]])  # fewer keys than rows wanted: the rest is backfill
def test_first_per_key_of_all_days(spark, tmp_path, types):
    from pyspark.sql import functions as F

    events = spark.read.parquet(f"{SF}/events.parquet")
    events = events.where(F.col("event_type").isin(types)) if types else events
    events.write.parquet(str(tmp_path / "events.parquet"))
    seen, first, rest = set(), [], []
    for r in sorted(events.collect(), key=lambda r: (r.ts, r.event_id)):
        key = r.event_type, r.ts.date()
        (rest if key in seen else first).append((r.event_id, *key, key not in seen))
        seen.add(key)
    found = catalogue.QUERIES["first_per_key_backfill"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == sorted((first + rest)[:200])
    assert max(r.day for r in found).isoformat() > "2024-01-09" and not all(r.is_first for r in found)


def test_coco_ap_of_all_lines(spark):
    """All lines on both sides, against a plain version of the protocol."""
    truth, found, lines = {}, {}, 0
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect():
        key, c, lines = r.l_partkey * 100_000 + r.l_suppkey, {"A": 0, "N": 1}.get(r.l_returnflag, 2), lines + 1
        x, y, w, h = r.l_partkey % 100, r.l_suppkey % 100, int(10 + r.l_quantity), 10 + r.l_linenumber
        truth.setdefault((r.l_orderkey, c), []).append((x, y, w, h))
        found.setdefault((r.l_orderkey, (c + 1) % 3 if key % 11 == 0 else c), []).append((-(float(r.l_discount) + key % 1000 / 100_000), (x + key % 5, y, w, h)))

    def iou(a, b):
        w, h = (max(0, min(a[i] + a[i + 2], b[i] + b[i + 2]) - max(a[i], b[i])) for i in (0, 1))
        return w * h / (a[2] * a[3] + b[2] * b[3] - w * h)

    want = {}
    for c in range(3):
        positives = sum(len(v) for k, v in truth.items() if k[1] == c)
        for t in (round(0.5 + 0.05 * i, 2) for i in range(10)):
            ranked = []
            for (image, category), dets in found.items():
                left = sorted(truth.get((image, category), [])) if category == c else []
                for rank, (score, box) in enumerate(sorted(dets)[:100] if category == c else []):
                    over, i = max(((iou(box, g), i) for i, g in enumerate(left)), default=(0, 0))
                    ranked.append((score, image, rank, over >= t))
                    if over >= t:
                        del left[i]
            tps, curve = 0, []
            for n, (*_, hit) in enumerate(sorted(ranked), 1):
                tps += hit
                curve.append((tps, tps / n))
            for i in range(len(curve) - 2, -1, -1):
                curve[i] = curve[i][0], max(curve[i][1], curve[i + 1][1])
            ap = sum(next((p for k, p in curve if 100 * k >= r * positives), 0) for r in range(101)) / 101
            want[c, t] = positives, pytest.approx(ap, abs=1e-8)
    got = {(r.category_id, r.threshold): (r.positives, r.ap) for r in catalogue.QUERIES["coco_ap"](spark, SF).collect()}
    assert got == want and sum(got[c, 0.5][0] for c in range(3)) == lines and len({ap for _, ap in got.values()}) > 10
