"""Pixel-row operators against the NumPy kernels and plain versions."""

import numpy as np
import pytest

from framelake.operators import graph, pixels, raster
from framelake.plans import catalogue
from framelake.scratch import Scratch


def rows_of(masks):
    return [(k, y, x, int(v)) for k, m in masks.items() for (y, x), v in np.ndenumerate(m)]


@pytest.fixture(scope="module")
def masks():
    rng = np.random.default_rng(4)
    spiral = np.zeros((21, 21), np.uint8)  # one long winding run of rows and columns
    y, x, dy, dx = 10, 10, 0, 1
    for k in range(1, 20):
        for _ in range(k):
            if 0 <= y < 21 and 0 <= x < 21:
                spiral[y, x] = 255
            y, x = y + dy * 1, x + dx * 1
        if k % 2 == 0:
            y, x = y + dy, x + dx
            if 0 <= y < 21 and 0 <= x < 21:
                spiral[y, x] = 255
        dy, dx = dx, -dy
    comb = np.zeros((9, 300), np.uint8)
    comb[:8, ::2] = 255
    comb[8] = 255
    made = {i: np.where(rng.random((rng.integers(1, 20), rng.integers(1, 90))) < p, 255, rng.choice([0, 127])).astype(np.uint8) for i, p in enumerate([0.2, 0.4, 0.5, 0.8, 0.95])}
    blob = np.zeros((40, 50), np.uint8)
    blob[5:33, 8:40] = 255
    return made | {10: spiral, 11: comb, 12: np.full((5, 7), 255, np.uint8), 13: np.zeros((3, 3), np.uint8), 14: blob}


@pytest.fixture(scope="module")
def frame(spark, masks):
    return spark.createDataFrame(rows_of(masks), "raster long, y int, x int, v int")


@pytest.mark.parametrize("min_area", [0, 3])
def test_component_boxes(frame, masks, min_area):
    found = {}
    for r in pixels.component_boxes(frame, raster="raster", min_area=min_area).collect():
        found.setdefault(r.raster, []).append(((r.first_y, r.first_x), (r.x, r.y, r.w, r.h, r.area)))
    for k, m in masks.items():
        assert [b for _, b in sorted(found.get(k, []))] == raster.components(m, min_area), k


def test_components_of_sparse_repeated_and_no_pixels(spark):
    rows = [("a", 0, 0, 255), ("a", 0, 0, 255), ("a", 0, 1, 255), ("a", 1, 2, 255), ("a", 5, 5, 255), (None, 0, 0, 255), ("a", None, 0, 255), ("a", 2, 2, 127)]
    made = spark.createDataFrame(rows, "raster string, y int, x int, v int")
    found = pixels.component_boxes(made, raster="raster").orderBy("first_y").collect()
    assert [tuple(r) for r in found] == [("a", 0, 0, 3, 2, 3, 0, 0), ("a", 5, 5, 1, 1, 1, 5, 5)]
    assert pixels.component_boxes(made.where("v = 1"), raster="raster").collect() == []


def test_graph_of_a_long_path_and_stars(spark):
    rng = np.random.default_rng(1)
    names = rng.permutation(500)
    links = [(0, int(a), int(b)) for a, b in zip(names, names[1:])] + [(1, 7, i) for i in range(20, 60)] + [(1, 3, 4), (2, 9, 8)]
    found = graph.components(Scratch(spark, "t"), spark.createDataFrame(links, "g int, u long, v long"), ["g"]).collect()
    roots = {(r.g, r.node): r.root for r in found}
    assert len(found) == len(roots) == 500 + 41 + 2 + 2
    assert {v for (g, _), v in roots.items() if g == 0} == {0} and {v for (g, _), v in roots.items() if g == 1} == {3, 7} and roots[2, 9] == 8
    assert graph.components(Scratch(spark, "t"), spark.createDataFrame([], "g int, u long, v long"), ["g"]).collect() == []


def test_distances(frame, masks):
    found = {(r.raster, r.y, r.x): r.d for r in pixels.distances(frame, raster="raster").collect()}
    peaks = {r.raster: r for r in pixels.farthest(frame, raster="raster").collect()}
    assert len(found) == sum(m.size for m in masks.values())
    for k, m in masks.items():
        on = m == 255
        if on.all():
            assert all(found[k, y, x] is None for y, x in np.ndindex(*m.shape)) and (peaks[k].y, peaks[k].x, peaks[k].d) == (0, 0, None)
            continue
        want = raster.distance(m)
        assert all(abs(found[k, y, x] - want[y, x]) < 1e-9 for y, x in np.ndindex(*m.shape)), k
        if on.any():
            assert (peaks[k].y, peaks[k].x) == np.unravel_index(int(np.round(want, 6).argmax()), m.shape)
        else:
            assert k not in peaks
    assert (peaks[14].y, peaks[14].x, peaks[14].d) == (18, 21, 14.0)


@pytest.mark.parametrize("tile", [4, 32])
def test_frames_are_scored(spark, tile):
    rng = np.random.default_rng(6)
    shapes = {"a": (17, 33), "b": (1, 5), "c": (2, 2), "d": (9, 1), "e": (8, 8)}
    frames = {(k, i): rng.integers(0, 256, s, dtype=np.uint8) for k, s in shapes.items() for i in range(3)}
    rows = [(*key, y, x, int(v), *m.shape) for key, m in frames.items() for (y, x), v in np.ndenumerate(m)]
    made = spark.createDataFrame(rows, "video string, idx int, y int, x int, v int, h int, w int")
    found = {(r.video, r.idx): r for r in pixels.scored_frames(made, by="video", idx="idx", height=1, width=1, tile=tile).collect()}
    assert found.keys() == frames.keys()
    for (k, i), m in frames.items():
        wide = m.astype(float)
        up, down = (np.pad(wide, ((1, 1), (0, 0)), "edge" if m.shape[0] == 1 else "reflect")[s] for s in (slice(0, -2), slice(2, None)))
        left, right = (np.pad(wide, ((0, 0), (1, 1)), "edge" if m.shape[1] == 1 else "reflect")[:, s] for s in (slice(0, -2), slice(2, None)))
        lap = up + down + left + right - 4 * wide
        assert found[k, i].sharpness == pytest.approx(lap.var()) and found[k, i].brightness == pytest.approx(wide.mean())
        small = [int(np.rint(frames[k, j].mean())) for j in (i - 1, i) if j >= 0]
        assert found[k, i].motion == (None if i == 0 else abs(small[1] - small[0]))


@pytest.mark.parametrize("size", [(3, 4), (5, 7), (10, 12)])
def test_shrunk(spark, size):
    rng = np.random.default_rng(7)
    m = rng.integers(0, 256, (10, 12), dtype=np.uint8)
    rows = [(1, y, x, int(v), 10, 12) for (y, x), v in np.ndenumerate(m)]
    made = spark.createDataFrame(rows, "k int, y int, x int, v int, h int, w int")
    found = np.zeros(size, np.uint8)
    for r in pixels.shrunk(made, by=["k"], height=size[0], width=size[1]).collect():
        found[r.y, r.x] = r.v
    assert (found == raster.as_bytes(np.round(raster.resized_area(m, *size), 9))).all()


def test_plans_have_no_python_worker(spark, frame):
    made = frame.selectExpr("raster as k", "0 as idx", "y", "x", "v", "20 as h", "90 as w")
    for df in (pixels.distances(frame, raster="raster"), pixels.scored_frames(made, by="k", idx="idx"), pixels.runs(frame, raster="raster")):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "SinglePartition" not in plan


def test_components_pass_no_table_through_the_driver(spark, tmp_path, monkeypatch):
    """Files that are small beside what they hold are no side to broadcast, in any round."""
    plans = []
    save = Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, **kw: plans.append(df) or save(self, df, **kw))
    made = spark.range(20_000).selectExpr("id div 2500 raster", "int(id % 2500 div 50) y", "int(id % 50) x", "if(hash(id) % 3 = 0, 0, 255) v")
    out = pixels.component_boxes(made, raster="raster")
    assert out.count() > 8 and len(plans) > 5
    text = [df._jdf.queryExecution().toString() for df in plans[:2]] + [out._jdf.queryExecution().toString()]
    joins = [df._jdf.queryExecution().optimizedPlan().toString() for df in [*plans, out]]
    assert sum(j.count("Join ") for j in joins) > 5 and all("strategy=merge" in line for j in joins for line in j.splitlines() if "Join " in line)
    assert not any("Broadcast" in x for x in text)


@pytest.mark.parametrize("query", ["picked_components", "moving_boxes"])
def test_queries_of_components_pass_no_table_through_the_driver(spark, monkeypatch, query):
    plans = []
    save = Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, **kw: plans.append(df) or save(self, df, **kw))
    rounds = catalogue.QUERIES[query](spark, "/root/testdata/sf0.01")
    found = [line for df in [*plans, rounds] for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert len(found) > 5 and all("strategy=merge" in line for line in found)
