"""Matches of detections and truths against a plain version."""

import numpy as np
import pyarrow as pa
import pytest

from framelake.operators import evaluate

TRUTH, FOUND = "image_id long, category_id int, bbox array<double>, area double, iscrowd int", "image_id long, category_id int, bbox array<double>, score double"


def plain(truths, dets, at, lo, hi):
    """(score, hit, ignored) of an image and class at a threshold, as in the public protocol; truths: (bbox, area, crowd)."""
    gts = sorted((bool(c or a < lo or a > hi), b, bool(c)) for b, a, c in truths)
    used, out = set(), []
    for score, (x, y, w, h) in sorted(((s, b) for b, s in dets), key=lambda r: (-r[0], r[1]))[:5]:
        best, place = at, None
        for i, (ignored, (gx, gy, gw, gh), crowd) in enumerate(gts):
            if i in used and not crowd or place is not None and not gts[place][0] and ignored:
                continue
            both = max(0, min(x + w, gx + gw) - max(x, gx)) * max(0, min(y + h, gy + gh) - max(y, gy))
            over = both / (w * h if crowd else w * h + gw * gh - both)
            if over >= best:
                best, place = over, i
        if place is not None:
            used.add(place)
        out.append((score, place is not None, gts[place][0] if place is not None else not lo <= w * h <= hi))
    return out


def boxes():
    rng = np.random.default_rng(3)
    truths, dets = {}, {}
    for image in range(40):
        for c in range(2):
            half = 0.5 if image % 2 else 0.0
            box = lambda: [float(v) + half for v in (rng.integers(0, 12), rng.integers(0, 12), rng.integers(20, 60), rng.integers(20, 60))]  # noqa: B023, E731
            ts = [(b, b[2] * b[3], int(rng.random() < 0.2)) for b in (box() for _ in range(rng.integers(0, 10)))]
            ds = [(b, float(rng.integers(0, 50)) / 50) for b in [*(t[0] for t in ts[:3]), *(box() for _ in range(rng.integers(0, 6)))]]
            truths[image, c], dets[image, c] = ts, ds
    return truths, dets


@pytest.mark.parametrize("area", ["all", "medium"])
def test_a_row_for_each_detection_as_in_a_plain_version(spark, area):
    truths, dets = boxes()
    t = spark.createDataFrame([(*k, *r) for k, rs in truths.items() for r in rs], TRUTH)
    d = spark.createDataFrame([(*k, *r) for k, rs in dets.items() for r in rs], FOUND)
    rows = evaluate.matched(t, d, area=area, max_dets=5).collect()
    lo, hi = evaluate.AREAS[area]
    got = {}
    for r in rows:
        if r["rank"] >= 0:
            got.setdefault((r.image_id, r.category_id), []).append(r)
    # One row holds all thresholds: ten would be written, sorted and summed for each detection.
    assert sum(map(len, got.values())) == sum(min(len(v), 5) for v in dets.values())
    for k, v in dets.items():
        for i, threshold in enumerate(evaluate.THRESHOLDS):
            have = [(r.score, bool(r.tp >> i & 1), bool(r.ignored >> i & 1)) for r in sorted(got.get(k, []), key=lambda r: r["rank"])]
            assert have == plain(truths[k], v, threshold, lo, hi), (k, threshold)
    positives = {c: sum(not (crowd or a < lo or a > hi) for k, v in truths.items() if k[1] == c for _, a, crowd in v) for c in range(2)}
    assert {c: sum(r.positives for r in rows if r.category_id == c) for c in range(2)} == positives
    spread = evaluate.by_threshold(evaluate.matched(t, d, area=area, max_dets=5))
    recall = {(r.category_id, r.threshold): r.recall for r in evaluate.average_recall(spread).collect()}
    hits = sum(h and not s for k, v in dets.items() if k[1] == 0 for _, h, s in plain(truths[k], v, 0.5, lo, hi))
    assert len(recall) == 20 and recall[0, 0.5] == pytest.approx(hits / positives[0])


def test_groups_that_cross_batches_and_keys_that_are_null():
    rows = [(1, 0, 0), (1, 0, 4), (1, 1, 4), (2, 0, 0), (2, 0, 0), (2, 0, 4), (2, 0, 4), (None, 0, 0), (None, 0, 4)]
    table = pa.table({n: pa.array(c, t) for n, c, t in zip(("image", "category", "kind"), zip(*rows), (pa.int64(), pa.int32(), pa.int32()))})
    for size in range(1, 10):
        parts = list(evaluate._whole_groups(iter(table.to_batches(size))))
        assert pa.concat_tables(parts).combine_chunks() == table
        starts = np.cumsum([0, *map(len, parts)])[1:-1]
        assert set(starts) <= {2, 3, 7, 8}
    assert np.flatnonzero(evaluate._starts(*(c.combine_chunks() for c in table.columns))).tolist() == [0, 2, 3, 7, 8]


def test_precision_over_many_blocks_and_parts(spark):
    rng = np.random.default_rng(5)
    n, positives = 30_000, 12_000
    score, tp = rng.permutation(n) / n, rng.random(n) < 0.35
    full = (1 << 10) - 1
    rows = [(0, i, float(s), 0, full if h else 0, 1 if i % 9 == 0 else 0, 0) for i, (s, h) in enumerate(zip(score, tp))] + [(0, None, None, -1, 0, full, positives), (1, None, None, -1, 0, full, 0)]
    kind = "category_id int, image_id long, score double, rank int, tp int, ignored int, positives long"
    found = {(r.category_id, r.threshold): r.ap for r in evaluate.average_precision(spark.createDataFrame(rows, kind).repartition(8)).collect()}
    for threshold, kept in ((0.5, np.arange(n) % 9 > 0), (0.95, np.ones(n, bool))):
        hits = tp[kept][np.argsort(-score[kept])]
        tps = np.cumsum(hits)
        precision = np.maximum.accumulate((tps / np.arange(1, len(tps) + 1))[::-1])[::-1]
        places = [np.searchsorted(tps * 100, r * positives) if r else 0 for r in range(101)]
        want = sum(precision[p] for p in places if p < len(tps)) / 101
        assert found[0, threshold] == pytest.approx(want, abs=1e-12)
    assert found[1, 0.5] is None and len(found) == 20
