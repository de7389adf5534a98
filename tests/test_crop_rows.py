"""Crops, sizes, blurs and heat maps of pixel rows against the NumPy kernels and plain versions."""

import numpy as np
import pytest

from framelake.operators import crop_rows, quality, raster

RGB = ["r", "g", "b"]


def frame_of(spark, images, names="v"):
    """Rows (k, y, x, channels, h, w) of images by key."""
    rows = [(k, y, x, *np.atleast_1d(im[y, x]).tolist(), *im.shape[:2]) for k, im in images.items() for y in range(im.shape[0]) for x in range(im.shape[1])]
    return spark.createDataFrame(rows, "k long, y int, x int, " + ", ".join(f"{c} int" for c in names) + ", h int, w int")


def image_of(rows, names, key="k"):
    found = {}
    for r in rows:
        found.setdefault(r[key], {})[r.y, r.x] = [r[c] for c in names]
    whole = {}
    for k, px in found.items():
        h, w = max(y for y, _ in px) + 1, max(x for _, x in px) + 1
        assert len(px) == h * w
        whole[k] = np.array([[px[y, x] for x in range(w)] for y in range(h)]).squeeze(-1) if len(names) == 1 else np.array([[px[y, x] for x in range(w)] for y in range(h)])
    return whole


@pytest.fixture(scope="module")
def grays():
    rng = np.random.default_rng(1)
    return {i: rng.integers(0, 256, s).astype(np.uint8) for i, s in enumerate([(1, 1), (1, 9), (7, 1), (2, 3), (20, 13), (33, 40)])}


@pytest.mark.parametrize("h, w", [(1, 1), (5, 4), (17, 50)])
def test_sizes(spark, grays, h, w):
    rows = frame_of(spark, grays)
    near = image_of(crop_rows.resized_nearest(rows, by=["k"], channels=["v"], height=h, width=w).collect(), ["v"])
    area = image_of(crop_rows.resized_area(rows, by=["k"], channels=["v"], height=h, width=w).collect(), ["v"])
    for k, im in grays.items():
        assert (near[k] == raster.resized_nearest(im, h, w)).all(), k
        exact = raster.resized_area(im, h, w)
        assert (np.abs(area[k] - exact) <= 0.5 + 1e-9).all(), k


def test_padded(spark, grays):
    found = crop_rows.padded(frame_of(spark, grays), by=["k"], channels=["v"], high=8, wide=6).collect()
    made = image_of(found, ["v"])
    for k, im in grays.items():
        h, w = im.shape
        want = np.pad(im, ((0, -h % 8), (0, -w % 6)), "reflect") if min(h, w) > 1 else np.pad(im, ((0, -h % 8), (0, -w % 6)), "edge" if h == w == 1 else "reflect")
        assert (made[k] == want).all() and {(r.h, r.w) for r in found if r.k == k} == {want.shape}, k


@pytest.mark.parametrize("tile", [4, 32])
def test_blurred(spark, grays, tile):
    made = image_of(crop_rows.blurred(frame_of(spark, grays), by=["k"], tile=tile).collect(), ["v"])
    for k, im in grays.items():
        assert made[k].shape == im.shape and (np.abs(made[k] - raster.blurred(im)) <= 0.52).all(), k
    assert sum(crop_rows.blur_weights(9)) == crop_rows.BLUR_UNIT
    with pytest.raises(ValueError):
        crop_rows.blurred(frame_of(spark, grays), by=["k"], size=4)


def test_swapped_crops_and_measures(spark):
    rng = np.random.default_rng(2)
    images = {k: rng.integers(0, 256, (15, 22, 3)).astype(np.uint8) for k in (1, 2)}
    masks = {k: rng.choice([0, 127, 255], (15, 22), p=[0.2, 0.1, 0.7]).astype(np.uint8) for k in (1, 2)}
    backs = {1: rng.integers(0, 256, (15, 22, 3)).astype(np.uint8), 2: rng.integers(0, 256, (6, 31, 3)).astype(np.uint8)}
    windows = [(10, 1, 3, 2, 9), (11, 1, -4, -5, 12), (12, 2, 18, 11, 10), (13, 2, 40, 40, 5), (14, 2, 0, 0, 15)]
    wanted = spark.createDataFrame([(*w, 15, 22) for w in windows], "crop long, k long, x1 int, y1 int, size int, h int, w int")
    extra = frame_of(spark, images, RGB).selectExpr("*", "0 AS mask", "0 AS _s0")  # columns that clash
    crops = crop_rows.swapped_crops(extra, frame_of(spark, masks).withColumnRenamed("v", "mask"), frame_of(spark, backs, RGB), wanted, by=["k"], crop="crop", channels=RGB, output=8)
    rows = crops.collect()
    new, own, mask = image_of(rows, RGB, "crop"), image_of(rows, [f"{c}_own" for c in RGB], "crop"), image_of(rows, ["mask"], "crop")
    packed = []
    for crop, k, x1, y1, size in windows:
        image, small = raster.swapped_crop(images[k], masks[k], backs[k], x1, y1, size, 8)
        plain = raster.reference_crop(images[k], x1, y1, size, 8)
        # Means that lie between two numbers may be rounded otherwise in binary fractions.
        assert np.abs(new[crop] - image.astype(int)).max() <= 1 and (new[crop] != image).mean() < 0.05 and (mask[crop] == small).all()
        assert np.abs(own[crop] - plain.astype(int)).max() <= 1 and (own[crop] != plain).mean() < 0.05
        packed.append((crop, True, 8, raster.mask_classes(mask[crop]).astype(np.uint8).tobytes(), new[crop].astype(np.uint8).tobytes(), own[crop].astype(np.uint8).tobytes()))
    byte_rows = spark.createDataFrame([(c, s, n, bytearray(m), bytearray(i), bytearray(o)) for c, s, n, m, i, o in packed], "key long, swapped boolean, size int, mask binary, image binary, original binary")
    want = {r.key: r for r in quality.crop_metrics(byte_rows).collect()}
    found = {r.crop: r for r in crop_rows.crop_measures(crops, crop="crop", channels=RGB).collect()}
    assert found.keys() == want.keys()
    for c, r in found.items():
        for name in ("center_x", "center_y", "coverage", "swap_diff", "background_std", "luminance", "background_luminance"):
            assert r[name] == (None if want[c][name] is None else pytest.approx(want[c][name], abs=0.02)), (c, name)


def cubic(grid, new):
    """One axis of the public cubic enlargement with repeated edges."""
    n, out = len(grid), []
    for q in range(new):
        s = (q + 0.5) * n / new - 0.5
        f = int(np.floor(s))
        taps = [abs(s - (f + d)) for d in (-1, 0, 1, 2)]
        a = -0.75
        w = [(a + 2) * u**3 - (a + 3) * u**2 + 1 if u <= 1 else a * u**3 - 5 * a * u**2 + 8 * a * u - 4 * a for u in taps]
        out.append(sum(wi * grid[min(max(f + d, 0), n - 1)] for wi, d in zip(w, (-1, 0, 1, 2))))
    return np.array(out)


def test_heatmaps(spark):
    rng = np.random.default_rng(3)
    groups = {1: rng.random(1), 2: rng.random(9), 3: rng.random(49), 4: np.full(4, 0.5)}
    rows = [(k, p, float(v)) for k, vs in groups.items() for p, v in enumerate(vs)] + [(None, 0, 1.0), (2, None, 1.0)]
    made = spark.createDataFrame(rows, "k long, p int, s double")
    found = image_of(crop_rows.heatmaps(made, by="k", place="p", value="s", height=10, width=13, clip=False).collect(), ["v"])
    kept = image_of(crop_rows.heatmaps(made, by="k", place="p", value="s", height=10, width=13).collect(), ["v"])
    for k, vs in groups.items():
        g = vs.reshape(round(len(vs) ** 0.5), -1)
        want = cubic(cubic((g - g.min()) / (g.max() - g.min() + 1e-6), 10).T, 13).T
        assert found[k] == pytest.approx(want, abs=1e-9) and kept[k] == pytest.approx(want.clip(0, 1), abs=1e-9)
    odd = made.where("k = 3 and p < 40")
    assert crop_rows.heatmaps(odd, by="k", place="p", value="s", height=3, width=3, strict=False).count() == 9
    for bad, strict in ((odd, True), (made.where("k = 2 and p <> 1"), False), (made.where("k = 2").union(made.where("k = 2 and p = 4")), True)):
        with pytest.raises(Exception, match="no square"):
            crop_rows.heatmaps(bad, by="k", place="p", value="s", height=3, width=3, strict=strict).collect()


def test_empty_tables(spark, grays):
    none = frame_of(spark, grays).where("k < 0")
    assert crop_rows.blurred(none, by=["k"]).count() == crop_rows.padded(none, by=["k"], channels=["v"], high=2, wide=2).count() == 0
    assert crop_rows.resized_area(none, by=["k"], channels=["v"], height=2, width=2).count() == crop_rows.heatmaps(none, by="k", place="x", value="v", height=2, width=2).count() == 0


def test_enlarged(spark):
    rows = [(k, p, p * 10 + k) for k in (1, 2) for p in range(6)]
    made = spark.createDataFrame(rows, "k long, p int, v int")
    found = image_of(crop_rows.enlarged(made, by="k", place="p", rows=2, columns=3, channels=["v"], height=4, width=7).collect(), ["v"])
    for k in (1, 2):
        assert (found[k] == raster.resized_nearest(np.arange(6).reshape(2, 3) * 10 + k, 4, 7)).all()
    with pytest.raises(Exception, match="fill a grid"):
        crop_rows.enlarged(made.where("p < 5"), by="k", place="p", rows=2, columns=3, channels=["v"], height=4, width=7).collect()
