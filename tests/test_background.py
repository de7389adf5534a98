"""The background mixture against one that goes over pixels and modes one by one."""

import numpy as np
import pytest

from framelake.operators import background, raster


class PlainPixel:
    """One pixel's modes as a list of [weight, variance, mean], the heaviest first."""

    def __init__(self, rule):
        self.rule, self.modes, self.frames = rule, [], 0

    def see(self, x):
        r = self.rule
        self.frames += 1
        rate = 1 / min(2 * self.frames, r.history)
        least, fits, is_background, total = rate * r.penalty, None, False, 0.0
        kept = []
        for mode in self.modes:
            mode[0] = (1 - rate) * mode[0] - least
            if fits is None:
                off = sum((a - b) ** 2 for a, b in zip(x, mode[2]))
                if total < r.background_share and off < r.background_distance * mode[1]:
                    is_background = True
                if off < r.mode_distance * mode[1]:
                    fits = mode
                    before = mode[0]
                    mode[0] += rate
                    step = rate / mode[0]
                    mode[2] = [m + step * (a - m) for m, a in zip(mode[2], x)]
                    mode[1] = min(r.most_variance, max(r.least_variance, mode[1] + step * (off - mode[1])))
                    total += before
                    kept.append(mode)
                    continue
            total += mode[0]
            if mode[0] >= least:
                kept.append(mode)
        whole = sum(m[0] for m in kept)
        for m in kept:
            m[0] /= whole
        if fits is None:
            if len(kept) == r.modes:
                kept.pop()
            for m in kept:
                m[0] *= 1 - rate
            fits = [rate if kept else 1.0, r.first_variance, list(x)]
            kept.append(fits)
        self.modes = sorted(kept, key=lambda m: (-m[0], m is not fits))
        if is_background:
            return 0
        return 127 if r.shadows and self.is_shadow(x) else 255

    def is_shadow(self, x):
        total = 0.0
        for weight, variance, mean in self.modes:
            size, along = sum(m * m for m in mean), sum(a * m for a, m in zip(x, mean))
            if size == 0:
                return False
            if self.rule.darkest * size <= along <= size:
                part = along / size
                if sum((part * m - a) ** 2 for a, m in zip(x, mean)) < self.rule.background_distance * variance * part * part:
                    return True
            total += weight
            if total > self.rule.background_share:
                return False
        return False

    def background(self):
        total, out = 0.0, [0.0] * len(self.modes[0][2])
        for weight, _, mean in self.modes:
            out = [o + weight * m for o, m in zip(out, mean)]
            total += weight
            if total > self.rule.background_share:
                break
        return [o / total for o in out]


def recording(rng, n, high, wide, channels):
    still = rng.integers(60, 180, (high, wide, channels))
    for i in range(n):
        frame = still + rng.integers(-3, 4, still.shape)
        if i % 3:
            frame[i % high : i % high + 3, i % wide : i % wide + 4] = rng.integers(0, 256, channels)
        if i % 7 == 6:
            frame[: high // 2] = frame[: high // 2] * 0.7
        yield np.clip(frame, 0, 255)


@pytest.mark.parametrize("channels, modes", [(1, 5), (3, 3), (1, 1)])
def test_mixture_by_pixel(channels, modes):
    rng = np.random.default_rng(channels)
    rule = background.Rule(modes=modes, history=20)
    own, plain = background.Mixture(rule, 60, channels), [PlainPixel(rule) for _ in range(60)]
    for frame in recording(rng, 60, 6, 10, channels):
        x = frame.reshape(-1, channels).astype(float)
        assert own.see(x).tolist() == [p.see(v) for p, v in zip(plain, x.tolist())]
        assert np.allclose(own.background(), [p.background() for p in plain])
    assert own.weight.shape == (modes, 60)


@pytest.fixture(scope="module")
def frames():
    rng = np.random.default_rng(9)
    return {(v, i): f for v, n in (("a", 12), ("b", 5)) for i, f in enumerate(recording(rng, n, 13, 11, 2))}


@pytest.mark.parametrize("blur, tile", [(1, 5), (5, 4), (3, 32)])
def test_frames_in_tiles(spark, frames, blur, tile):
    """Masks come from blurred frames, the background from sharp ones, whatever the tiles."""
    rows = [(v, i, y, x, int(f[y, x, 0]), int(f[y, x, 1]), 13, 11) for (v, i), f in frames.items() for y in range(13) for x in range(11)]
    rows.append((None, 1, 0, 0, 1, 1, 13, 11))
    made = spark.createDataFrame(rows, "video string, idx int, y int, x int, r int, g int, h int, w int").repartition(7)
    rule = background.Rule(history=10)
    blocks = background.background_blocks(made, by="video", idx="idx", channels=["r", "g"], rule=rule, blur=blur, tile=tile).cache()
    masks, backs = {}, {}
    for r in background.mask_pixels(blocks, by="video", idx="idx").collect():
        masks.setdefault((r.video, r.idx), np.full((13, 11), -1))[r.y, r.x] = r.v
    for r in background.background_pixels(blocks, by="video", channels=2).collect():
        backs.setdefault(r.video, np.full((13, 11, 2), -1))[r.y, r.x, r.channel - 1] = r.v
    counts = {(r.video, r.idx): r for r in background.shares(blocks, by="video", idx="idx").collect()}
    for v in "ab":
        soft, sharp = background.Mixture(rule, 143, 2), background.Mixture(rule, 143, 2)
        for (video, i), f in frames.items():
            if video == v:
                seen = np.stack([raster.as_bytes(raster.blurred(f[:, :, c], blur)) for c in range(2)], 2) if blur > 1 else f
                mask = soft.see(seen.reshape(-1, 2).astype(float))
                sharp.see(f.reshape(-1, 2).astype(float))
                assert (masks[v, i].ravel() == mask).all()
                assert tuple(counts[v, i])[2:] == ((mask == 255).sum(), (mask == 127).sum(), 143)
        assert (backs[v].reshape(-1, 2) == raster.as_bytes(sharp.background())).all()
    with pytest.raises(ValueError, match="odd"):
        background.background_blocks(made, by="video", idx="idx", channels=["r"], blur=2)


def test_the_sharp_model_keeps_an_edge(spark):
    """Both models are fed; the one without blur keeps a sharp edge."""
    rows = [("v", i, y, x, 200 if x >= 8 else 0, 12, 16) for i in range(12) for y in range(12) for x in range(16)]
    made = spark.createDataFrame(rows, "video string, idx int, y int, x int, v int, h int, w int")
    blocks = background.background_blocks(made, by="video", idx="idx", channels=["v"], blur=5, tile=6)
    values = {r.v for r in background.background_pixels(blocks, by="video").collect()}
    assert values == {0, 200}


def test_a_recording_that_changes_in_size_starts_anew(spark):
    rows = [("v", i, y, x, 50, h, 4) for i, h in enumerate((4, 4, 6)) for y in range(h) for x in range(4)]
    made = spark.createDataFrame(rows, "video string, idx int, y int, x int, v int, h int, w int")
    found = background.shares(background.background_blocks(made, by="video", idx="idx", channels=["v"], blur=1), by="video", idx="idx").orderBy("idx").collect()
    assert [r.pixels for r in found] == [16, 16, 24] and [r.shadow for r in found] == [16, 0, 24]
    assert background.background_blocks(made.where("idx > 9"), by="video", idx="idx", channels=["v"]).collect() == []
