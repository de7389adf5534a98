"""STM-01: background models of recordings: mixtures of Gaussians for each pixel that adapt to what they see.

A pixel has up to `modes` Gaussians, the heaviest first. A frame decays their
weights; the first mode that lies near the pixel's value takes it in and moves
towards it, and without one a mode is born, in place of the lightest if there are
enough. A value is background if it lies near one of the modes that make up the
background's share of the weights. Of the rest, a darker version of such a mode is
shadow. This is the published adaptive mixture with a penalty on the number of
modes (Zivkovic 2004, Zivkovic and van der Heijden 2006) with the public defaults.

A recording has two models: one sees blurred frames and gives the masks, the other
sees them as they are and gives the background, which stays sharp. Frames are cut
into tiles with the border that the blur needs. A tile of a recording is a group:
its frames are streamed in order past a state of constant size, so that a recording
is spread over as many tasks as it has tiles, however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions.checks import in_range, positive
from framelake.operators.pixels import TILE, tiled
from framelake.operators.raster import FOREGROUND, SHADOW, as_bytes, gaussian


@dataclass(frozen=True)
class Rule:
    """Parameters; the values are the public defaults."""

    modes: int = 5
    history: int = 500
    #: Squared distances, in variances, within which a value is background, and within which a mode takes it in.
    background_distance: float = 16.0
    mode_distance: float = 9.0
    #: Of the weights, from the heaviest mode on.
    background_share: float = 0.9
    first_variance: float = 15.0
    least_variance: float = 4.0
    most_variance: float = 75.0
    #: What each mode loses in a frame, in parts of the learning rate.
    penalty: float = 0.05
    #: How dark a shadow may be.
    darkest: float = 0.5
    shadows: bool = True

    def __post_init__(self):
        positive(modes=self.modes, history=self.history, background_distance=self.background_distance, mode_distance=self.mode_distance, first_variance=self.first_variance)
        in_range(0, 1, background_share=self.background_share, penalty=self.penalty, darkest=self.darkest)


class Mixture:
    """The modes of some pixels, sorted by weight: weight and variance (mode, pixel), mean (mode, pixel, channel)."""

    def __init__(self, rule: Rule, pixels: int, channels: int):
        self.rule, self.frames = rule, 0
        self.weight, self.variance, self.mean = np.zeros((rule.modes, pixels)), np.zeros((rule.modes, pixels)), np.zeros((rule.modes, pixels, channels))

    def see(self, x: np.ndarray) -> np.ndarray:
        """The mask of a frame x (pixel, channel), after which the modes have moved."""
        r = self.rule
        self.frames += 1
        rate = 1 / min(2 * self.frames, r.history)
        least = rate * r.penalty
        there = self.weight > 0
        weight = np.where(there, (1 - rate) * self.weight - least, 0)
        off = ((x - self.mean) ** 2).sum(2)
        takes = there & (off < r.mode_distance * self.variance)
        hit, first = takes.any(0), takes.argmax(0)
        asked = there & (~hit | (np.arange(r.modes)[:, None] <= first))
        before = np.cumsum(weight, 0) - weight
        background = (asked & (before < r.background_share) & (off < r.background_distance * self.variance)).any(0)

        at = np.flatnonzero(hit)
        m = first[at]
        weight[m, at] += rate
        step = rate / weight[m, at]
        self.mean[m, at] += step[:, None] * (x[at] - self.mean[m, at])
        self.variance[m, at] = np.clip(self.variance[m, at] + step * (off[m, at] - self.variance[m, at]), r.least_variance, r.most_variance)
        moved = np.zeros(there.shape, bool)
        moved[m, at] = True
        weight[there & (weight < least)] = 0
        total = weight.sum(0)
        weight /= np.where(total > 0, total, 1)

        at = np.flatnonzero(~hit)
        count = (weight[:, at] > 0).sum(0)
        m = np.minimum(count, r.modes - 1)
        weight[:, at] *= 1 - rate
        weight[m, at] = np.where((count == 0) | (r.modes == 1), 1, rate)
        self.mean[m, at], self.variance[m, at], moved[m, at] = x[at], r.first_variance, True

        order = np.lexsort((~moved, -weight), axis=0)  # of equal weights, the one that moved is first
        self.weight, self.variance = np.take_along_axis(weight, order, 0), np.take_along_axis(self.variance, order, 0)
        self.mean = np.take_along_axis(self.mean, order[:, :, None], 0)
        mask = np.where(background, 0, FOREGROUND).astype(np.uint8)
        if r.shadows:
            mask[~background & self.shadow(x)] = SHADOW
        return mask

    def shadow(self, x: np.ndarray) -> np.ndarray:
        """Whether each value is a darker version of a background mode."""
        r = self.rule
        size, along = (self.mean**2).sum(2), (self.mean * x).sum(2)
        asked = (self.weight > 0) & (np.cumsum(self.weight, 0) - self.weight <= r.background_share) & ~np.logical_or.accumulate((self.weight > 0) & (size == 0), 0)
        part = along / np.where(size > 0, size, 1)
        near = ((part[:, :, None] * self.mean - x) ** 2).sum(2) < r.background_distance * self.variance * part**2
        return (asked & (along <= size) & (along >= r.darkest * size) & near).any(0)

    def background(self) -> np.ndarray:
        """The mean (pixel, channel) of the modes that make up the background, by weight."""
        used = (self.weight > 0) & (np.cumsum(self.weight, 0) - self.weight <= self.rule.background_share)
        share = np.where(used, self.weight, 0)
        return (share[:, :, None] * self.mean).sum(0) / share.sum(0)[:, None]


def blurred(tile: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """The inner part of a tile (y, x, channel), blurred along both axes, as bytes."""
    n = len(kernel)
    for axis in (0, 1):
        size = tile.shape[axis] - n + 1
        tile = sum(k * tile.take(range(i, i + size), axis) for i, k in enumerate(kernel))
    return as_bytes(tile)


def background_blocks(frames: DataFrame, *, by: str, idx: str, channels: list[str], rule: Rule = Rule(), blur: int = 9, tile: int = TILE) -> DataFrame:
    """(by, idx, top, left, high, wide, foreground, shadow, mask, background) of each tile of whole frames (by, idx, y, x, channels, h, w).

    foreground and shadow: counts of pixels; mask: a value for each pixel; background:
    values of the sharp model, with the last frame of a tile only, else null. A blur of
    1 is none. Frames without a recording or a number are left out. Where a tile's
    frames change in size, its models start anew.
    """
    if blur % 2 == 0 or blur < 1:
        raise ValueError("blur must be odd")
    border, kernel, c = blur // 2, gaussian(blur), len(channels)
    rows = frames.where(F.col(by).isNotNull() & F.col(idx).isNotNull())
    rows = tiled(rows, by=[by, idx], tile=tile, border=border, value=F.array(*[F.col(x).cast("int") for x in channels]))
    whole = rows.groupBy(by, idx, "_ty", "_tx").agg(F.sort_array(F.collect_list(F.struct("y", "vals"))).alias("_rows"))  # a tile and its borders
    whole = whole.select(by, "_ty", "_tx", idx, F.transform("_rows", lambda r: r["vals"]).alias("vals"))
    kinds = {k: frames.schema[k].dataType.simpleString() for k in (by, idx)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size, waits = None, None, []

        def sent(with_background: bool) -> pa.RecordBatch:
            key, i, mask = waits.pop()
            last = as_bytes(sharp.background()).ravel() if with_background else None
            values = [key[0], i, key[1] * tile, key[2] * tile, *size[:2], int((mask == FOREGROUND).sum()), int((mask == SHADOW).sum()), mask, last]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kind)], names=names)

        for batch in batches:
            kind = (batch.schema.field(0).type, batch.schema.field(3).type, *[pa.int32()] * 4, *[pa.int64()] * 2, *[pa.list_(pa.int16())] * 2)
            for k in range(batch.num_rows):
                key = tuple(batch.column(n)[k].as_py() for n in range(3))
                lines = batch.column(4).slice(k, 1).flatten()
                x = lines.flatten().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lines), -1, c)
                inner = x[border : x.shape[0] - border, border : x.shape[1] - border]
                if waits:
                    yield sent(key != now)
                if key != now or inner.shape != size:
                    masks, sharp = (Mixture(rule, inner.shape[0] * inner.shape[1], c) for _ in range(2))
                now, size = key, inner.shape
                mask = masks.see((blurred(x, kernel) if border else inner).reshape(-1, c).astype(np.float64))
                sharp.see(inner.reshape(-1, c))
                waits.append((key, batch.column(3)[k].as_py(), mask))
        if waits:
            yield sent(True)

    names = [by, idx, "top", "left", "high", "wide", "foreground", "shadow", "mask", "background"]
    schema = f"`{by}` {kinds[by]}, `{idx}` {kinds[idx]}, top int, left int, high int, wide int, foreground long, shadow long, mask array<short>, background array<short>"
    keys = [by, "_ty", "_tx"]
    return whole.repartition(*keys).sortWithinPartitions(*keys, idx).mapInArrow(run, schema)


def _cells(blocks: DataFrame, by: list[str], name: str, channels: int) -> DataFrame:
    values = blocks.select(*by, "top", "left", "wide", F.posexplode(name).alias("_i", "v"))
    n = F.floor(F.col("_i") / channels)
    placed = values.select(*by, (F.col("top") + F.floor(n / F.col("wide"))).cast("int").alias("y"), (F.col("left") + n % F.col("wide")).cast("int").alias("x"), (F.col("_i") % channels + 1).cast("int").alias("channel"), F.col("v").cast("int").alias("v"))
    return placed if channels > 1 else placed.drop("channel")


def mask_pixels(blocks: DataFrame, *, by: str, idx: str) -> DataFrame:
    """(by, idx, y, x, v): the masks as pixel rows."""
    return _cells(blocks, [by, idx], "mask", 1)


def background_pixels(blocks: DataFrame, *, by: str, channels: int = 1) -> DataFrame:
    """SNK-09: (by, y, x, v), with channel if there are several: the last background of each recording as pixel rows."""
    return _cells(blocks.where("background is not null"), [by], "background", channels)


def shares(blocks: DataFrame, *, by: str, idx: str) -> DataFrame:
    """(by, idx, foreground, shadow, pixels): counts of each frame."""
    return blocks.groupBy(by, idx).agg(F.sum("foreground").alias("foreground"), F.sum("shadow").alias("shadow"), F.sum(F.col("high").cast("long") * F.col("wide")).alias("pixels"))
