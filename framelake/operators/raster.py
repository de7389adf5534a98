"""Raster kernels in NumPy, and the Arrow functions that run them on binary columns.

Rasters are row-major bytes with their height and width beside them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of masks: shadow and foreground, and the classes they become.
SHADOW, FOREGROUND = 127, 255


def components(mask: np.ndarray, min_area: int = 0) -> list[tuple[int, int, int, int, int]]:
    """IMG-07: (x, y, w, h, area) of the 8-connected strict foreground, in the order of their first pixel.

    Runs of each row are united with the runs they touch in the row above.
    """
    runs: list[tuple[int, int, int]] = []
    parent: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    above: list[int] = []
    for y, line in enumerate(mask == FOREGROUND):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], line.astype(np.int8), [0]))))
        here = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            me = len(runs)
            runs.append((y, a, b))
            parent.append(me)
            here.append(me)
            for other in above:
                if runs[other][1] <= b and a <= runs[other][2]:  # diagonal neighbours touch
                    i, j = sorted((root(me), root(other)))
                    parent[j] = i
        above = here
    boxes: dict[int, list[int]] = {}
    for i, (y, a, b) in enumerate(runs):
        box = boxes.setdefault(root(i), [a, y, b, y + 1, 0])
        box[:] = [min(box[0], a), min(box[1], y), max(box[2], b), max(box[3], y + 1), box[4] + b - a]
    return [(x1, y1, x2 - x1, y2 - y1, n) for _, (x1, y1, x2, y2, n) in sorted(boxes.items()) if n >= min_area]


def distance(mask: np.ndarray) -> np.ndarray:
    """Chamfer distance (5 x 5) of the strict foreground to the nearest other pixel."""
    near, diagonal, knight = 1.0, 1.4, 2.1969  # fixed values of the public 5 x 5 weights
    h, w = mask.shape
    d = np.full((h + 4, w + 4), 1e9)
    d[2:-2, 2:-2][mask != FOREGROUND] = 0
    ahead = [(-1, 0, near), (-1, -1, diagonal), (-1, 1, diagonal), (-2, -1, knight), (-2, 1, knight), (-1, -2, knight), (-1, 2, knight)]
    for sign in (1, -1):
        for y in range(2, h + 2) if sign == 1 else range(h + 1, 1, -1):
            line = d[y, 2:-2]
            for dy, dx, c in ahead:
                np.minimum(line, d[y + sign * dy, 2 + sign * dx : 2 + sign * dx + w] + c, out=line)
            # Along the row each step costs `near`: a running minimum of what remains.
            x = np.arange(w)
            flow = line if sign == 1 else line[::-1]
            np.minimum(flow, np.minimum.accumulate(flow - x) + x, out=flow)
    return d[2:-2, 2:-2]


def crop_center(mask: np.ndarray, size: int, rng: np.random.Generator, jitter: int = 3) -> tuple[int, int, int, int]:
    """IMG-08: (x, y) near the pixel farthest from the background, kept inside, and that pixel."""
    h, w = mask.shape
    if size > min(h, w):
        raise ValueError("the crop is larger than the mask")
    if not (mask == FOREGROUND).any():
        raise ValueError("no foreground")
    py, px = divmod(int(distance(mask).argmax()), w)
    dx, dy = (int(rng.integers(-jitter, jitter + 1)) if jitter else 0 for _ in range(2))  # x is drawn first
    half = size // 2
    return max(half, min(px + dx, w - half - 1)), max(half, min(py + dy, h - half - 1)), px, py


def cropped(image: np.ndarray, x1: int, y1: int, size: int) -> np.ndarray:
    """MTH-04: a window with the border repeated where it leaves the image."""
    h, w = image.shape[:2]
    ys, xs = np.clip(np.arange(y1, y1 + size), 0, h - 1), np.clip(np.arange(x1, x1 + size), 0, w - 1)
    return image[ys][:, xs]


def resized_nearest(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """IMG-06."""
    return image[np.arange(h) * image.shape[0] // h][:, np.arange(w) * image.shape[1] // w]


def resized_area(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """IMG-01: means over the area that each new pixel covers."""

    def weights(n: int, m: int) -> np.ndarray:
        lo, hi = np.arange(m)[:, None] * n / m, (np.arange(m)[:, None] + 1) * n / m
        cell = np.arange(n)
        return np.clip(np.minimum(hi, cell + 1) - np.maximum(lo, cell), 0, None) * m / n

    out = np.tensordot(weights(image.shape[0], h), image.astype(np.float64), 1)
    return np.moveaxis(np.tensordot(weights(image.shape[1], w), out, (1, 1)), 0, 1)


def as_bytes(values: np.ndarray) -> np.ndarray:
    """IMG-18: numbers as bytes, rounded half to even and kept in 0..255."""
    return np.clip(np.rint(values), 0, 255).astype(np.uint8)


def from_unit(values: np.ndarray) -> np.ndarray:
    """IMG-18: channels first in 0..1 as an image of bytes; fractions are cut off."""
    return np.moveaxis(np.clip(values * 255.0, 0, 255), 0, -1).astype(np.uint8)


def swapped(image: np.ndarray, mask: np.ndarray, background: np.ndarray) -> np.ndarray:
    """IMG-09: the image where the mask is shadow or foreground, elsewhere the background, resized by area if it differs in size."""
    if background.shape[:2] != image.shape[:2]:
        background = as_bytes(resized_area(background, *image.shape[:2])).astype(image.dtype)
    return np.where((mask >= SHADOW)[..., None] if image.ndim == 3 else mask >= SHADOW, image, background)


def swapped_crop(image: np.ndarray, mask: np.ndarray, background: np.ndarray, x1: int, y1: int, size: int, output: int) -> tuple[np.ndarray, np.ndarray]:
    """IMG-09: a window of the swapped image, resized by area, and of the mask, resized to the nearest."""
    whole = cropped(swapped(image, mask, background), x1, y1, size)
    return as_bytes(resized_area(whole, output, output)), resized_nearest(cropped(mask, x1, y1, size), output, output)


def reference_crop(image: np.ndarray, x1: int, y1: int, size: int, output: int) -> np.ndarray:
    """IMG-18: the same window without a swap."""
    return as_bytes(resized_area(cropped(image, x1, y1, size), output, output))


def mask_classes(mask: np.ndarray) -> np.ndarray:
    """IMG-10: 0, 1 for shadow, 2 for foreground."""
    return (mask == SHADOW).astype(np.int64) + 2 * (mask == FOREGROUND)


def normalised_mask(mask: np.ndarray) -> np.ndarray:
    """IMG-05."""
    return np.where(mask == SHADOW, SHADOW, np.where(mask > SHADOW, FOREGROUND, 0)).astype(np.uint8)


def laplacian_variance(gray: np.ndarray) -> float:
    """IMG-02: variance of the 5-point Laplacian, the border reflected without its edge."""
    g = np.pad(gray.astype(np.float64), 1, "reflect")
    lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float(lap.var())


def motion(a: np.ndarray, b: np.ndarray) -> float:
    """IMG-03: mean absolute difference, widened so that bytes don't wrap."""
    return float(np.abs(a.astype(np.int32) - b.astype(np.int32)).mean())


def gaussian(size: int) -> np.ndarray:
    """A kernel whose sigma follows from its size by the public rule."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    x = np.arange(size) - size // 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    return k / k.sum()


def blurred(gray: np.ndarray, size: int = 9) -> np.ndarray:
    """IMG-04: separable Gaussian blur."""
    k = gaussian(size)
    out = gray.astype(np.float64)
    for axis in (0, 1):
        pad = [(size // 2, size // 2) if a == axis else (0, 0) for a in range(2)]
        wide = np.pad(out, pad, "reflect")
        n = out.shape[axis]
        out = sum(k[i] * wide.take(range(i, i + n), axis) for i in range(size))
    return out


def heatmap(similarity: np.ndarray, h: int, w: int) -> np.ndarray:
    """IMG-13: a square grid of similarities, scaled to 0..1 and enlarged."""
    side = round(len(similarity) ** 0.5)
    if side * side != len(similarity):
        raise ValueError("patches fill no square")
    g = similarity.reshape(side, side)
    return resized_nearest((g - g.min()) / (g.max() - g.min() + 1e-6), h, w)


def gray(image: np.ndarray) -> np.ndarray:
    """IMG-01, IMG-12: the public luma of red, green and blue; gray images stay."""
    if image.ndim == 2:
        return image
    return as_bytes(image.astype(np.float64) @ np.array([0.299, 0.587, 0.114]))


def signature(image: np.ndarray, side: int = 64) -> np.ndarray:
    """IMG-01: the gray image, resized by area to a square."""
    return resized_area(gray(image), side, side).astype(np.float32)


def frame_metrics(frames: DataFrame, *, by: str, motion_size: tuple[int, int] = (120, 160)) -> DataFrame:
    """IMG-01..03: by, idx, sharpness, brightness, motion (null for a group's first frame) and signature of rows (by, idx, h, w, c, pixels).

    Groups are dealt and sorted by idx and streamed: a worker holds a batch and
    the small form of one frame.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, small = None, None
        for batch in batches:
            rows = []
            for key, idx, h, w, c, pixels in zip(*(batch[x] for x in (by, "idx", "h", "w", "c", "pixels"))):
                image = gray(np.frombuffer(pixels, np.uint8).reshape((h, w) if c == 1 else (h, w, c)))
                now = as_bytes(resized_area(image, *motion_size))
                rows.append((key, idx, laplacian_variance(image), float(image.mean()), motion(now, small) if last == key else None, resized_area(image, 64, 64).ravel().astype(np.float32)))
                last, small = key, now
            yield pd.DataFrame(rows, columns=[by, "idx", "sharpness", "brightness", "motion", "signature"])

    kind = frames.schema[by].dataType.simpleString()
    sized = frames.select(by, "idx", "h", "w", "c", "pixels").repartition(by).sortWithinPartitions(by, "idx")
    return sized.mapInPandas(run, f"{by} {kind}, idx long, sharpness double, brightness double, motion double, signature array<float>")


def channels_reversed(pixel: Column) -> Column:
    """IMG-11: blue, green, red as red, green, blue, of an array of channels."""
    return F.reverse(pixel)


def mask_components(masks: DataFrame, *, min_area: int = 0) -> DataFrame:
    """IMG-07, FIL-05: one row for each component of rows (key, mask binary, h, w)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (key, *box) for key, mask, h, w in zip(batch["key"], batch["mask"], batch["h"], batch["w"]) if mask is not None
                for box in components(np.frombuffer(mask, np.uint8).reshape(h, w), min_area)
            ]
            yield pd.DataFrame(rows, columns=["key", "x", "y", "w", "h", "area"])

    return masks.select("key", "mask", "h", "w").mapInPandas(run, "key long, x int, y int, w int, h int, area int")


def with_components(masks: DataFrame, *, min_area: int = 0) -> DataFrame:
    """FIL-06: the masks that have a component."""
    found = mask_components(masks, min_area=min_area).select("key").distinct()
    return masks.join(found, "key", "left_semi")


def overlay(frames: DataFrame, mask: DataFrame, *, alpha: float = 0.5, color: tuple[int, int, int] = (0, 0, 255)) -> DataFrame:
    """JOIN-14: pixel rows (frame, y, x, c1..c3) blended with the colour where the mask (v) is set."""
    joined = frames.join(mask.select("frame", "y", "x", "v"), ["frame", "y", "x"], "left")
    blend: list[Column] = [F.when(F.coalesce("v", F.lit(0)) > 0, F.bround((1 - alpha) * F.col(f"c{i + 1}") + alpha * color[i])).otherwise(F.col(f"c{i + 1}")).cast("int").alias(f"c{i + 1}") for i in range(3)]
    return joined.select("frame", "y", "x", *blend)


def checked_grid(tokens: DataFrame, *, by: str, place: str, rows: int, columns: int) -> DataFrame:
    """JOIN-13: tokens with the row and column of their grid; a group that doesn't fill it, each place once, is an error as the query runs."""
    n = rows * columns
    full = tokens.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(F.when(F.col(place).between(0, n - 1), F.col(place))).alias("_places"))
    wrong = F.raise_error(F.concat(F.lit(f"tokens don't fill a grid of {rows} x {columns}: "), F.coalesce(F.col("_by").cast("string"), F.lit("null"))))
    full = full.where(F.when((F.col("_n") != n) | (F.col("_places") != n), wrong.isNull()).otherwise(True))
    placed = tokens.withColumns({"row": F.floor(F.col(place) / columns).cast("int"), "col": (F.col(place) % columns).cast("int")})
    return placed.join(full, F.col(by).eqNullSafe(F.col("_by"))).select(*placed.columns)


def grid_cells(items: DataFrame, *, order: str, columns: int, width: int, height: int) -> DataFrame:
    """SNK-11, JOIN-13: the row, column and pixel place of numbered items in a contact sheet; order counts from 0."""
    i = F.col(order)
    row, col = F.floor(i / columns).cast("int"), (i % columns).cast("int")
    return items.withColumns({"row": row, "col": col, "x": col * width, "y": row * height})
