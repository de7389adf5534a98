"""Column functions for vectors, boxes, windows and samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean_abs_diff(a: Column, b: Column) -> Column:
    """MTH-01."""
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))) / F.size(a)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """MTH-02; zero vectors and what is no number give 0, infinities 1 and -1."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    found = F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)
    return F.when(F.isnan(found), 0.0).otherwise(F.when(F.abs(found) == float("inf"), F.signum(found)).otherwise(found))


def xyxy_to_xywh(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """MTH-03."""
    return F.array(x1, y1, x2 - x1, y2 - y1)


def xywh_to_xyxy(box: Column) -> Column:
    """MTH-03, rounded half to even."""
    at = lambda i: F.get(box, F.lit(i))
    return F.array(*[F.bround(v).cast("int") for v in (at(0), at(1), at(0) + at(2), at(1) + at(3))])


def iou(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Intersection over union of two boxes."""
    w = F.greatest(F.least(ax + aw, bx + bw) - F.greatest(ax, bx), F.lit(0))
    h = F.greatest(F.least(ay + ah, by + bh) - F.greatest(ay, by), F.lit(0))
    return (w * h) / (aw * ah + bw * bh - w * h)


def crop_window(cx: Column, cy: Column, size: int, width: Column, height: Column) -> Column:
    """MTH-04: a clipped window and how many pixels of border replace what is outside."""
    x1, y1 = cx - size // 2, cy - size // 2
    x2, y2 = x1 + size, y1 + size
    zero = F.lit(0)
    return F.struct(
        F.greatest(x1, zero).alias("x1"), F.greatest(y1, zero).alias("y1"), F.least(x2, width).alias("x2"), F.least(y2, height).alias("y2"),
        F.greatest(-x1, zero).alias("left"), F.greatest(-y1, zero).alias("top"), F.greatest(x2 - width, zero).alias("right"), F.greatest(y2 - height, zero).alias("bottom"),
    )


def clamp_center(x: Column, half: int, size: Column) -> Column:
    """MTH-05."""
    return F.greatest(F.lit(half), F.least(x, size - half - 1))


def clip_rescale(x: Column, lo: Column, hi: Column) -> Column:
    """MTH-06: 0 to 1 between anchors."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - lo) / F.greatest(hi - lo, F.lit(1e-6))))


def scaled_size(n: Column, scale: Column) -> Column:
    """MTH-07."""
    return F.greatest(F.lit(1), F.bround(n * scale)).cast("int")


def padded_size(n: Column, patch: int) -> Column:
    """MTH-08."""
    return (F.ceil(n / patch) * patch).cast("int")


def normalised(x: Column, mean: float, std: float) -> Column:
    """MTH-09."""
    return (x / 255.0 - mean) / std


def min_max(x: Column, lo: Column, hi: Column) -> Column:
    """WIN-09."""
    return (x - lo) / (hi - lo + F.lit(1e-6))


def even_indices(n: Column, m: int) -> Column:
    """WIN-11: m places spread evenly over 0 .. n - 1, half to even; all of them if n <= m."""
    if m == 1:
        return F.when(n > 0, F.array(F.lit(0)))
    spread = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.bround(i * (n - 1) / (m - 1)).cast("int"))
    return F.when(n <= m, F.transform(F.sequence(F.lit(1), n), lambda i: (i - 1).cast("int"))).otherwise(spread)


def linspace_indices(start: Column, end: Column, n: int) -> Column:
    """WIN-12: n frames over a window, that is counted as n long at least."""
    span = F.greatest(end - start, F.lit(n))
    step = (span - 1) / max(1, n - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (start + F.floor(i * step)).cast("int"))


def clip_window(total: Column, fps: Column, seconds: float) -> Column:
    """WIN-13: the middle seconds of a recording, as frames."""
    n = F.least(total, F.greatest(F.lit(1), F.bround(fps * seconds).cast("int")))
    start = F.floor((total - n) / 2).cast("int")
    return F.struct(start.alias("start"), (start + n).alias("end"))


def middle_timestamps(duration: Column, n: int) -> Column:
    """WIN-14: n even timestamps in the middle 90 %; the midpoint for one; none for no duration."""
    if n <= 0:
        return F.array().cast("array<double>")
    if n == 1:
        stamps = F.array(duration / 2)
    else:
        stamps = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: duration * 0.05 + i * (duration * 0.9 / (n - 1)))
    return F.when(duration > 0, stamps).otherwise(F.array().cast("array<double>"))
