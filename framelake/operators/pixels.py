"""Rasters as rows of pixels (raster, y, x, v): components, distances, sharpness and motion without Python workers.

A raster of any size is spread over tasks by its rows, its lines or its tiles. A
pixel is given once, rows without a raster, y or x are left out, and a raster holds
all pixels of a rectangle from (0, 0) on, where an operator says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.checks import positive
from framelake.operators.graph import by_shuffle, components
from framelake.operators.raster import FOREGROUND
from framelake.scratch import Scratch

#: Pixels of a row in which runs look for those that they touch.
CELL = 64
#: Side of a tile without its border.
TILE = 32
#: Weights of the public 5 x 5 chamfer distance, in units of 1 / 10,000: to the next pixel, the diagonal one, and a knight's move.
NEAR, DIAGONAL, KNIGHT, UNIT = 10_000, 14_000, 21_969, 10_000
#: Farther than any distance.
FAR = 1 << 50


def runs(pixels: DataFrame, *, raster: str) -> DataFrame:
    """(raster, y, x1, x2, node) of the runs of strict foreground in each row; nodes are in the order of runs."""
    on = pixels.where((F.col("v") == FOREGROUND) & F.col(raster).isNotNull() & F.col("y").isNotNull() & F.col("x").isNotNull()).select(raster, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    gap = F.col("x") - F.dense_rank().over(Window.partitionBy(raster, "y").orderBy("x"))
    found = on.withColumn("_gap", gap).groupBy(raster, "y", "_gap").agg(F.min("x").alias("x1"), F.max("x").alias("x2"))
    return found.select(raster, "y", "x1", "x2", (F.col("y") * (1 << 32) + F.col("x1")).alias("node"))


def component_boxes(pixels: DataFrame, *, raster: str, min_area: int = 0) -> DataFrame:
    """IMG-07, FIL-05: (raster, x, y, w, h, area, first_y, first_x) of the 8-connected components of strict foreground.

    Components in the order of their first pixel are those by (first_y, first_x).
    Runs of a row are linked with those that they touch in the row above; a link is
    looked for in cells of `CELL` pixels, so that rows of many runs cost what they
    hold. Rasters needn't be whole.
    """
    scratch = Scratch(pixels.sparkSession, "components")
    line = scratch.save(runs(pixels, raster=raster))
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / CELL), F.floor(b / CELL)))
    above = line.select(raster, (F.col("y") + 1).alias("y"), F.col("x1").alias("a1"), F.col("x2").alias("a2"), F.col("node").alias("u"), cells(F.col("x1") - 1, F.col("x2") + 1).alias("_cell"))
    below = line.select(raster, "y", "x1", "x2", F.col("node").alias("v"), cells(F.col("x1"), F.col("x2")).alias("_cell"))
    links = above.join(by_shuffle(below), [raster, "y", "_cell"]).where("x1 <= a2 + 1 and a1 <= x2 + 1").select(raster, "u", "v")
    found = components(scratch, links, [raster])
    whole = line.join(by_shuffle(found), [raster, "node"], "left").withColumn("root", F.coalesce("root", "node"))
    boxes = whole.groupBy(raster, "root").agg(F.min("x1").alias("x"), F.min("y").alias("y"), F.max("x2").alias("_x2"), F.max("y").alias("_y2"), F.sum(F.col("x2") - F.col("x1") + 1).alias("area"), F.min(F.struct("y", "x1")).alias("_first"))
    size = lambda a, b: (F.col(b) - F.col(a) + 1).cast("int")
    out = boxes.where(F.col("area") >= min_area)
    return out.select(raster, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), size("x", "_x2").alias("w"), size("y", "_y2").alias("h"), "area", F.col("_first.y").cast("int").alias("first_y"), F.col("_first.x1").cast("int").alias("first_x"))


#: The steps of the distance: (dx, dy, weight). Each stands for both directions.
_STEPS = ((1, 0, NEAR), (0, 1, NEAR), (1, 1, DIAGONAL), (1, -1, DIAGONAL), (2, 1, KNIGHT), (1, 2, KNIGHT), (2, -1, KNIGHT), (1, -2, KNIGHT))


def distances(pixels: DataFrame, *, raster: str) -> DataFrame:
    """IMG-08: (raster, y, x, d) of whole rasters: the chamfer distance (5 x 5) to the nearest pixel that isn't strict foreground; null in a raster of nothing else.

    The shortest way between two pixels takes two kinds of steps, one after the other,
    and never leaves the rectangle between them. So the transform is separable: for
    each kind of step, minima run along the lines of that direction, forwards and
    backwards, over what the kinds before have found. A line is a group, so that a
    raster is spread over as many tasks as it has lines. Distances are whole numbers
    of 1 / `UNIT` until the end, so that they don't depend on the order of sums.
    """
    rows = pixels.where(F.col(raster).isNotNull()).select(raster, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.when(F.col("v") == FOREGROUND, FAR).otherwise(0).cast("long").alias("d"))
    for dx, dy, weight in _STEPS:
        line, at = F.col("x") * dy - F.col("y") * dx, F.col("x") if dx == 1 else F.col("y")
        cost = at * weight
        ahead = Window.partitionBy(raster, "_line").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
        back = Window.partitionBy(raster, "_line").orderBy(at.desc()).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_line", line)
        rows = rows.select(raster, "y", "x", F.least(F.min(F.col("d") - cost).over(ahead) + cost, F.min(F.col("d") + cost).over(back) - cost).alias("d"))
    return rows.select(raster, "y", "x", F.when(F.col("d") < FAR // 2, F.col("d") / UNIT).alias("d"))


def farthest(pixels: DataFrame, *, raster: str) -> DataFrame:
    """IMG-08: (raster, y, x, d): the strict foreground pixel farthest from others, the first by row and column; rasters without foreground have no row."""
    found = distances(pixels, raster=raster).where("d is null or d > 0")
    best = found.groupBy(raster).agg(F.max(F.struct(F.coalesce("d", F.lit(float("inf"))).alias("d"), (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))).alias("b"))
    return best.select(raster, (-F.col("b.y")).cast("int").alias("y"), (-F.col("b.x")).cast("int").alias("x"), F.when(F.col("b.d") < float("inf"), F.col("b.d")).alias("d"))


def _places(c: str, size: str, border: int) -> Column:
    """The places of a pixel along an axis: its own, and those up to `border` beyond the edges where it is the reflection (without the edge)."""
    at, n = F.col(c), F.col(size)
    turn = F.greatest(2 * (n - 1), F.lit(1))
    mirrored = lambda q: F.when(n == 1, 0).otherwise(F.least(F.pmod(q, turn), turn - F.pmod(q, turn)))
    beyond = F.array(*[F.lit(q) for q in range(-border, 0)], *[n + q for q in range(border)])
    return F.when((at > border) & (at < n - 1 - border), F.array(at)).otherwise(F.concat(F.array(at), F.filter(beyond, lambda q: mirrored(q) == at)))


def _tiles(q: Column, size: Column, tile: int, border: int) -> Column:
    """The tiles that hold a place, or have it on the border around them."""
    last = F.floor((size - 1) / tile)
    return F.filter(F.sequence(F.floor((q - border) / tile), F.floor((q + border) / tile)), lambda t: (t >= 0) & (t <= last))


def tiled(pixels: DataFrame, *, by: list[str], tile: int = TILE, border: int = 1, value: Column | None = None) -> DataFrame:
    """(by, _ty, _tx, y, h, w, vals): the rows of tiles with a border of some pixels, of whole rasters (by, y, x, v, h, w).

    A pixel goes to its own tile and to those whose border it is, so neighbours
    exchange rows and columns and no task holds a whole raster.
    """
    along = lambda c, size: F.explode(F.flatten(F.transform(_places(c, size, border), lambda q: F.transform(_tiles(q, F.col(size), tile, border), lambda t: F.struct(q.alias("q"), t.alias("t"))))))
    v = F.col("v").cast("int") if value is None else value
    placed = pixels.select(*by, "x", v.alias("_v"), "h", "w", along("y", "h").alias("_y")).select(*by, "_v", "h", "w", "_y", along("x", "w").alias("_x"))
    keys = [*by, "_ty", "_tx", "y"]
    rows = placed.select(*by, F.col("_y.t").alias("_ty"), F.col("_x.t").alias("_tx"), F.col("_y.q").alias("y"), "h", "w", F.struct(F.col("_x.q").alias("x"), F.col("_v").alias("v")).alias("_p"))
    listed = rows.groupBy(*keys).agg(F.max("h").alias("h"), F.max("w").alias("w"), F.sort_array(F.collect_list("_p")).alias("_p"))  # a tile's width and its borders
    return listed.select(*keys, "h", "w", F.transform("_p", lambda p: p["v"]).alias("vals"))


def sharpness(pixels: DataFrame, *, by: list[str], tile: int = TILE) -> DataFrame:
    """IMG-02: (by, sharpness, brightness): variance of the 5-point Laplacian, its border reflected without the edge, and mean of whole rasters (by, y, x, v, h, w).

    Sums of the Laplacian and of its squares are whole numbers, added up by tiles.
    """
    positive(tile=tile)
    down = Window.partitionBy(*by, "_ty", "_tx").orderBy("y")
    rows = tiled(pixels, by=by, tile=tile).withColumns({"_up": F.lag("vals").over(down), "_down": F.lead("vals").over(down)})
    rows = rows.where((F.col("y") >= F.col("_ty") * tile) & (F.col("y") < (F.col("_ty") + 1) * tile) & F.col("y").between(0, F.col("h") - 1))
    at = lambda c, i: F.get(F.col(c), i)
    inner = F.sequence(F.lit(1), F.size("vals") - 2)
    lap = F.transform(inner, lambda i: at("_up", i) + at("_down", i) + at("vals", i - 1) + at("vals", i + 1) - 4 * at("vals", i))
    zero = F.lit(0).cast("long")
    sums = rows.select(*by, lap.alias("_lap"), F.slice("vals", 2, F.size("vals") - 2).alias("_own")).select(
        *by, F.size("_lap").alias("_n"), F.aggregate("_lap", zero, lambda a, v: a + v).alias("_s"), F.aggregate("_lap", zero, lambda a, v: a + v.cast("long") * v).alias("_ss"), F.aggregate("_own", zero, lambda a, v: a + v).alias("_b")
    )
    total = sums.groupBy(*by).agg(*[F.sum(c).cast("decimal(38,0)").alias(c) for c in ("_n", "_s", "_ss", "_b")])
    n = F.col("_n").cast("double")
    spread = (F.col("_n").cast("decimal(12,0)") * F.col("_ss").cast("decimal(24,0)") - F.col("_s").cast("decimal(18,0)") * F.col("_s").cast("decimal(18,0)")).cast("double")
    return total.select(*by, (spread / (n * n)).alias("sharpness"), (F.col("_b").cast("double") / n).alias("brightness"))


def shrunk(pixels: DataFrame, *, by: list[str], height: int, width: int) -> DataFrame:
    """IMG-01: (by, y, x, v) of rasters (by, y, x, v, h, w) made smaller by the means of the areas that new pixels cover, rounded half to even."""
    positive(height=height, width=width)

    def along(c: str, size: str, new: int) -> Column:
        """(new place, overlap) for each new pixel that this one covers in part; the overlaps of a new pixel add up to the old size."""
        lo, hi = F.col(c) * new, (F.col(c) + 1) * new
        part = lambda i: F.struct(i.alias("i"), (F.least((i + 1) * F.col(size), hi) - F.greatest(i * F.col(size), lo)).alias("o"))
        return F.explode(F.transform(F.sequence(F.floor(lo / F.col(size)), F.floor((hi - 1) / F.col(size))), part))

    wide = pixels.select(*by, "x", "v", "h", "w", along("y", "h", height).alias("_y")).select(*by, "v", "h", "w", "_y", along("x", "w", width).alias("_x"))
    weight = F.col("v").cast("long") * F.col("_y.o") * F.col("_x.o")
    sums = wide.groupBy(*by, F.col("_y.i").alias("y"), F.col("_x.i").alias("x")).agg(F.sum(weight).alias("_s"), F.max(F.col("h").cast("long") * F.col("w")).alias("_d"))
    whole, rest = F.floor(F.col("_s") / F.col("_d")), F.col("_s") % F.col("_d")
    up = (2 * rest > F.col("_d")) | ((2 * rest == F.col("_d")) & (whole % 2 == 1))
    return sums.select(*by, "y", "x", (whole + up.cast("int")).cast("int").alias("v"))


def motion(pixels: DataFrame, *, by: str, idx: str) -> DataFrame:
    """IMG-03: (by, idx, motion) of frames as pixel rows: mean absolute difference to the frame before; null for the first.

    A group is one pixel through time, so a recording is spread over as many tasks as it has pixels.
    """
    before = F.lag("v").over(Window.partitionBy(by, "y", "x").orderBy(idx))
    change = F.abs(F.col("v").cast("int") - before.cast("int"))
    return pixels.select(by, idx, change.alias("_c")).groupBy(by, idx).agg(F.avg("_c").alias("motion"))


def scored_frames(pixels: DataFrame, *, by: str, idx: str, height: int = 120, width: int = 160, tile: int = TILE) -> DataFrame:
    """IMG-01..03: (by, idx, sharpness, brightness, motion) of whole gray frames (by, idx, y, x, v, h, w); motion between frames made smaller."""
    keys = [by, idx]
    moved = motion(shrunk(pixels, by=keys, height=height, width=width), by=by, idx=idx)
    return sharpness(pixels, by=keys, tile=tile).join(moved, keys)
