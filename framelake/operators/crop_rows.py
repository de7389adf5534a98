"""Rasters as rows of pixels, second part: crops, swaps, sizes, blurs, borders and heat maps, and the measures of crops.

As in `pixels.py`, a raster is spread over tasks and no Python worker is used. Work
grows with the pixels that come out: windows ask for their pixels by an equi-join,
and a pixel goes to the places that it has a part in. Rasters are whole, a pixel is
given once, and rows without a raster, y or x have no place in a result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.checks import positive
from framelake.operators import pixels as rows_of
from framelake.operators.raster import FOREGROUND, SHADOW, checked_grid, gaussian
from framelake.scratch import Scratch

#: Weights of a blur are whole numbers of 1 / BLUR_UNIT.
BLUR_UNIT = 1 << 16
#: Fixed value: the slope of the public cubic kernel.
CUBIC = -0.75


def _whole(a: Column, b: Column | int) -> Column:
    """a // b of numbers that aren't negative."""
    return F.floor(a / b)


def _half_even(total: Column, parts: Column) -> Column:
    """total / parts of whole numbers, rounded half to even."""
    whole, rest = F.floor(total / parts), total % parts
    up = (2 * rest > parts) | ((2 * rest == parts) & (whole % 2 == 1))
    return (whole + up.cast("int")).cast("int")


def mirrored(q: Column, n: Column) -> Column:
    """The place that a place beyond the edges shows: reflected without the edge, as often as it takes."""
    turn = F.greatest(2 * (n - 1), F.lit(1))
    return F.when(n == 1, 0).otherwise(F.least(F.pmod(q, turn), turn - F.pmod(q, turn)))


def padded(pixels: DataFrame, *, by: list[str], channels: list[str], high: int, wide: int) -> DataFrame:
    """MTH-08: (by, y, x, channels, h, w) filled up, below and on the right, to whole patches of high x wide by reflection; h and w are the new sizes."""
    positive(high=high, wide=wide)

    def along(c: str, size: str, patch: int) -> tuple[Column, Column]:
        n = F.col(size).cast("long")
        new = _whole(n + patch - 1, patch) * patch
        beyond = F.when(new > n, F.filter(F.sequence(n, new - 1), lambda q: mirrored(q, n) == F.col(c)))
        return F.explode(F.concat(F.array(F.col(c).cast("long")), F.coalesce(beyond, F.array().cast("array<bigint>")))), new

    (ys, h), (xs, w) = along("y", "h", high), along("x", "w", wide)
    tall = pixels.select(*by, "x", *channels, "w", h.alias("_h"), ys.alias("_y"))
    full = tall.select(*by, "_y", xs.alias("_x"), *channels, "_h", w.alias("_w"))
    return full.select(*by, *[F.col(f"_{c}").cast("int").alias(c) for c in ("y", "x")], *channels, F.col("_h").cast("int").alias("h"), F.col("_w").cast("int").alias("w"))


def resized_nearest(pixels: DataFrame, *, by: list[str], channels: list[str], height: Column | int, width: Column | int) -> DataFrame:
    """IMG-06: (by, y, x, channels) in another size (numbers, or columns of pixels); a new pixel shows the old one at its place, rounded down."""

    def along(c: str, size: str, new: Column | int) -> Column:
        n, new, at = F.col(size).cast("long"), (F.lit(new) if isinstance(new, int) else new).cast("long"), F.col(c).cast("long")
        first = lambda q: _whole(q * new + n - 1, n)
        return F.explode(F.when(first(at) < first(at + 1), F.sequence(first(at), first(at + 1) - 1)))

    kept = [*by, *channels, "h", "w"]
    tall = pixels.select("*", along("y", "h", height).alias("_y"))
    full = tall.select(*kept, "_y", along("x", "w", width).alias("_x"))
    return full.select(*by, F.col("_y").cast("int").alias("y"), F.col("_x").cast("int").alias("x"), *channels)


def enlarged(patches: DataFrame, *, by: str, place: str, rows: int, columns: int, channels: list[str], height: int, width: int) -> DataFrame:
    """IMG-16, JOIN-13: (by, y, x, channels): the patches of each grid as a raster, each as large as its share; a grid that isn't full is an error as the query runs."""
    positive(rows=rows, columns=columns, height=height, width=width)
    placed = checked_grid(patches.select(by, place, *channels), by=by, place=place, rows=rows, columns=columns)
    grid = placed.select(by, F.col("row").alias("y"), F.col("col").alias("x"), *channels, F.lit(rows).alias("h"), F.lit(columns).alias("w"))
    return resized_nearest(grid, by=[by], channels=channels, height=height, width=width)


def resized_area(pixels: DataFrame, *, by: list[str], channels: list[str], height: Column | int, width: Column | int) -> DataFrame:
    """IMG-01: (by, y, x, channels) in another size (numbers, or columns of pixels): means over what a new pixel covers, rounded half to even.

    Parts of areas are whole numbers, so that means don't depend on the order of sums.
    """

    def along(c: str, size: str, new: Column | int) -> Column:
        n, new, at = F.col(size).cast("long"), (F.lit(new) if isinstance(new, int) else new).cast("long"), F.col(c).cast("long")
        lo, hi = at * new, (at + 1) * new
        part = lambda i: F.struct(i.alias("i"), (F.least((i + 1) * n, hi) - F.greatest(i * n, lo)).alias("o"))
        return F.explode(F.transform(F.sequence(_whole(lo, n), _whole(hi - 1, n)), part))

    tall = pixels.select("*", along("y", "h", height).alias("_y"))
    full = tall.select(*by, *channels, "h", "w", "_y", along("x", "w", width).alias("_x"))
    weight = F.col("_y.o") * F.col("_x.o")
    sums = [F.sum(F.col(c).cast("long") * weight).alias(f"_s{i}") for i, c in enumerate(channels)]
    means = full.groupBy(*by, F.col("_y.i").alias("_i"), F.col("_x.i").alias("_j")).agg(*sums, F.max(F.col("h").cast("long") * F.col("w")).alias("_d"))
    return means.select(*by, F.col("_i").cast("int").alias("y"), F.col("_j").cast("int").alias("x"), *[_half_even(F.col(f"_s{i}"), F.col("_d")).alias(c) for i, c in enumerate(channels)])


def cropped(pixels: DataFrame, windows: DataFrame, *, by: list[str], crop: str, channels: list[str]) -> DataFrame:
    """MTH-04, PRJ-04: (crop, y, x, channels, h, w): the pixels of windows (crop, by, x1, y1, size, h, w: the raster's sizes), the border repeated where a window leaves its raster.

    A window asks for each of its pixels by raster and place, so that a raster may have any number of windows.
    """
    places = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    inside = lambda q, n: F.greatest(F.lit(0), F.least(q, n - 1)).cast("long")
    asked = windows.where("size > 0").select(crop, *by, "x1", "y1", "size", "h", "w", places(F.col("size")).alias("_r")).select("*", places(F.col("size")).alias("_c"))
    asked = asked.select(crop, *by, "_r", "_c", "size", inside(F.col("y1") + F.col("_r"), F.col("h")).alias("_y"), inside(F.col("x1") + F.col("_c"), F.col("w")).alias("_x"))
    shown = pixels.select(*by, F.col("y").cast("long").alias("_y"), F.col("x").cast("long").alias("_x"), *channels)
    return asked.join(shown, [*by, "_y", "_x"]).select(crop, F.col("_r").alias("y"), F.col("_c").alias("x"), *channels, F.col("size").alias("h"), F.col("size").alias("w"))


def swapped(images: DataFrame, masks: DataFrame, backgrounds: DataFrame, *, by: list[str], channels: list[str]) -> DataFrame:
    """IMG-09: images (by, y, x, channels, h, w), where the mask (by, y, x, mask) is shadow or foreground, elsewhere the raster's background.

    Backgrounds (by, y, x, channels, h, w) of another size are resized by area. The
    image's own channels stay as `<channel>_own`, and the mask's value as `mask`.
    """
    sizes = images.groupBy(*by).agg(F.max("h").alias("_h"), F.max("w").alias("_w"))
    sized = resized_area(backgrounds.join(sizes, by), by=by, channels=channels, height=F.col("_h"), width=F.col("_w"))
    behind = sized.select(*by, "y", "x", *[F.col(c).alias(f"_b{i}") for i, c in enumerate(channels)])
    joined = images.select(*by, "y", "x", *channels, "h", "w").join(masks.select(*by, "y", "x", "mask"), [*by, "y", "x"]).join(behind, [*by, "y", "x"])
    shown = [F.when(F.col("mask") >= SHADOW, F.col(c)).otherwise(F.col(f"_b{i}")).alias(c) for i, c in enumerate(channels)]
    return joined.select(*by, "y", "x", *shown, *[F.col(c).alias(f"{c}_own") for c in channels], "mask", "h", "w")


def swapped_crops(images: DataFrame, masks: DataFrame, backgrounds: DataFrame, windows: DataFrame, *, by: list[str], crop: str, channels: list[str], output: int) -> DataFrame:
    """IMG-09, IMG-18: (crop, y, x, channels, <channel>_own, mask): windows of swapped images, and of the images themselves, resized by area to a square; of masks, to the nearest."""
    positive(output=output)
    both = [*channels, *[f"{c}_own" for c in channels]]
    scene = swapped(images, masks, backgrounds, by=by, channels=channels)
    cut = cropped(scene, windows, by=by, crop=crop, channels=[*both, "mask"])
    small = resized_area(cut, by=[crop], channels=both, height=output, width=output)
    return small.join(resized_nearest(cut, by=[crop], channels=["mask"], height=output, width=output), [crop, "y", "x"])


def luma(red: Column, green: Column, blue: Column) -> Column:
    """IMG-01, IMG-12: the public luma, rounded half to even; thousandths are whole numbers, so ties are exact."""
    return F.rint((299 * red.cast("long") + 587 * green.cast("long") + 114 * blue.cast("long")) / 1000).cast("int")


def crop_measures(crops: DataFrame, *, crop: str, channels: list[str]) -> DataFrame:
    """DQ-02..06: (crop, center_x, center_y, coverage, swap_diff, background_std, luminance, background_luminance) of rows as `swapped_crops` gives them.

    Background is where the mask is neither shadow nor foreground; without any, its
    measures are null. The center is the foreground's pixel farthest from what is
    none, null without foreground. Means and the deviation come from whole sums.
    Crops are written once, as both the sums and the centers read them.
    """
    crops = Scratch(crops.sparkSession, "crops").save(crops.select(crop, "y", "x", *channels, *[f"{c}_own" for c in channels], "mask"))
    back, n = ~F.col("mask").isin(SHADOW, FOREGROUND), len(channels)
    on = lambda v: F.sum(F.when(back, v)).cast("decimal(20,0)")
    own = [F.col(c).cast("long") for c in channels]
    total = lambda items: sum(items[1:], items[0])
    gray = luma(*own) if n == 3 else own[0]
    sums = crops.groupBy(crop).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(~back).alias("_front"), F.count_if(back).alias("_back"), on(total([F.abs(c - F.col(f"{o}_own")) for c, o in zip(own, channels)])).alias("_diff"),
        on(total(own)).alias("_s"), on(total([c * c for c in own])).alias("_ss"), F.sum(gray).alias("_l"), F.sum(F.when(back, gray)).alias("_bl"),
    )
    values = F.nullif(F.col("_back") * n, F.lit(0))
    spread = (values.cast("decimal(14,0)") * F.col("_ss") - F.col("_s").cast("decimal(17,0)") * F.col("_s").cast("decimal(17,0)")).cast("double")
    measured = sums.select(
        crop, (F.col("_front") / F.col("_n")).alias("coverage"), (F.col("_diff").cast("double") / values).alias("swap_diff"), (F.sqrt(spread) / values).alias("background_std"),
        (F.col("_l") / F.col("_n")).alias("luminance"), (F.col("_bl") / F.nullif(F.col("_back"), F.lit(0))).alias("background_luminance"),
    )
    center = rows_of.farthest(crops.select(crop, "y", "x", F.col("mask").alias("v")), raster=crop).select(crop, F.col("x").alias("center_x"), F.col("y").alias("center_y"))
    return measured.join(center, crop, "left")


def blur_weights(size: int) -> list[int]:
    """The Gaussian kernel in whole numbers of 1 / BLUR_UNIT; what rounding leaves goes to its middle."""
    k = [round(float(v) * BLUR_UNIT) for v in gaussian(size)]
    k[size // 2] += BLUR_UNIT - sum(k)
    return k


def blurred(pixels: DataFrame, *, by: list[str], size: int = 9, tile: int = rows_of.TILE) -> DataFrame:
    """IMG-04: (by, y, x, v) of gray rasters (by, y, x, v, h, w), blurred along both axes with a reflected border and rounded half up.

    Tiles have a border of half a kernel, so neighbours exchange rows and columns; sums are whole numbers.
    """
    positive(size=size, tile=tile)
    if size % 2 == 0:
        raise ValueError("a kernel has an odd size")
    half, k = size // 2, blur_weights(size)
    down = Window.partitionBy(*by, "_ty", "_tx").orderBy("y")
    rows = rows_of.tiled(pixels, by=by, tile=tile, border=half)
    rows = rows.withColumn("_near", F.array(*[F.lead("vals", d).over(down) if d > 0 else F.lag("vals", -d).over(down) if d else F.col("vals") for d in range(-half, half + 1)]))
    rows = rows.where((F.col("y") >= F.col("_ty") * tile) & (F.col("y") < (F.col("_ty") + 1) * tile) & F.col("y").between(0, F.col("h") - 1))
    added = lambda parts: sum(parts[1:], parts[0])
    tall = rows.withColumn("_sum", F.transform("vals", lambda _, i: added([F.get(F.get("_near", F.lit(d)), i).cast("long") * k[d] for d in range(size)])))
    wide = F.transform(F.sequence(F.lit(half), F.size("_sum") - 1 - half), lambda i: added([F.get("_sum", i + (d - half)) * k[d] for d in range(size)]))
    out = tall.select(*by, "y", (F.col("_tx") * tile).alias("_x0"), F.posexplode(wide).alias("_i", "_v"))
    return out.select(*by, F.col("y").cast("int").alias("y"), (F.col("_x0") + F.col("_i")).cast("int").alias("x"), F.floor((F.col("_v") + BLUR_UNIT * BLUR_UNIT // 2) / (BLUR_UNIT * BLUR_UNIT)).cast("int").alias("v"))


def _cubic(i: Column, at: Column, n: Column) -> Column:
    """What place i of n gives to a point between places: the cubic weights of its four neighbours that are i, those beyond the edges taken as the edge."""
    f = F.floor(at)
    t, a = at - f, CUBIC
    far = lambda u: ((a * u - 5 * a) * u + 8 * a) * u - 4 * a
    near = lambda u: ((a + 2) * u - (a + 3)) * u * u + 1
    weights = [far(t + 1), near(t), near(1 - t)]
    weights.append(1 - weights[0] - weights[1] - weights[2])
    hit = lambda d: F.greatest(F.lit(0), F.least(f + d, n - 1)) == i
    return sum((F.when(hit(d), w).otherwise(0.0) for d, w in zip((-1, 0, 1, 2), weights)), F.lit(0.0))


def heatmaps(tokens: DataFrame, *, by: str, place: str, value: str, height: int, width: int, strict: bool = True, clip: bool = True) -> DataFrame:
    """IMG-13: (by, y, x, v): similarities of tokens as a square grid, scaled to 0..1 and enlarged by cubic weights; kept in 0..1 with `clip`.

    strict: tokens of a group that fill no square, each place once, are an error as
    the query runs; else the largest square of the first places counts, and a group
    in which one of those is missing is an error. Null values count as missing.
    Enlarging is separable: a token gives its part to the lines near it, a line to the columns.
    """
    positive(height=height, width=width)
    given = tokens.where(F.col(by).isNotNull() & F.col(place).isNotNull() & F.col(value).isNotNull()).select(by, F.col(place).cast("long").alias("_p"), F.col(value).cast("double").alias("_v"))
    counts = given.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("_all")).withColumn("_n", F.floor(F.sqrt("_all")))
    grid = given.join(counts, F.col(by) == F.col("_by")).where((F.col("_p") >= 0) & (F.col("_p") < F.col("_n") * F.col("_n")))
    facts = grid.groupBy("_by", "_n", "_all").agg(F.count(F.lit(1)).alias("_in"), F.count_distinct("_p").alias("_places"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    square = F.col("_n") * F.col("_n")
    wrong = (F.col("_in") != square) | (F.col("_places") != square) | (F.lit(strict) & (F.col("_all") != square))
    facts = facts.where(F.when(wrong, F.raise_error(F.concat(F.lit("tokens fill no square: "), F.col("_by").cast("string"))).isNull()).otherwise(True)).select("_by", "_lo", "_hi")
    cells = grid.join(facts, "_by").select(
        F.col("_by").alias(by), "_n", _whole(F.col("_p"), F.col("_n")).alias("_i"), (F.col("_p") % F.col("_n")).alias("_j"), ((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-6)).alias("_v")
    )

    def along(c: str, new: int) -> Callable[[DataFrame], DataFrame]:
        """Rows with the new places (_q) that they have a part in, and its weight (_w)."""
        i, n = F.col(c), F.col("_n")
        lo = F.greatest(F.lit(0), F.floor((i - 1.5) * new / n - 0.5))
        hi = F.least(F.lit(new - 1), F.ceil((i + 2.5) * new / n - 0.5))
        return lambda df: df.select("*", F.explode(F.sequence(lo, hi)).alias("_q")).withColumn("_w", _cubic(i, (F.col("_q") + 0.5) * n / new - 0.5, n))

    tall = along("_i", height)(cells).groupBy(by, "_n", "_j", F.col("_q").alias("_y")).agg(F.sum(F.col("_v") * F.col("_w")).alias("_v"))
    full = along("_j", width)(tall).groupBy(by, "_y", F.col("_q").alias("_x")).agg(F.sum(F.col("_v") * F.col("_w")).alias("_v"))
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_v"))) if clip else F.col("_v")
    return full.select(by, F.col("_y").cast("int").alias("y"), F.col("_x").cast("int").alias("x"), v.alias("v"))
