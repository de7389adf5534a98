"""Data-quality gates: rules as rows, so that failures can be counted and joined."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.operators import raster

#: Floors and bounds of the crop checks.
COVERAGE, CENTER, SWAP_DIFF, BACKGROUND_STD, LUMINANCE, BACKGROUND_LUMINANCE = (0.02, 0.95), (0.4, 0.6), 5.0, 8.0, 5.0, 30.0


def rule_rows(rows: DataFrame, key: str, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """DQ-07: (key, rule, value, ok) for each rule: a value and whether it passes; a rule whose test is null doesn't apply."""
    items = F.array(*[F.struct(F.lit(n).alias("rule"), v.cast("double").alias("value"), ok.alias("ok")) for n, (v, ok) in rules.items()])
    return rows.select(key, F.inline(items)).where("ok is not null")


def crop_rules(size: int) -> dict[str, tuple[Column, Column]]:
    """DQ-02..06 on columns center_x, coverage, swap_diff, background_std, luminance, background_luminance and swapped."""
    c = F.col
    only = lambda test: F.when(c("swapped"), test)
    return {
        "centering": (c("center_x"), c("center_x").between(CENTER[0] * size, CENTER[1] * size)),
        "coverage": (c("coverage"), c("coverage").between(*COVERAGE)),
        "swap_diff": (c("swap_diff"), only(F.coalesce(c("swap_diff") >= SWAP_DIFF, F.lit(False)))),
        "background_std": (c("background_std"), only(c("background_std") >= BACKGROUND_STD)),
        "luminance": (c("luminance"), c("luminance") >= LUMINANCE),
        "background_luminance": (c("background_luminance"), only(c("background_luminance") >= BACKGROUND_LUMINANCE)),
    }


def crop_metrics(crops: DataFrame) -> DataFrame:
    """DQ-02..06: key, swapped, center_x, center_y, coverage, swap_diff, background_std, luminance, background_luminance.

    crops: key, swapped, size, and as bytes: mask (size x size, classes 0..2),
    image and original (size x size x 3). Background is where the class is 0;
    without any, its measures are null. The center is the foreground's pixel
    farthest from what is none, null without foreground.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, swapped, size, *parts in zip(*(batch[c] for c in ("key", "swapped", "size", "mask", "image", "original"))):
                mask = np.frombuffer(parts[0], np.uint8).reshape(size, size)
                image, original = (np.frombuffer(x, np.uint8).reshape(size, size, 3) for x in parts[1:])
                back = mask == 0
                y, x = divmod(int(raster.distance(np.where(mask == 2, raster.FOREGROUND, 0)).argmax()), size) if (mask == 2).any() else (None, None)
                diff = float(np.abs(original[back].astype(np.int32) - image[back].astype(np.int32)).mean()) if back.any() else None
                std, dark = (float(image[back].std()), float(raster.gray(image)[back].mean())) if back.any() else (None, None)
                rows.append((key, swapped, x, y, float((mask >= 1).mean()), diff, std, float(raster.gray(image).mean()), dark))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in _METRICS.split(", ")])

    return crops.select("key", "swapped", "size", "mask", "image", "original").mapInPandas(run, _METRICS)


_METRICS = "key long, swapped boolean, center_x double, center_y double, coverage double, swap_diff double, background_std double, luminance double, background_luminance double"


def failures(checks: DataFrame) -> DataFrame:
    """DQ-08: failed rows by rule, of how many."""
    return checks.groupBy("rule").agg(F.count(F.lit(1)).alias("checked"), F.count_if(~F.col("ok")).alias("failed"))


def raise_on_failure(checks: DataFrame) -> DataFrame:
    """DQ-08: the failure counts, or an error as the query runs."""
    return failures(checks).withColumn("ok", F.when(F.col("failed") > 0, F.raise_error(F.concat(F.lit("rule failed: "), "rule"))).otherwise(True))


def coverage(mask: Column) -> Column:
    """AGG-14: the share of an array of mask values that is set."""
    return F.size(F.filter(mask, lambda v: v >= 1)) / F.size(mask)


def preflight(samples: DataFrame, pool: DataFrame, n: int) -> DataFrame:
    """DQ-01, DQ-09: one row: samples, pool, and the verdicts `empty`, `too_few`, `small_pool` (a warning)."""
    s = samples.agg(F.count(F.lit(1)).alias("samples")).withColumn("_k", F.lit(0))
    p = pool.agg(F.count(F.lit(1)).alias("pool")).withColumn("_k", F.lit(0))
    both = s.join(F.broadcast(p), "_k").drop("_k")
    return both.withColumns({"empty": F.col("samples") == 0, "too_few": F.col("samples") < n, "small_pool": F.col("pool") < 2})


def swap_ratio(items: DataFrame, swapped: str = "swapped") -> DataFrame:
    """AGG-13."""
    return items.agg((F.sum(F.col(swapped).cast("int")) / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("swap_ratio"))


def foreign_keys_missing(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """JOIN-04: child rows without a parent."""
    return child.join(parent.select(*keys).distinct(), keys, "left_anti")


def same_names(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """SET-06: one row: whether two tables hold the same names, of any number; nulls don't count."""
    rows = a.select(F.col(name).alias("_n"), F.lit(1).alias("_a")).unionByName(b.select(F.col(name).alias("_n"), F.lit(2).alias("_a")))
    sides = rows.where(F.col("_n").isNotNull()).groupBy("_n").agg(F.min("_a").alias("_lo"), F.max("_a").alias("_hi"))
    return sides.agg(F.coalesce(F.bool_and(F.col("_lo") < F.col("_hi")), F.lit(True)).alias("same"))
