"""Detections against ground truth: overlap joins, average precision, class scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.numbers import iou
from framelake.operators.order import PART, running
from framelake.scratch import Scratch

#: Fixed values of the public COCO protocol.
THRESHOLDS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))
RECALLS = 101
AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}


def in_classes(found: DataFrame, n: int, column: str = "category_id") -> DataFrame:
    """FIL-08: detections whose class id is in [0, n)."""
    return found.where(F.col(column).between(0, n - 1))


def overlapping(truth: DataFrame, found: DataFrame, *, on: list[str], least: float) -> DataFrame:
    """JOIN-09: pairs of boxes (x, y, w, h; key) with equal keys `on` that overlap by `least` at least.

    An equi-join first: boxes of different images or classes never meet.
    """
    t = truth.select(*on, *[F.col(c).alias(f"t_{c}") for c in ("key", "x", "y", "w", "h")])
    d = found.select(*on, *[F.col(c).alias(f"d_{c}") for c in ("key", "x", "y", "w", "h")])
    box = lambda p: [F.col(f"{p}_{c}") for c in "xywh"]
    return t.join(d, on).withColumn("iou", iou(*box("t"), *box("d"))).where(F.col("iou") >= least)


#: Pairs of a truth and a detection that are compared at a time.
PAIRS = 1 << 15


def _hits(g: np.ndarray, ignore: np.ndarray, crowd: np.ndarray, g_at: np.ndarray, d: np.ndarray, d_at: np.ndarray, lo: float, hi: float) -> tuple[np.ndarray, np.ndarray]:
    """(matched, ignored) by detection and threshold, of many groups; those of group k are g_at[k] to g_at[k + 1], truths with the ignored ones last, detections by score.

    Groups with about as many truths are matched together, a rank at a time.
    """
    at = np.array(THRESHOLDS)[:, None, None]
    outside = (d[:, 2] * d[:, 3] < lo) | (d[:, 2] * d[:, 3] > hi)
    hit, skip = np.zeros((len(d), len(THRESHOLDS)), bool), np.repeat(outside[:, None], len(THRESHOLDS), 1)
    n_g, n_d = np.diff(g_at), np.diff(d_at)
    wide = 1 << np.ceil(np.log2(np.maximum(n_g, 1))).astype(np.int64)
    for width in np.unique(wide[(n_g > 0) & (n_d > 0)]):
        of_width = np.flatnonzero((wide == width) & (n_g > 0) & (n_d > 0))
        of_width = of_width[np.argsort(-n_d[of_width], kind="stable")]
        for k in range(0, len(of_width), step := max(1, PAIRS // int(width))):
            own = of_width[k : k + step]
            place = np.arange(width)
            valid = place < n_g[own, None]
            which = np.where(valid, g_at[own, None] + place, 0)
            box, ignored, many = g[which], ignore[which], crowd[which]
            used = np.zeros((len(THRESHOLDS), *valid.shape), bool)
            for i in range(n_d[own[0]]):
                n = np.count_nonzero(n_d[own] > i)  # groups come by their detections
                row = d_at[own[:n]] + i
                x, y, w, h = (c[:, None] for c in d[row].T)
                gx, gy, gw, gh = np.moveaxis(box[:n], 2, 0)
                both = np.clip(np.minimum(x + w, gx + gw) - np.maximum(x, gx), 0, None) * np.clip(np.minimum(y + h, gy + gh) - np.maximum(y, gy), 0, None)
                with np.errstate(divide="ignore", invalid="ignore"):
                    over = both / np.where(many[:n], w * h, w * h + gw * gh - both)
                # A truth that counts goes before one that is ignored; among equals the last best overlap.
                fits = (over >= at) & (~used[:, :n] | many[:n]) & valid[:n]
                real = fits & ~ignored[:n]
                of = np.where(real.any(2)[:, :, None], real, fits)
                t, q = np.nonzero(of.any(2))
                j = width - 1 - np.where(of[t, q], over[q], -1.0)[:, ::-1].argmax(1)
                used[t, q, j] = True
                hit[row[q], t] = True
                skip[row[q], t] = ignored[q, j]
    return hit, skip


def _small(box: Column) -> list[Column]:
    """A box as one number where its four are whole and below 2^15, else as it is; for the shuffle."""
    four = [F.get(box, F.lit(i)) for i in range(4)]
    whole = F.size(box) == 4
    for v in four:
        whole = whole & (v >= 0) & (v < 1 << 15) & (v == F.floor(v))
    number = sum((v.cast("long") * (1 << 15 * i) for i, v in enumerate(four[1:], 1)), four[0].cast("long"))
    return [F.when(whole, number).alias("whole"), F.when(F.coalesce(whole, F.lit(False)), None).otherwise(box).alias("bbox")]


def _sides() -> list[Column]:
    """The four of a box that `_small` gave, as columns; lists are slow on the way to a Python worker."""
    return [F.when(F.col("whole").isNull(), F.get("bbox", F.lit(i))).otherwise(F.shiftright("whole", 15 * i).bitwiseAND((1 << 15) - 1).cast("double")).alias(c) for i, c in enumerate("xywh")]


def _cut(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


#: Thresholds as bits of a number.
_BITS = 1 << np.arange(len(THRESHOLDS))
#: The kind of a detection; truths are of a number below, by ignored and crowd.
_FOUND = 4


def _starts(image: pa.Array, category: pa.Array, kind: pa.Array) -> np.ndarray:
    """Whether a row is the first of its image and class; truths without either meet no detection."""
    new = np.ones(len(image), bool)
    keys = [x for c in (image, category) for x in (c.fill_null(0).to_numpy(zero_copy_only=False), c.is_null().to_numpy(zero_copy_only=False))]
    side = (kind.to_numpy() == _FOUND) & (keys[1] | keys[3])
    new[1:] = np.any([c[1:] != c[:-1] for c in (*keys, side)], axis=0)
    return new


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows in tables that end where an image and class ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        rows = batch if not held else pa.Table.from_batches([held[-1].slice(len(held[-1]) - 1), batch]).combine_chunks().to_batches()[0]
        cuts = np.flatnonzero(_starts(*rows.columns[:3])[1:]) + 1 - (len(rows) - len(batch))
        if len(cuts):
            yield pa.Table.from_batches([*held, batch.slice(0, cuts[-1])])
            held = []
        held.append(batch.slice(cuts[-1]) if len(cuts) else batch)
    if held:
        yield pa.Table.from_batches(held)


def matched(truth: DataFrame, found: DataFrame, *, area: str = "all", max_dets: int = 100) -> DataFrame:
    """ML-11, first half: (category_id, image_id, score, rank, tp, ignored, positives) of each detection, and rows of rank -1 whose sum is the positives of a class.

    truth: image_id, category_id, bbox, area, iscrowd; found: image_id, category_id, bbox, score.
    tp and ignored have a bit for each of THRESHOLDS, so that a detection is one row.
    Boxes are dealt and sorted by image and class, which one picture bounds, and matched in Arrow batches.
    """
    lo, hi = AREAS[area]
    keys = [F.col("image_id").cast("long").alias("image_id"), F.col("category_id").cast("int").alias("category_id")]
    small = _small(F.col("bbox").cast("array<double>"))
    crowd = F.coalesce(F.col("iscrowd") == 1, F.lit(False))
    ignore = crowd | F.coalesce((F.col("area") < lo) | (F.col("area") > hi), F.lit(False))
    truths = truth.select(*keys, (ignore.cast("int") + 2 * crowd.cast("int")).alias("kind"), F.lit(None).cast("double").alias("score"), *small)
    dets = found.select(*keys, F.lit(_FOUND).alias("kind"), F.col("score").cast("double").alias("score"), *small)
    rows = truths.union(dets).repartition("image_id", "category_id").sortWithinPartitions("image_id", "category_id", "kind").select("image_id", "category_id", "kind", "score", *_sides())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            image, category, kind, score, *box = (c.combine_chunks() for c in table.columns)
            group = np.cumsum(_starts(image, category, kind)) - 1
            kind, score, box = kind.to_numpy(), score.to_numpy(zero_copy_only=False), np.column_stack([c.to_numpy(zero_copy_only=False) for c in box])
            t, d = np.flatnonzero(kind < _FOUND), np.flatnonzero(kind == _FOUND)
            t = t[np.lexsort((kind[t] & 2, *box[t].T[::-1], kind[t] & 1, group[t]))]
            d = d[np.lexsort((*box[d].T[::-1], -score[d], group[d]))]
            n_t, n_d = (np.bincount(group[x], minlength=group[-1] + 1) for x in (t, d))
            rank = np.arange(len(d)) - _cut(n_d)[group[d]]
            d, rank = d[rank < max_dets], rank[rank < max_dets]
            hit, skip = _hits(box[t], kind[t] & 1 > 0, kind[t] & 2 > 0, _cut(n_t), box[d], _cut(np.minimum(n_d, max_dets)), lo, hi)
            at = pa.array(d)
            yield pa.RecordBatch.from_arrays([category.take(at), image.take(at), pa.array(score[d]), pa.array(rank, pa.int32()), pa.array(hit @ _BITS, pa.int32()), pa.array(skip @ _BITS, pa.int32()), pa.array(np.zeros(len(d), np.int64))], names=names)
            # Of classes: their positives in this table.
            counts = pa.table({"c": category, "n": (kind & 1 | kind >> 2) ^ 1}).group_by("c").aggregate([("n", "sum")]).combine_chunks()
            none = np.zeros(len(counts), np.int32)
            of_class, n = (counts[c].combine_chunks() for c in ("c", "n_sum"))
            yield pa.RecordBatch.from_arrays([of_class, pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.float64()), pa.array(none - 1), pa.array(none), pa.array(none + int(_BITS.sum()), pa.int32()), n.cast(pa.int64())], names=names)

    names = ["category_id", "image_id", "score", "rank", "tp", "ignored", "positives"]
    return rows.mapInArrow(run, "category_id int, image_id long, score double, rank int, tp int, ignored int, positives long")


def by_threshold(matches: DataFrame) -> DataFrame:
    """The rows of `matched` once for each threshold, tp and ignored as booleans."""
    bits = F.array(*[F.struct(F.lit(t).alias("threshold"), (F.col("tp").bitwiseAND(1 << i) > 0).alias("tp"), (F.col("ignored").bitwiseAND(1 << i) > 0).alias("ignored")) for i, t in enumerate(THRESHOLDS)])
    return matches.select("image_id", "category_id", "score", "rank", "positives", F.inline(bits))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Detections in order as bits: for each run of a class in a batch and threshold, those that aren't ignored, set where they are hits."""
    block = 0
    for batch in batches:
        part, category, bits = batch.column(0), batch.column(1), batch.column(2).to_numpy()
        classes = category.to_numpy(zero_copy_only=False)
        ends = [*(np.flatnonzero(classes[1:] != classes[:-1]) + 1), len(classes)] if len(classes) else []
        rows: list[tuple] = []
        for a, b in zip([0, *ends], ends):
            for k, t in enumerate(THRESHOLDS):
                tp = (bits[a:b] >> (len(THRESHOLDS) + k) & 1)[(bits[a:b] >> k & 1) == 0].astype(np.uint8)
                rows.append((part[0].as_py(), category[int(a)].as_py(), t, block, np.packbits(tp).tobytes(), len(tp), int(tp.sum())))
            block += 1
        yield pa.RecordBatch.from_pylist([dict(zip(_BLOCK.names, r)) for r in rows], schema=_BLOCK)


_BLOCK = pa.schema([(PART, pa.int32()), ("category_id", pa.int32()), ("threshold", pa.float64()), ("block", pa.int64()), ("hits", pa.binary()), ("n", pa.int64()), ("n_tp", pa.int64())])


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(category_id, threshold, reach, precision): the best precision among the hits of a block whose recall reaches the same point."""
    for batch in batches:
        rows: list[tuple] = []
        for category, t, hits, n, tps, seen, positives in zip(*(c.to_pylist() for c in batch.columns)):
            place = np.flatnonzero(np.unpackbits(np.frombuffer(hits, np.uint8), count=n)) + 1
            if not len(place):
                continue
            nth = tps - len(place) + np.arange(1, len(place) + 1)
            reach = np.floor(nth * (RECALLS - 1) / positives + 1e-9).astype(np.int64)
            first = np.flatnonzero(np.diff(reach, prepend=-1))
            best = np.maximum.reduceat(nth / (seen - n + place), first)
            rows += [(category, t, int(r), float(p)) for r, p in zip(reach[first], best)]
        yield pa.RecordBatch.from_pylist([dict(zip(_REACHED.names, r)) for r in rows], schema=_REACHED)


_REACHED = pa.schema([("category_id", pa.int32()), ("threshold", pa.float64()), ("reach", pa.int64()), ("precision", pa.float64())])


def average_precision(matches: DataFrame) -> DataFrame:
    """ML-11, second half: ap by (category_id, threshold), of `matched`; null for classes without positives.

    Detections are range partitioned by class and score once for all thresholds: a
    class with any number of them is spread over tasks. A range keeps a bit for a
    detection and threshold, in blocks, and what blocks before hold is added to running
    counts. A recall point takes the best precision of the hits from the first that
    reaches it on, so that blocks send on the best of each point.
    """
    keys = ["category_id", "threshold"]
    scratch = Scratch(matches.sparkSession, "matches")
    matches = scratch.save(matches, compression="zstd")  # read three times
    positives = matches.where("rank < 0").groupBy("category_id").agg(F.sum("positives").alias("positives")).select("category_id", F.explode(F.array(*map(F.lit, THRESHOLDS))).alias("threshold"), "positives")
    wide = len(THRESHOLDS)
    # The rank in front orders equal scores of an image.
    bits = (F.col("rank").cast("long") * (1 << 2 * wide) + F.col("tp") * (1 << wide) + F.col("ignored")).alias("bits")
    order = [F.col("category_id"), F.col("score").desc(), F.col("image_id"), F.col("bits")]
    ranges = matches.where("rank >= 0").select("category_id", "score", "image_id", bits).repartitionByRange(*order).sortWithinPartitions(*order)
    kind = f"{PART} int, category_id int, threshold double, block long, hits binary, n long, n_tp long"
    blocks = scratch.save(ranges.select(F.spark_partition_id().alias(PART), "category_id", "bits").mapInArrow(_blocks, kind), compression="zstd")
    d = running(blocks, {"tps": F.col("n_tp"), "seen": F.col("n")}, by=keys, order=[F.col("block")])
    d = d.join(positives, keys).where("n_tp > 0 and positives > 0").select(*keys, "hits", "n", "tps", "seen", "positives")
    best = d.mapInArrow(_reached, "category_id int, threshold double, reach long, precision double").groupBy(*keys, "reach").agg(F.max("precision").alias("precision"))
    of_key = Window.partitionBy(*keys)  # RECALLS rows at most
    envelope = F.max("precision").over(of_key.orderBy(F.col("reach").desc()).rowsBetween(Window.unboundedPreceding, 0))
    points = F.col("reach") - F.lag("reach", 1, -1).over(of_key.orderBy("reach"))
    total = best.select(*keys, envelope.alias("envelope"), points.alias("points")).groupBy(*keys).agg((F.sum(F.col("points") * F.col("envelope")) / RECALLS).alias("ap"))
    return positives.join(total, keys, "left").withColumn("ap", F.when(F.col("positives") > 0, F.coalesce("ap", F.lit(0.0))))


def per_class(ap: DataFrame, recall: DataFrame) -> DataFrame:
    """ML-11, ML-12: (category_id, ap, ap50, ap75, ar): means over thresholds for each class; null for classes without positives."""
    at = lambda t: F.avg(F.when(F.abs(F.col("threshold") - t) < 1e-9, F.col("ap")))
    cells = ap.groupBy("category_id").agg(F.avg("ap").alias("ap"), at(0.5).alias("ap50"), at(0.75).alias("ap75"))
    return cells.join(recall.groupBy("category_id").agg(F.avg("recall").alias("ar")), "category_id")


def average_recall(matches: DataFrame) -> DataFrame:
    """ML-12: recall by (category_id, threshold), of `by_threshold`: the share of positives that some detection hits, with the number of detections that `matched` was given; null without positives."""
    hits = F.count_if((F.col("rank") >= 0) & F.col("tp") & ~F.col("ignored"))
    found = matches.groupBy("category_id", "threshold").agg(hits.alias("hits"), F.sum("positives").alias("positives"))
    return found.select("category_id", "threshold", F.when(F.col("positives") > 0, F.col("hits") / F.col("positives")).alias("recall"))


def summary(ap: DataFrame) -> DataFrame:
    """AGG-12: mean over defined cells; NaN where there is none."""
    at = lambda t: F.avg(F.when(F.abs(F.col("threshold") - t) < 1e-9, F.col("ap")))
    nan = F.lit(float("nan"))
    return ap.agg(F.coalesce(F.avg("ap"), nan).alias("ap"), F.coalesce(at(0.5), nan).alias("ap50"), F.coalesce(at(0.75), nan).alias("ap75"))


def class_scores(pairs: DataFrame, *, truth: str, predicted: str) -> DataFrame:
    """ML-12: precision, recall and F1 of each class of rows (truth, predicted)."""
    cells = pairs.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    by_t = cells.groupBy(F.col(truth).alias("class")).agg(F.sum("n").alias("actual"), F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)).alias("tp"))
    by_p = cells.groupBy(F.col(predicted).alias("class")).agg(F.sum("n").alias("claimed"))
    s = by_t.join(by_p, "class", "full").na.fill(0)
    p, r = F.coalesce(F.col("tp") / F.nullif("claimed", F.lit(0)), F.lit(0.0)), F.coalesce(F.col("tp") / F.nullif("actual", F.lit(0)), F.lit(0.0))
    return s.withColumns({"precision": p, "recall": r}).withColumn("f1", F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)))
