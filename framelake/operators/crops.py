"""Training crops: seeded windows around a component, with swapped backgrounds.

A crop depends on its number, the seed and the epoch alone, so any executor makes
the same one, and a lost task makes it again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from framelake.operators import raster

SCHEMA = """idx long, video_id string, frame_id string, image binary, classes binary, bbox array<float>, peak array<int>, swapped boolean, error string"""
#: Backgrounds are broadcast; a pool over this size is an error, not a silent cut.
POOL_BYTES = 64 << 20


@dataclass(frozen=True)
class CropRule:
    """STM-09, DQ-09: what decides a crop."""

    size: int = 128
    min_area: int = 0
    swap_probability: float = 0.5
    seed: int = 0
    epoch: int = 0

    def rng(self, idx: int, offset: int) -> np.random.Generator:
        """Streams of a crop: 0 picks the component, 1 swaps, 2 places (and moves with the epoch)."""
        return np.random.default_rng(self.seed + idx + offset + (self.epoch if offset == 2 else 0))


Pool = list[tuple[str, np.ndarray]]


def chosen_background(pool: Pool, video: str, rng: np.random.Generator) -> np.ndarray:
    """JOIN-08: of another video if there is one; a lone background always."""
    if len(pool) == 1:
        return pool[0][1]
    usable = [image for v, image in pool if v != video] or [image for _, image in pool]
    return usable[int(rng.integers(0, len(usable)))]


def make_crop(image: np.ndarray, mask: np.ndarray, video: str, idx: int, rule: CropRule, pool: Pool) -> dict:
    """PRJ-04, IMG-08/09: crop, classes, and box and centre in crop coordinates."""
    found = raster.components(mask, rule.min_area)
    if not found:
        raise ValueError("no component")
    x, y, w, h, _ = found[int(rule.rng(idx, 0).integers(0, len(found)))]
    cx, cy, _, _ = raster.crop_center(mask, rule.size, rule.rng(idx, 2))
    x0, y0 = cx - rule.size // 2, cy - rule.size // 2
    swap, probability = rule.rng(idx, 1), rule.swap_probability if pool else 0.0
    swapped = probability > 0 and bool(swap.random() < probability)
    if swapped:
        image = raster.swapped(image, mask, chosen_background(pool, video, swap))
    return {
        "image": raster.cropped(image, x0, y0, rule.size), "classes": raster.mask_classes(raster.cropped(mask, x0, y0, rule.size)).astype(np.uint8),
        "bbox": [float(x - x0), float(y - y0), float(x + w - x0), float(y + h - y0)], "peak": [cy - y0, cx - x0], "swapped": swapped,
    }


def crops(items: DataFrame, backgrounds: DataFrame, rule: CropRule, transform: Callable[[dict], dict] | None = None) -> DataFrame:
    """UDF-01, STM-10: a crop for each row (idx, video_id, frame_id, frame, mask, h, w); a failure is a row with `error`.

    frame: h x w x 3 bytes; backgrounds (video_id, frame, h, w) are a bounded pool. transform gets and returns the item.
    """
    from pyspark.sql import functions as F

    total = backgrounds.agg(F.sum(F.octet_length("frame"))).first()[0] or 0
    if total > POOL_BYTES:
        raise ValueError(f"the background pool has {total} bytes, more than {POOL_BYTES}")
    pool = sorted(((r.video_id, np.frombuffer(bytes(r.frame), np.uint8).reshape(r.h, r.w, 3)) for r in backgrounds.collect()), key=lambda p: p[0])
    shared = items.sparkSession.sparkContext.broadcast(pool)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                try:
                    image = np.frombuffer(r.frame, np.uint8).reshape(r.h, r.w, 3)
                    item = make_crop(image, np.frombuffer(r.mask, np.uint8).reshape(r.h, r.w), r.video_id, int(r.idx), rule, shared.value)
                    item = transform(item) if transform else item
                    rows.append((r.idx, r.video_id, r.frame_id, item["image"].tobytes(), item["classes"].tobytes(), item["bbox"], item["peak"], item["swapped"], None))
                except (ValueError, TypeError, AttributeError) as e:
                    rows.append((r.idx, r.video_id, r.frame_id, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["idx", "video_id", "frame_id", "image", "classes", "bbox", "peak", "swapped", "error"])

    return items.select("idx", "video_id", "frame_id", "frame", "mask", "h", "w").mapInPandas(run, SCHEMA)
