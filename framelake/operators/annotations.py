"""Merging, remapping and auditing of object annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.names import map_class
from framelake.operators.frames import frames_at
from framelake.operators.order import parted, ranked, running


def bucketed(annotations: DataFrame, name: str, rules=None) -> DataFrame:
    """JOIN-03/10: annotations with `bucket`, null for names that no rule maps. Rules become one CASE, no join."""
    return annotations.withColumn("bucket", map_class(F.col(name), rules) if rules else map_class(F.col(name)))


def dropped_classes(annotations: DataFrame, name: str) -> DataFrame:
    """AGG-08: how many annotations of each unmapped name."""
    return annotations.where("bucket is null").groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def class_counts(annotations: DataFrame, classes: DataFrame) -> DataFrame:
    """FIL-16: a count for each class (class), 0 for those without annotations."""
    n = annotations.groupBy(F.col("bucket").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return classes.join(n, "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"))


def merged(images: DataFrame, annotations: DataFrame, *, image: str = "image_id") -> tuple[DataFrame, DataFrame]:
    """JOIN-02: (images with a mapped annotation, mapped annotations with an image)."""
    mapped = annotations.where("bucket is not null")
    return images.join(mapped.select(image).distinct(), image, "left_semi"), mapped.join(images.select(image).distinct(), image, "left_semi")


def image_record(id_: Column, name: Column, width: Column, height: Column, license_: Column | None = None, captured: Column | None = None) -> Column:
    """PRJ-01: coerced fields with defaults."""
    return F.struct(
        id_.cast("long").alias("id"), name.cast("string").alias("file_name"), F.coalesce(width.cast("int"), F.lit(0)).alias("width"), F.coalesce(height.cast("int"), F.lit(0)).alias("height"),
        F.coalesce(license_ if license_ is not None else F.lit(None).cast("int"), F.lit(0)).alias("license"), F.coalesce(captured if captured is not None else F.lit(None).cast("string"), F.lit("")).alias("date_captured"),
    )


def annotation_record(id_: Column, image: Column, category: Column, box: Column, area: Column, crowd: Column, segments: Column | None = None) -> Column:
    """PRJ-02: area 0.0, crowd 0 and no segmentation by default."""
    return F.struct(
        id_.cast("long").alias("id"), image.cast("long").alias("image_id"), category.cast("int").alias("category_id"), box.cast("array<double>").alias("bbox"),
        F.coalesce(area.cast("double"), F.lit(0.0)).alias("area"), F.coalesce(crowd.cast("int"), F.lit(0)).alias("iscrowd"),
        F.coalesce(segments if segments is not None else F.lit(None).cast("array<array<double>>"), F.array().cast("array<array<double>>")).alias("segmentation"),
    )


def reassigned_ids(rows: DataFrame, *, part: str, order: list[str], name: str) -> DataFrame:
    """WIN-07: numbers from 1 over all parts in (part, order); no window holds all rows, or a part's."""
    return ranked(rows, F.col(part), *[F.col(c) for c in order], name=name)


def renumbered(images: DataFrame, annotations: DataFrame, *, part: str, image: str, annotation: str) -> tuple[DataFrame, DataFrame]:
    """WIN-07 for both: images (image) as `new_image_id`, annotations (image, annotation) as `new_id` in the order of their images."""
    numbered = reassigned_ids(images, part=part, order=[image], name="new_image_id")
    joined = annotations.join(numbered.select(image, "new_image_id"), image)
    return numbered, ranked(joined, F.col("new_image_id"), F.col(annotation), name="new_id")


def grand_total(counts: DataFrame, n: str = "n") -> DataFrame:
    """AGG-11: the sum of the counts, 0 without any."""
    return counts.agg(F.coalesce(F.sum(n), F.lit(0)).alias("total"))


def above(found: DataFrame, threshold: float, column: str = "score") -> DataFrame:
    """FIL-09: detections whose score reaches the threshold."""
    return found.where(F.col(column) >= threshold)


def with_image(rows: DataFrame, files: DataFrame, *, on: str) -> DataFrame:
    """FIL-13: rows whose image is there; the others are skipped."""
    return rows.join(files.select(on).distinct(), on, "left_semi")


def zipped(left: Column, right: Column, names: tuple[str, str]) -> Column:
    """JOIN-12: the elements of two arrays by place, as structs; arrays of different lengths are an error as the query runs."""
    pairs = F.transform(F.arrays_zip(left.alias("a"), right.alias("b")), lambda p: F.struct(p["a"].alias(names[0]), p["b"].alias(names[1])))
    return F.when(F.size(left) == F.size(right), pairs).otherwise(F.raise_error(F.lit("arrays of different lengths")))


def background_sizes(backgrounds: DataFrame, frames: DataFrame, *, by: str, path: str, width: str, height: str) -> DataFrame:
    """JOIN-11: each background (by, width, height) beside the first frame by path of its folder, and whether it is smaller in either way."""
    first = frames.groupBy(by).agg(F.min(F.struct(path, width, height)).alias("_f"))
    joined = backgrounds.select(by, width, height).join(first, by)
    small = (F.col(width) < F.col(f"_f.{width}")) | (F.col(height) < F.col(f"_f.{height}"))
    return joined.select(by, F.col(f"_f.{path}").alias("first_frame"), width, height, F.col(f"_f.{width}").alias("frame_width"), F.col(f"_f.{height}").alias("frame_height"), small.alias("too_small"))


def audit(annotations: DataFrame, *, split: str, label: str, source: str) -> DataFrame:
    """AGG-05: counts by split, class, split and class, source, source and class, and in all, in one pass."""
    sets = [(split,), (label,), (split, label), (source,), (source, label), ()]
    columns = [F.col(split), F.col(label), F.col(source)]
    return annotations.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


def with_percent(counts: DataFrame, n: str = "n") -> DataFrame:
    """AGG-06: share of the total in percent, 0 if the total is. The total is one row, joined by a constant key."""
    total = counts.agg(F.sum(n).alias("_total")).withColumn("_k", F.lit(0))
    joined = counts.withColumn("_k", F.lit(0)).join(F.broadcast(total), "_k").drop("_k")
    return joined.withColumn("percent", F.coalesce(100.0 * F.col(n) / F.nullif("_total", F.lit(0)), F.lit(0.0))).drop("_total")


def pivoted(rows: DataFrame, *, by: str, label: str, classes: list) -> DataFrame:
    """AGG-07: a column for each class, 0 by default."""
    return rows.groupBy(by).pivot(label, classes).count().na.fill(0)


def per_image(detections: DataFrame, *, image: str, label: str) -> DataFrame:
    """AGG-10/18: counts by class as a map, and the number of detections, for each image."""
    n = detections.groupBy(image, label).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(image).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(label, "n")))).alias("counts"), F.sum("n").alias("total"))


def class_label(class_id: Column, names: Column) -> Column:
    """PRJ-03: the name at an index, from the end for negative ones, else class_<id>."""
    at = F.when(class_id >= 0, F.get(names, class_id)).otherwise(F.get(names, F.size(names) + class_id))
    return F.coalesce(at, F.concat(F.lit("class_"), class_id.cast("string")))


#: Places of others that are searched together.
BUCKET = 1_000


def other_group_pick(items: DataFrame, pool: DataFrame, *, group: str, item: str, choice: str, seed: str) -> DataFrame:
    """JOIN-08: for each item a pool entry of another group, by hash order; one of any group if no other is there, null without a pool.

    The pool is ranked by hash. The k-th entry that is not of a group has a rank that
    grows by one behind each entry of the group, so an item finds it by the last of the
    group's own entries that k lies behind (an as-of join in buckets of k, so that a hot
    group is spread), and then by rank: nothing is gathered, crossed or broadcast but a count.
    """
    text = lambda c: F.md5(F.concat_ws("|", F.lit(seed), F.col(c).cast("string")).cast("binary"))
    entries = ranked(pool.select(F.col(group).alias("_g"), F.col(choice).alias("background"), text(choice).alias("_h")), F.col("_h"), F.col("background"), F.col("_g"), name="_rank")
    total = entries.agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(0))
    sizes = entries.groupBy("_g").agg(F.count(F.lit(1)).alias("_m"))
    # Behind j entries of its own, a group sees the places from rank - j on of the others.
    numbered = running(parted(entries.select("_g", "_rank"), F.col("_g"), F.col("_rank")), {"_j": F.lit(1).cast("long")}, by=["_g"], order=[F.col("_rank")])
    steps = numbered.where(F.col("_g").isNotNull()).select(F.col("_g").alias("_of"), (F.col("_rank") - F.col("_j")).cast("double").alias("_lo"), "_j")
    rows = items.withColumn("_one", F.lit(0)).join(F.broadcast(total), "_one").join(sizes.withColumnRenamed("_g", "_s"), F.col(group) == F.col("_s"), "left")
    others = F.col("_n") - F.coalesce("_m", F.lit(0))
    at = F.conv(F.substring(text(item), 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("_others", others).withColumn("_k", F.when(F.col("_n") > 0, F.pmod(at, F.when(F.col("_others") > 0, F.col("_others")).otherwise(F.greatest("_n", F.lit(1))))))
    asked = rows.where("_others > 0").select(F.col(group).alias("_of"), F.col("_k").cast("double").alias("_place")).where("_of is not null").distinct()
    behind = frames_at(steps, asked, by="_of", seconds="_lo", at="_place", bucket=float(BUCKET)).select("_of", "_place", "_j")
    rows = rows.join(behind, (F.col(group) == F.col("_of")) & (F.col("_k").cast("double") == F.col("_place")) & (F.col("_others") > 0), "left").withColumn("_at", F.col("_k") + F.coalesce("_j", F.lit(0)) + 1)
    return rows.select(*items.columns, "_at").join(entries.select("_rank", "background"), F.col("_at") == F.col("_rank"), "left").select(*items.columns, "background")
