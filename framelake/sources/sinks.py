"""Writers: line records, annotation documents, partitions that are replaced or skipped."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions.names import to_tenths

def append_manifest(records: DataFrame, path: str, batch: int) -> None:
    """SNK-01: null fields are left out; batch, which grows from call to call, and the record's number in it order the records."""
    numbered = records.withColumns({"batch": F.lit(batch).cast("long"), "number": F.monotonically_increasing_id()})
    numbered.select(*sorted(numbered.columns)).write.mode("append").option("ignoreNullFields", True).json(path)


def save_state(spark: SparkSession, path: str, signature: str, next_day_index: int) -> None:
    """SNK-04: the scheduler's position as one small file."""
    replace_file(spark, path, (json.dumps({"next_day_index": next_day_index, "signature": signature}) + "\n").encode())


def replace_file(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file in place of the one that is there."""
    replaced(spark, path, [data])


def replaced(spark: SparkSession, path: str, pieces: list) -> None:
    """A file of bytes and of files (Hadoop paths, which are streamed), written beside and renamed over the one that is there, in one step: a reader sees the old one or the new one, whenever the writer breaks off."""
    sc = spark.sparkContext
    fs = sc._jvm.org.apache.hadoop.fs
    at, part = fs.Path(path), fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(part, True)
    for piece in pieces:
        if isinstance(piece, bytes):
            out.write(bytearray(piece))
        else:
            source = piece.getFileSystem(sc._jsc.hadoopConfiguration()).open(piece)
            sc._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
            source.close()
    out.close()
    how = sc._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    how[0] = getattr(fs, "Options$Rename").OVERWRITE
    fs.FileContext.getFileContext(at.toUri() if at.toUri().getScheme() else fs.FileSystem.getDefaultUri(sc._jsc.hadoopConfiguration()), sc._jsc.hadoopConfiguration()).rename(part, at, how)


def fetched(wanted: DataFrame, fetch: Callable[[str], bytes], *, key: str = "path") -> DataFrame:
    """SNK-05: key, size_bytes and status (downloaded or failed, with reason) of files that `fetch` gets and writes beside their path, then renames.

    A file that is there counts as downloaded; a part that fails is deleted. The
    paths are on a file system that all executors mount.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_fetch_one(p, fetch) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string())))], names=[key, "size_bytes", "status", "reason"])

    return wanted.select(key).mapInArrow(run, f"{key} string, size_bytes long, status string, reason string")


def _fetch_one(path: str, fetch: Callable[[str], bytes]) -> tuple[int | None, str, str | None]:
    if os.path.exists(path):
        return os.path.getsize(path), "downloaded", None
    part = f"{path}.{uuid.uuid4().hex}.part"  # two attempts of a task don't share a part
    try:
        data = fetch(path)
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
        return len(data), "downloaded", None
    except Exception as e:  # noqa: BLE001  any failure of one file is a row, and leaves no part
        if os.path.exists(part):
            os.remove(part)
        return None, "failed", str(e)


def video_variants(frames: DataFrame, variants: dict[str, Column]) -> DataFrame:
    """SNK-12: a row (video, frame_idx, variant, pixels) for each rendered form of a frame."""
    forms = F.array(*[F.struct(F.lit(name).alias("variant"), pixels.alias("pixels")) for name, pixels in variants.items()])
    return frames.select("video", "frame_idx", F.inline(forms))


def background_rows(frames: DataFrame, *, by: str = "video") -> DataFrame:
    """SNK-09: a video's background, the model after its last frame: one row a video."""
    return frames.groupBy(by).agg(F.max_by("background", "idx").alias("background"))


def ranked_report(ranked: DataFrame) -> DataFrame:
    """SNK-15: lines of the ranked table (rank, video, sharpness, motion, brightness, hive_id) in columns."""
    line = F.format_string("%4d  %-55s  %8.2f  %8.3f  %8.2f  %s", "rank", "video", "sharpness", "motion", "brightness", "hive_id")
    return ranked.select("rank", line.alias("line"))


def audit_report(images: DataFrame, annotations: DataFrame, classes: list[str]) -> DataFrame:
    """SNK-15: the audit of a merged dataset as lines (section, name, line), to be read by section and name.

    images: split, source; annotations: split, source, label. Sections: `1 images` and
    `2 annotations` by split, `3 classes` with their share in percent (0.0 without
    annotations), `4 splits` and `5 sources` with counts by class, 0 by default.
    Labels beyond `classes` count in totals only. Both tables are read once and
    counted map-side; everything after is as small as the report.
    """
    n_images = images.groupBy("split", "source").agg(F.count(F.lit(1)).alias("_i"))
    each = [F.count_if(F.col("label") == c).alias(f"_c{k}") for k, c in enumerate(classes)]
    n_labels = annotations.groupBy("split", "source").agg(F.count(F.lit(1)).alias("_a"), *each)
    counts = [f"_c{k}" for k in range(len(classes))]
    zero = [F.lit(0).cast("long").alias(c) for c in ("_a", *counts)]
    both = n_images.select("split", "source", "_i", *zero).unionByName(n_labels.withColumn("_i", F.lit(0).cast("long")))
    added = [F.sum(c).alias(c) for c in ("_i", "_a", *counts)]
    splits, sources, whole = both.groupBy("split").agg(*added), both.groupBy("source").agg(*added), both.agg(*added).na.fill(0)
    row = lambda section, name, line: F.struct(F.lit(section).alias("section"), name.alias("name"), line.alias("line"))
    listed = F.concat_ws(", ", *[F.format_string(f"{c.replace('%', '%%')}=%d", n) for c, n in zip(classes, counts)])
    by_split = F.array(
        row("1 images", F.col("split"), F.format_string("  %-5s: %d", "split", "_i")), row("2 annotations", F.col("split"), F.format_string("  %-5s: %d", "split", "_a")),
        row("4 splits", F.col("split"), F.concat(F.format_string("  %-5s: ", "split"), listed)),
    )
    wide = F.format_string("  %-48s %7d %7d  " + "  ".join(["%7d"] * len(classes)), "source", "_i", "_a", *counts)
    labelled = sum((F.col(c) for c in counts), F.lit(0))
    share = lambda n: to_tenths(F.coalesce(100.0 * F.col(n) / F.nullif(labelled, F.lit(0)), F.lit(0.0)))
    by_class = F.array(*[row("3 classes", F.lit(c), F.format_string("  %-6s %6d  %5.1f%%", F.lit(c), n, share(n))) for c, n in zip(classes, counts)])
    parts = [whole.select(F.inline(by_class)), splits.select(F.inline(by_split)), sources.select(F.inline(F.array(row("5 sources", F.col("source"), wide))))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def probe_report(rows: DataFrame, path: str) -> None:
    """SNK-14: probe rows as lines, those that failed with their `errors`."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def json_lines(rows: DataFrame, path: str) -> None:
    """SNK-02/13/14."""
    rows.write.mode("overwrite").json(path)


def dataset_manifest(totals: DataFrame, version: str, frames_dir: str, commit: str | None) -> DataFrame:
    """SNK-03: the totals row with version, time and origin."""
    return totals.withColumns({"version": F.lit(version), "created_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"), "frames_dir": F.lit(frames_dir), "git_commit": F.lit(commit).cast("string")})


def coco_documents(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """SNK-06: one JSON document a split, of structs (split, record); a document is one value, as the format demands."""
    i = images.groupBy("split").agg(F.sort_array(F.collect_list("record")).alias("images"))
    a = annotations.groupBy("split").agg(F.sort_array(F.collect_list("record")).alias("annotations"))
    c = categories.agg(F.sort_array(F.collect_list(F.struct(*categories.columns))).alias("categories")).withColumn("_k", F.lit(0))
    joined = i.join(a, "split", "left").withColumn("_k", F.lit(0)).join(F.broadcast(c), "_k")
    return joined.select("split", F.to_json(F.struct("categories", "images", "annotations")).alias("value"))


def write_document(parts: dict[str, DataFrame], path: str, *, order: dict[str, list[str]]) -> None:
    """SNK-06 for documents of any size: one JSON object at path, with a list of the rows of each table, in its order.

    Tasks write the lines of a list in ordered parts, each line but a list's first with
    its comma; a commit step then streams head, parts and tail into one file beside
    path and renames it, so no row, task or process holds a document. Nulls are written.
    """
    from framelake.operators.order import PART, parted
    from framelake.scratch import Scratch

    spark = next(iter(parts.values())).sparkSession
    sc, scratch = spark.sparkContext, Scratch(spark, "document")
    hadoop, conf = sc._jvm.org.apache.hadoop, sc._jsc.hadoopConfiguration()
    pieces: list[bytes | object] = []
    for i, (name, rows) in enumerate(parts.items()):
        pieces.append(("{" if i == 0 else "], ").encode() + json.dumps(name).encode() + b": [")
        columns = [F.col(c) for c in order[name]]
        numbered = parted(rows, *columns)
        first = numbered.agg(F.min(PART)).first()[0]
        line = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
        head = F.row_number().over(Window.partitionBy(PART).orderBy(*columns)) == 1
        lines = numbered.withColumn("_comma", ~(head & (F.col(PART) == F.lit(first)))).select(PART, *[c.alias(f"_o{k}") for k, c in enumerate(columns)], F.concat(F.when(F.col("_comma"), ", ").otherwise(""), line).alias("value"))
        at = f"{scratch.root}/{name}"
        sorted_lines = lines.repartition(PART).sortWithinPartitions(PART, *[f"_o{k}" for k in range(len(columns))])
        sorted_lines.select(PART, "value").write.partitionBy(PART).option("lineSep", "\n").text(at)
        fs = hadoop.fs.Path(at).getFileSystem(conf)
        folders = sorted((f.getPath() for f in fs.listStatus(hadoop.fs.Path(at)) if f.isDirectory()), key=lambda p: int(p.getName().split("=")[1]))
        pieces += [f.getPath() for d in folders for f in sorted(fs.listStatus(d), key=lambda f: f.getPath().getName()) if f.getPath().getName().startswith("part-")]
    pieces.append(b"]}\n")
    replaced(spark, path, pieces)


def write_by_split(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").partitionBy("split").text(path)


def replace_videos(frames: DataFrame, path: str) -> None:
    """SNK-08/17: frames by video; videos that are written again are replaced, others stay."""
    frames.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video").parquet(path)


def skip_existing(frames: DataFrame, present: DataFrame) -> DataFrame:
    """SNK-07/17: frames of videos that aren't there yet."""
    return frames.join(present.select("video").distinct(), "video", "left_anti")


def curated_list(ranked: DataFrame, path: str, header: str) -> None:
    """SNK-10: a header and the paths in rank order, as one small text."""
    lines = ranked.groupBy().agg(F.concat_ws("\n", F.lit(f"# {header}"), F.transform(F.sort_array(F.collect_list(F.struct("rank", "path"))), lambda s: s["path"])).alias("value"))
    lines.write.mode("overwrite").text(path)
