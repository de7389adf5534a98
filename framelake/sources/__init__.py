"""Readers: files by convention, tolerant records, nested annotation documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions.names import FRAME_NAME, IMAGE_EXTENSIONS, VIDEO_EXTENSIONS, base_name, stem
from framelake.operators.order import ranked

STATUSES = ("downloaded", "unavailable", "failed")
#: Fields of a record that must be text, those that may be anything, and the numbers that `append_manifest` adds.
KEYS, OTHERS, NUMBERS = ("status", "hive", "day", "time"), ("path", "reason"), ("batch", "number")
COCO = """images array<struct<id:bigint,file_name:string,width:int,height:int,license:int,date_captured:string>>,
 annotations array<struct<id:bigint,image_id:bigint,category_id:int,bbox:array<double>,area:double,segmentation:string,iscrowd:int>>,
 categories array<struct<id:int,name:string,supercategory:string>>"""


def listing(spark: SparkSession, root: str, extensions: tuple[str, ...] = (), recursive: bool = True) -> DataFrame:
    """path, folder, name, size_bytes, mtime of files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))
    files = files.withColumns({"name": base_name(F.col("path")), "folder": F.regexp_replace("path", "/[^/]*$", "")})
    return files.where(F.lower("name").rlike("(" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$")) if extensions else files


def videos(spark: SparkSession, root: str) -> DataFrame:
    """SRC-03, FIL-03, SRT-03: the videos of a folder, by path."""
    return listing(spark, root, VIDEO_EXTENSIONS, recursive=False).orderBy("path")


def find_videos(spark: SparkSession, path: str) -> DataFrame:
    """SRC-04: a single file as it is, else the videos of a folder; a folder without videos is an error."""
    if base_of(path) and listing(spark, path, recursive=False).where(F.col("path").endswith("/" + base_of(path))).limit(2).count() == 1:
        return listing(spark, path, recursive=False)
    found = videos(spark, path)
    if found.isEmpty():
        raise ValueError(f"no videos in {path}")
    return found


def base_of(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2]


def images(spark: SparkSession, root: str, n: int | None = None) -> DataFrame:
    """SRC-19, SRT-03/07: the images of a folder by path, the first n."""
    found = listing(spark, root, IMAGE_EXTENSIONS, recursive=False).orderBy("path")
    return found if n is None else found.limit(n)


def video_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC-05: paths of a text list, without blanks and `#` lines; order is kept in `line`. The list is hand-written and small."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "path"))
    return lines.withColumn("path", F.trim("path")).where("path <> '' and not startswith(path, '#')")


def checked_list(listed: DataFrame, files: DataFrame) -> DataFrame:
    """SRC-05: the listed paths; one that isn't there, or is no video, is an error as the query runs."""
    there = files.select(F.col("path").alias("_path")).distinct()
    joined = listed.join(there, F.col("path") == F.col("_path"), "left")
    is_video = F.lower("path").rlike("(" + "|".join(e.replace(".", r"\.") for e in VIDEO_EXTENSIONS) + ")$")
    problem = F.when(F.col("_path").isNull(), F.concat(F.lit("listed video not found: "), "path")).when(~is_video, F.concat(F.lit("listed file is no video: "), "path"))
    return joined.where(F.when(problem.isNotNull(), F.raise_error(problem).isNull()).otherwise(True)).drop("_path")


def missing_from(listed: DataFrame, files: DataFrame) -> DataFrame:
    """SRC-05: listed paths that aren't there; must be empty."""
    return listed.join(files.select("path").distinct(), "path", "left_anti")


def samples(files: DataFrame) -> DataFrame:
    """SRC-01, JOIN-01: frames whose mask `<stem>_mask.png` lies beside them: video_id, frame_id and both paths."""
    named = files.withColumn("stem", stem(F.col("path")))
    ext = "(" + "|".join(e.replace(".", r"\.") for e in IMAGE_EXTENSIONS) + ")$"
    masks = named.where(F.lower("name").endswith("_mask.png")).select("folder", F.regexp_replace("stem", "_mask$", "").alias("stem"), F.col("path").alias("mask_path"))
    frames = named.where(F.lower("name").rlike(ext) & ~F.col("stem").endswith("_mask"))
    return frames.join(masks, ["folder", "stem"]).select(base_name(F.col("folder")).alias("video_id"), F.col("stem").alias("frame_id"), F.col("path").alias("frame_path"), "mask_path")


def backgrounds(files: DataFrame) -> DataFrame:
    """SRC-02."""
    return files.where("name = 'background.png'").select(base_name(F.col("folder")).alias("video_id"), "path")


def frame_index(files: DataFrame) -> DataFrame:
    """SRC-15, FIL-04, SRT-04: frames by name pattern, with their number."""
    return files.where(F.col("name").rlike(FRAME_NAME)).select(base_name(F.col("folder")).alias("video"), F.col("path").alias("frame_path"), F.regexp_extract("name", FRAME_NAME, 1).try_cast("long").alias("frame_idx"), "size_bytes", F.col("mtime").cast("double").alias("mtime"))


def line_order():
    """The place of a line in files that are read by lines: time and path of its file, its block, its place in it."""
    m = "_metadata"
    return F.struct(F.col(f"{m}.file_modification_time").alias("at"), F.col(f"{m}.file_path").alias("file"), F.col(f"{m}.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """SRC-09, FIL-14: valid records in order (`seq`); bad lines, unknown statuses and keys that are missing or no text are skipped.

    Records are ordered by the batch and number that `append_manifest` writes, and
    those without by the place of their line; files are split over tasks.
    """
    raw = spark.read.text(path).select("value", line_order().alias("place"))
    rows = raw.select("place", F.try_parse_json("value").alias("r")).select("place", *_fields(F.col("r")))
    seq = F.struct(F.coalesce("batch", F.lit(-1)).alias("batch"), F.coalesce("number", F.lit(-1)).alias("number"), "place")
    good = rows.where(F.col("status").isin(*STATUSES)).where("hive is not null and day is not null and time is not null")
    return good.withColumn("seq", seq).drop("batch", "number", "place")


def _fields(record: Column) -> list[Column]:
    """The columns of a parsed record: keys only if they are text (a number or a list isn't taken for one), other fields as text."""
    at = lambda name, kind: F.try_variant_get(record, f"$.{name}", kind)
    text = [F.when(F.schema_of_variant(at(k, "variant")) == "STRING", at(k, "string")).alias(k) for k in KEYS]
    return text + [at(k, "string").alias(k) for k in OTHERS] + [at(k, "bigint").alias(k) for k in NUMBERS]


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def next_day_index(spark: SparkSession, path: str, signature: str) -> int:
    """SRC-10: the saved position, 0 if there is none for this signature."""
    if not exists(spark, path):
        return 0
    row = spark.read.schema("signature string, next_day_index int").json(path).where(F.col("signature") == signature).first()
    return max(0, row.next_day_index or 0) if row else 0


def coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SRC-11: images, annotations and categories of annotation documents."""
    doc = spark.read.schema(COCO).option("multiLine", True).json(path)
    return tuple(doc.select(F.inline(c)) for c in ("images", "annotations", "categories"))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """SRC-12: a YAML list of workspace, project, version, note."""
    import yaml

    text = "\n".join(r[0] for r in spark.read.text(path).collect())  # a hand-written list
    items = yaml.safe_load(text)
    if not isinstance(items, list):
        raise ValueError("the registry must be a list")
    rows = [(i["workspace"], i["project"], None if i.get("version") is None else str(i["version"]), i.get("note")) for i in items]
    return spark.createDataFrame(rows, "workspace string, project string, version string, note string")


def pairs(lines: DataFrame) -> DataFrame:
    """SRC-20: workspace and project of `workspace/project` lines (value)."""
    return lines.where(F.instr("value", "/") > 0).select(F.split_part("value", F.lit("/"), F.lit(1)).alias("workspace"), F.split_part("value", F.lit("/"), F.lit(2)).alias("project"))


def frame_groups(index: DataFrame, root: str) -> DataFrame:
    """SRC-16, SRT-04: frames (frame_path, frame_idx) by folder: those of root itself if it holds any, else of its children; none is an error."""
    top = root.rstrip("/")
    folder = F.regexp_replace("frame_path", "/[^/]*$", "")
    parent = F.regexp_replace(folder, "/[^/]*$", "")
    own = index.withColumn("folder", folder)
    is_top = lambda c: (c == top) | c.endswith("/" + top.lstrip("/"))  # noqa: E731  a root without its scheme
    direct = own.where(is_top(F.col("folder")))
    found = direct if not direct.isEmpty() else own.where(is_top(parent))
    if found.isEmpty():
        raise ValueError(f"no frames in {root}")
    return found.withColumn("place", F.row_number().over(Window.partitionBy("folder").orderBy("frame_idx", "frame_path")))


def item(rows: DataFrame, idx: int, order: str) -> DataFrame:
    """UDF-02: the row at a place in the order, from the end for negative ones; rows are numbered in parts, not sorted in one task."""
    n = rows.count()
    at = idx + n if idx < 0 else idx
    if not 0 <= at < n:
        raise IndexError(idx)
    return ranked(rows, F.col(order), name="_rank").where(F.col("_rank") == at + 1).select(*rows.columns)


def complete(files: DataFrame, splits: tuple[str, ...] = ("train", "valid", "test"), name: str = "_annotations.coco.json") -> DataFrame:
    """SRC-21: the folders (slug) that are whole: each split's folder that is there has its annotation document, and the first split's is there.

    files: path and name; folders without files aren't seen. Others have to be fetched.
    """
    parts = F.split("path", "/")
    here = files.select(F.try_element_at(parts, F.lit(-3)).alias("slug"), F.try_element_at(parts, F.lit(-2)).alias("_split"), (F.col("name") == name).alias("_doc"))
    each = here.where(F.col("slug").isNotNull() & F.col("_split").isin(*splits)).groupBy("slug", "_split").agg(F.bool_or(F.coalesce("_doc", F.lit(False))).alias("_has"))
    whole = each.groupBy("slug").agg(F.bool_and("_has").alias("_all"), F.bool_or(F.col("_has") & (F.col("_split") == splits[0])).alias("_first"))
    return whole.where("_all and _first").select("slug")


def chosen_versions(registry: DataFrame, versions: DataFrame) -> DataFrame:
    """SRC-21: each row of the registry (workspace, project, version) with the version that it names: slug, number, name; both null if there is none.

    versions: workspace, project, place (0 is the one that the hub lists first), number,
    name. A null version, or `latest`, is the first listed; digits are a number;
    anything else is a name. Of equal numbers or names the first listed counts.
    """
    asked = registry.select("workspace", "project", "version").distinct()
    named = versions.select(F.col("workspace").alias("_ws"), F.col("project").alias("_pr"), F.struct("place", F.col("number").cast("long").alias("number"), "name").alias("_v"))
    v = F.col("version")
    latest, digits = v.isNull() | (v == "latest"), v.rlike("^[0-9]+$")
    hit = F.when(latest, True).when(digits, F.col("_v.number") == F.expr("try_cast(version AS bigint)")).otherwise(F.col("_v.name") == v)
    found = asked.join(named, (F.col("workspace") == F.col("_ws")) & (F.col("project") == F.col("_pr")), "left").groupBy("workspace", "project", "version").agg(F.min(F.when(hit, F.col("_v"))).alias("_v"))
    return found.select("workspace", "project", "version", F.concat_ws("__", "workspace", "project").alias("slug"), F.col("_v.number").alias("number"), F.col("_v.name").alias("name"))


def fetch_plan(chosen: DataFrame, files: DataFrame, *, overwrite: bool = False) -> DataFrame:
    """SRC-21: what a download does with each chosen version: `action` and whether the folder is removed before (`clean`).

    `skip` if the folder is whole and not to be overwritten, else `get`, or `fail` if
    the hub has no such version; `clean` if the folder is there and is to be
    overwritten, or belongs to one that fails. files are those below the folders.
    """
    slug = F.try_element_at(F.split("path", "/"), F.lit(-3))
    there = files.select(slug.alias("slug")).distinct().withColumn("_there", F.lit(True))
    joined = chosen.join(there, "slug", "left").join(complete(files).withColumn("_whole", F.lit(True)), "slug", "left")
    skip = F.col("_whole").isNotNull() & F.lit(not overwrite)
    action = F.when(skip, "skip").when(F.col("number").isNull() & F.col("name").isNull(), "fail").otherwise("get")
    clean = F.col("_there").isNotNull() & ~skip & (F.lit(overwrite) | (action == "fail"))
    return joined.select(*chosen.columns, action.alias("action"), clean.alias("clean"))


def checkpoint(files: DataFrame, named: str | None = None) -> DataFrame:
    """SRC-22: the named path, or the last by path."""
    return files.where(F.col("path") == named).select("path") if named else files.agg(F.max("path").alias("path"))
