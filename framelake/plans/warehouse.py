"""Annotation queries: orders are images, lineitem annotations, part class names."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake import sources
from framelake.functions import names, numbers
from framelake.operators import annotations as ops
from framelake.operators import evaluate, quality
from framelake.plans.tables import table
from framelake.sources import sinks

#: A rule table for part names, in the form of the class rules.
PART_RULES = (("large", "drone"), ("small", "enemy"), ("gear", "worker"), ("red", "worker"), ("gizmo", "worker"))
CLASSES = ("drone", "worker", "enemy")


def _annotations(spark, sf_dir):
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    a = li.join(part, li.l_partkey == part.p_partkey).select(F.col("l_orderkey").alias("image_id"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "p_name")
    return ops.bucketed(a, "p_name", PART_RULES)


def _images(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), F.col("o_orderpriority").alias("split"))


def class_map_rules(spark, sf_dir):
    return ops.bucketed(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", PART_RULES)


def class_counts(spark, sf_dir):
    """FIL-16: classes without rows count 0."""
    classes = spark.createDataFrame([(c,) for c in (*CLASSES, "pollen")], "class string")
    return ops.class_counts(_annotations(spark, sf_dir).where("bucket is not null"), classes)


def dropped_classes(spark, sf_dir):
    return ops.dropped_classes(_annotations(spark, sf_dir), "p_name")


def merge_annotations(spark, sf_dir):
    """Counted by image and bucket first, so that images are joined to a few rows each, once."""
    kept = _annotations(spark, sf_dir).where("bucket is not null").groupBy("image_id", "bucket").agg(F.count(F.lit(1)).alias("n"))
    return kept.join(_images(spark, sf_dir), "image_id").groupBy("split", "bucket").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("images"))


def merge_reassign_ids(spark, sf_dir):
    images, _ = ops.merged(_images(spark, sf_dir), _annotations(spark, sf_dir))
    return ops.reassigned_ids(images, part="split", order=["image_id"], name="new_id").select("split", "image_id", "new_id")


def project_records(spark, sf_dir):
    """PRJ-01 flattened."""
    o = table(spark, sf_dir, "orders")
    r = o.select(ops.image_record(F.col("o_orderkey"), F.concat(F.col("o_orderpriority"), F.lit("___"), F.col("o_orderkey").cast("string")), F.lit(640), F.lit(None).cast("int")).alias("r"))
    return r.select("r.id", "r.file_name", "r.width", "r.height", "r.license", "r.date_captured")


def audit_grouping_sets(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_returnflag", F.pmod("l_suppkey", F.lit(7)).alias("source"))
    return ops.audit(li, split="l_linestatus", label="l_returnflag", source="source")


def audit_pivot_percent(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    wide = ops.pivoted(li, by="l_linestatus", label="l_returnflag", classes=["A", "N", "R"])
    named = wide.select("l_linestatus", F.col("A").alias("n_a"), F.col("N").alias("n_n"), F.col("R").alias("n_r"))
    out = ops.with_percent(named.withColumn("total", F.col("n_a") + F.col("n_n") + F.col("n_r")), "total")
    return out.withColumn("percent", F.round("percent", 6))


def collect_per_image(spark, sf_dir):
    d = ops.per_image(table(spark, sf_dir, "lineitem"), image="l_orderkey", label="l_returnflag")
    text = F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return d.select("l_orderkey", text.alias("counts"), "total")


def detection_labels(spark, sf_dir):
    """PRJ-03."""
    li = table(spark, sf_dir, "lineitem").select("l_linenumber").distinct().withColumn("class_id", F.col("l_linenumber") - 4)
    return li.select("class_id", ops.class_label(F.col("class_id"), F.array(*map(F.lit, CLASSES))).alias("label"))


def background_other_group(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    pool = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("bg"))
    return ops.other_group_pick(s, pool, group="s_nationkey", item="s_suppkey", choice="bg", seed="42").select("s_suppkey", "background")


def _boxes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("image_id"), "l_returnflag", "l_linestatus", (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("key"),
        (F.col("l_partkey") % 100).cast("int").alias("x"), (F.col("l_suppkey") % 100).cast("int").alias("y"),
        (10 + F.col("l_quantity")).cast("int").alias("w"), (10 + F.col("l_linenumber")).cast("int").alias("h"), "l_discount",
    )


def iou_join(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    found = evaluate.overlapping(b.where("l_linestatus = 'F'"), b.where("l_linestatus = 'O'"), on=["image_id"], least=0.1)
    return found.select("image_id", "t_key", "d_key", F.round("iou", 9).alias("iou"))


def coco_ap(spark, sf_dir):
    """Every line is a truth and a detection; some detections are shifted, of another class, or of a low score."""
    b = _boxes(spark, sf_dir).withColumn("category_id", F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2))
    box = lambda *cs: F.array(*[F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in cs]).alias("bbox")
    truth = b.select("image_id", "category_id", box(*"xywh"), (F.col("w") * F.col("h")).cast("double").alias("area"), F.lit(0).alias("iscrowd"))
    other = F.when(F.col("key") % 11 == 0, (F.col("category_id") + 1) % 3).otherwise(F.col("category_id")).cast("int")
    score = F.col("l_discount") + F.col("key") % 1000 / 100000
    found = b.select("image_id", other.alias("category_id"), box(F.col("x") + F.col("key") % 5, "y", "w", "h"), score.alias("score"))
    return evaluate.average_precision(evaluate.matched(truth, found)).select("category_id", "threshold", "positives", F.round("ap", 9).alias("ap"))


def prf1_by_class(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    rows = table(spark, sf_dir, "labels").join(d, "doc_id").select("quality", (F.col("n_chars") > 200).cast("int").alias("guess"))
    s = evaluate.class_scores(rows, truth="quality", predicted="guess")
    return s.select("class", "actual", "claimed", "tp", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def quality_rules_long(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    n = F.col("n_chars").cast("double")
    rules = {"long_enough": (n, n >= 200), "short_enough": (n, n <= 20000), "english_only_length": (n, F.when(F.col("lang") == "en", n >= 300))}
    return quality.rule_rows(d, "doc_id", rules)


def quality_failures(spark, sf_dir):
    return quality.failures(quality_rules_long(spark, sf_dir))


def preflight(spark, sf_dir):
    return quality.preflight(table(spark, sf_dir, "orders"), table(spark, sf_dir, "region"), 100)


def foreign_keys(spark, sf_dir):
    """JOIN-04: orders without lines, as missing keys."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return quality.foreign_keys_missing(o, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), ["k"])


def overlay_left_join(spark, sf_dir):
    """JOIN-05: images with their boxes as text, also those without any."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list("l_linenumber")).alias("n"))
    return o.join(li, "o_orderkey", "left").select("o_orderkey", F.coalesce(F.array_join("n", ","), F.lit("")).alias("boxes"))


def set_ops(spark, sf_dir):
    """SET-02: segments of customers with and without orders, as sets."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    keys = c.select("c_custkey")
    both, none = keys.intersect(o), keys.subtract(o)
    every = both.withColumn("side", F.lit("both")).unionByName(none.withColumn("side", F.lit("none")))
    return every.join(c.select("c_custkey", "c_mktsegment"), "c_custkey").select("side", "c_mktsegment").distinct()


def union_sources(spark, sf_dir):
    """SET-01."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("source"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("source"))
    return c.unionByName(s).groupBy("nation", "source").agg(F.count(F.lit(1)).alias("n"))


def box_forms(spark, sf_dir):
    """MTH-03..05."""
    b = _boxes(spark, sf_dir).select("key", "image_id", *"xywh").distinct()
    win = numbers.crop_window(F.col("x"), F.col("y"), 32, F.lit(100), F.lit(100))
    xy = numbers.xywh_to_xyxy(F.array(*[F.col(c).cast("double") / 2 for c in "xywh"]))
    out = b.select("key", "image_id", *"xywh", win.alias("c"), xy.alias("b"), numbers.clamp_center(F.col("x"), 16, F.lit(100)).alias("center"))
    return out.select("key", "image_id", *"xywh", "c.x1", "c.x2", F.col("c.left").alias("pad_left"), F.col("c.right").alias("pad_right"), F.get("b", F.lit(2)).alias("bx2"), F.get("b", F.lit(3)).alias("by2"), "center")


def audit_report(spark, sf_dir):
    """SNK-15: orders as images, their lines as annotations."""
    source = lambda c: F.concat(F.lit("source_"), F.pmod(c, F.lit(7)).cast("string")).alias("source")
    images = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("split"), source("o_custkey"))
    labels = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("split"), source("l_suppkey"), F.col("l_returnflag").alias("label"))
    return sinks.audit_report(images, labels, ["A", "N", "R"])


def fetch_plan(spark, sf_dir):
    """SRC-21: orders as projects that ask for a version, their lines as versions, and as files that are there."""
    key = F.col("o_orderkey")
    asked = F.when(key % 4 == 0, F.lit(None)).when(key % 4 == 1, F.lit("latest")).when(key % 4 == 2, (key % 9).cast("string")).otherwise(F.col("o_orderstatus"))
    ws, pr = lambda c: F.concat(F.lit("w"), (F.col(c) % 7).cast("string")).alias("workspace"), lambda c: F.col(c).cast("string").alias("project")
    registry = table(spark, sf_dir, "orders").select(ws("o_orderkey"), pr("o_orderkey"), asked.alias("version"))
    lines = table(spark, sf_dir, "lineitem").select(ws("l_orderkey"), pr("l_orderkey"), "l_linenumber", "l_linestatus", "l_partkey", "l_quantity")
    versions = lines.select("workspace", "project", F.col("l_linenumber").alias("place"), (F.lit(8) - F.col("l_linenumber")).alias("number"), F.col("l_linestatus").alias("name"))
    split = F.element_at(F.array(*map(F.lit, ("train", "valid", "test"))), (F.col("l_partkey") % 3 + 1).cast("int"))
    name = F.when(F.col("l_quantity") > 15, "_annotations.coco.json").otherwise("a.jpg")
    files = lines.where("l_partkey % 2 = 0").select(F.concat_ws("/", F.lit("/raw"), F.concat_ws("__", "workspace", "project"), split, name).alias("path"), name.alias("name"))
    return sources.fetch_plan(sources.chosen_versions(registry, versions), files)


QUERIES = {f.__name__: f for f in (
    class_map_rules, class_counts, dropped_classes, merge_annotations, merge_reassign_ids, project_records, audit_grouping_sets, audit_pivot_percent, collect_per_image, detection_labels,
    background_other_group, iou_join, coco_ap, prf1_by_class, quality_rules_long, quality_failures, preflight, foreign_keys, overlay_left_join, set_ops, union_sources, box_forms, audit_report, fetch_plan,
)}
_CASE = "CASE " + " ".join(f"WHEN contains(lower(p_name), '{n}') THEN '{b}'" for n, b in PART_RULES) + " END"
_A = f"a AS (SELECT l_orderkey AS image_id, p_name, {_CASE} AS bucket FROM lineitem JOIN part ON l_partkey = p_partkey)"
_BOX = "SELECT l_orderkey AS image_id, l_linestatus, l_partkey * 100000 + l_suppkey AS key, l_partkey % 100 AS x, l_suppkey % 100 AS y, (10 + l_quantity)::INT AS w, 10 + l_linenumber AS h FROM lineitem"
_IW = "greatest(least(t.x + t.w, d.x + d.w) - greatest(t.x, d.x), 0)"
_IH = "greatest(least(t.y + t.h, d.y + d.h) - greatest(t.y, d.y), 0)"
_RULES = """q AS (SELECT doc_id, 'long_enough' AS rule, n_chars::DOUBLE AS value, n_chars >= 200 AS ok FROM documents
UNION ALL SELECT doc_id, 'short_enough', n_chars::DOUBLE, n_chars <= 20000 FROM documents
UNION ALL SELECT doc_id, 'english_only_length', n_chars::DOUBLE, n_chars >= 300 FROM documents WHERE lang = 'en')"""
SQL = {
    "class_map_rules": f"SELECT p_partkey, p_name, {_CASE} AS bucket FROM part",
    "class_counts": f"WITH {_A} SELECT c AS class, count(a.bucket) AS n FROM (SELECT unnest(['drone', 'worker', 'enemy', 'pollen']) AS c) LEFT JOIN a ON a.bucket = c GROUP BY 1",
    "dropped_classes": f"WITH {_A} SELECT p_name, count(*) AS n FROM a WHERE bucket IS NULL GROUP BY 1",
    "merge_annotations": f"WITH {_A} SELECT o_orderpriority AS split, bucket, count(*) AS n, count(DISTINCT image_id) AS images FROM a JOIN orders ON o_orderkey = image_id WHERE bucket IS NOT NULL GROUP BY 1, 2",
    "merge_reassign_ids": f"""WITH {_A} SELECT o_orderpriority AS split, o_orderkey AS image_id, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS new_id
FROM orders WHERE o_orderkey IN (SELECT image_id FROM a WHERE bucket IS NOT NULL)""",
    "project_records": "SELECT o_orderkey AS id, o_orderpriority || '___' || o_orderkey AS file_name, 640 AS width, 0 AS height, 0 AS license, '' AS date_captured FROM orders",
    "audit_grouping_sets": """
WITH l AS (SELECT l_linestatus, l_returnflag, l_suppkey % 7 AS source FROM lineitem)
SELECT l_linestatus, l_returnflag, source, count(*) AS n, grouping(l_linestatus, l_returnflag, source)::INT AS level FROM l
GROUP BY GROUPING SETS ((l_linestatus), (l_returnflag), (l_linestatus, l_returnflag), (source), (source, l_returnflag), ())""",
    "audit_pivot_percent": """
SELECT l_linestatus, count(*) FILTER (l_returnflag = 'A') AS n_a, count(*) FILTER (l_returnflag = 'N') AS n_n, count(*) FILTER (l_returnflag = 'R') AS n_r, count(*) AS total,
       round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM lineitem GROUP BY 1""",
    "audit_report": """
WITH i AS (SELECT o_orderstatus AS split, 'source_' || o_custkey % 7 AS source, 1 AS im, 0 AS an, NULL AS label FROM orders
           UNION ALL SELECT l_linestatus, 'source_' || l_suppkey % 7, 0, 1, l_returnflag FROM lineitem),
s AS (SELECT split, source, sum(im)::BIGINT AS im, sum(an)::BIGINT AS an, count(*) FILTER (label = 'A') AS a, count(*) FILTER (label = 'N') AS n, count(*) FILTER (label = 'R') AS r FROM i GROUP BY GROUPING SETS ((split), (source))),
c AS (SELECT label, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS percent FROM i WHERE label IN ('A', 'N', 'R') GROUP BY label)
SELECT '1 images' AS section, split AS name, printf('  %-5s: %d', split, im) AS line FROM s WHERE split IS NOT NULL
UNION ALL SELECT '2 annotations', split, printf('  %-5s: %d', split, an) FROM s WHERE split IS NOT NULL
UNION ALL SELECT '3 classes', label, printf('  %-6s %6d  %5.1f%%', label, n, percent) FROM c
UNION ALL SELECT '4 splits', split, printf('  %-5s: A=%d, N=%d, R=%d', split, a, n, r) FROM s WHERE split IS NOT NULL
UNION ALL SELECT '5 sources', source, printf('  %-48s %7d %7d  %7d  %7d  %7d', source, im, an, a, n, r) FROM s WHERE source IS NOT NULL""",
    "fetch_plan": """
WITH q AS (SELECT 'w' || o_orderkey % 7 AS workspace, o_orderkey::VARCHAR AS project, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'latest' WHEN 2 THEN (o_orderkey % 9)::VARCHAR ELSE o_orderstatus END AS version, o_orderkey AS k FROM orders),
v AS (SELECT q.k, min((l_linenumber, 8 - l_linenumber, l_linestatus)) AS b FROM q JOIN lineitem ON l_orderkey = q.k
      WHERE version IS NULL OR version = 'latest' OR version = (8 - l_linenumber)::VARCHAR OR version = l_linestatus GROUP BY q.k),
p AS (SELECT l_orderkey AS k, l_partkey % 3 AS part, bool_or(l_quantity > 15) AS has FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY ALL),
d AS (SELECT k, bool_and(has) AND bool_or(has AND part = 0) AS whole FROM p GROUP BY k)
SELECT workspace, project, version, workspace || '__' || project AS slug, b[2]::BIGINT AS number, b[3] AS name, CASE WHEN whole THEN 'skip' WHEN b IS NULL THEN 'fail' ELSE 'get' END AS action,
       d.k IS NOT NULL AND NOT whole AND b IS NULL AS clean FROM q LEFT JOIN v USING (k) LEFT JOIN d USING (k)""",
    "collect_per_image": """
WITH c AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, string_agg(l_returnflag || ':' || n, ',' ORDER BY l_returnflag) AS counts, sum(n)::BIGINT AS total FROM c GROUP BY 1""",
    "detection_labels": """
WITH i AS (SELECT DISTINCT l_linenumber - 4 AS class_id FROM lineitem), n AS (SELECT ['drone', 'worker', 'enemy'] AS names)
SELECT class_id, coalesce(CASE WHEN class_id >= 0 THEN names[class_id + 1] WHEN class_id >= -3 THEN names[class_id + 4] END, 'class_' || class_id) AS label FROM i, n""",
    "background_other_group": """
WITH p AS (SELECT s_nationkey AS g, min(s_suppkey) AS bg FROM supplier GROUP BY 1),
o AS (SELECT s.s_suppkey, list(p.bg ORDER BY md5('42|' || p.bg)) AS l FROM supplier s JOIN p ON p.g <> s.s_nationkey GROUP BY 1)
SELECT s_suppkey, l[('0x' || substr(md5('42|' || s_suppkey), 1, 8))::BIGINT % len(l) + 1] AS background FROM o""",
    "iou_join": f"""
WITH b AS ({_BOX}), t AS (SELECT * FROM b WHERE l_linestatus = 'F'), d AS (SELECT * FROM b WHERE l_linestatus = 'O'),
j AS (SELECT t.image_id, t.key AS t_key, d.key AS d_key, ({_IW} * {_IH})::DOUBLE / (t.w * t.h + d.w * d.h - {_IW} * {_IH}) AS iou FROM t JOIN d USING (image_id))
SELECT image_id, t_key, d_key, round(iou, 9) AS iou FROM j WHERE iou >= 0.1""",
    "prf1_by_class": """
WITH r AS (SELECT quality, (n_chars > 200)::INT AS guess FROM labels JOIN documents USING (doc_id)), c AS (SELECT unnest([0, 1])::INT AS class),
s AS (SELECT class, count(*) FILTER (quality = class) AS actual, count(*) FILTER (guess = class) AS claimed, count(*) FILTER (quality = class AND guess = class) AS tp FROM c, r GROUP BY 1),
m AS (SELECT *, coalesce(tp / nullif(claimed, 0), 0) AS p, coalesce(tp / nullif(actual, 0), 0) AS q FROM s)
SELECT class, actual, claimed, tp, round(p, 9) AS precision, round(q, 9) AS recall, round(coalesce(2 * p * q / nullif(p + q, 0), 0), 9) AS f1 FROM m""",
    "quality_rules_long": f"WITH {_RULES} SELECT * FROM q",
    "quality_failures": f"WITH {_RULES} SELECT rule, count(*) AS checked, count(*) FILTER (NOT ok) AS failed FROM q GROUP BY 1",
    "preflight": "SELECT *, samples = 0 AS empty, samples < 100 AS too_few, pool < 2 AS small_pool FROM (SELECT count(*) AS samples FROM orders), (SELECT count(*) AS pool FROM region)",
    "foreign_keys": "SELECT o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "overlay_left_join": """
SELECT o_orderkey, coalesce(string_agg(l_linenumber, ',' ORDER BY l_linenumber), '') AS boxes FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
    "set_ops": "SELECT DISTINCT CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'both' ELSE 'none' END AS side, c_mktsegment FROM customer",
    "union_sources": "SELECT nation, source, count(*) AS n FROM (SELECT c_nationkey AS nation, 'customer' AS source FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier) GROUP BY 1, 2",
    "box_forms": f"""
WITH b AS (SELECT DISTINCT image_id, key, x, y, w, h FROM ({_BOX}))
SELECT key, image_id, x, y, w, h, greatest(x - 16, 0) AS x1, least(x + 16, 100) AS x2, greatest(16 - x, 0) AS pad_left, greatest(x + 16 - 100, 0) AS pad_right,
       round_even((x + w) / 2.0, 0)::INT AS bx2, round_even((y + h) / 2.0, 0)::INT AS by2, greatest(16, least(x, 83)) AS center FROM b""",
}
