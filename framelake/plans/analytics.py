"""Vector and raster queries: embeddings are patch tokens, their label is the frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import numbers
from framelake.operators import raster, vectors
from framelake.operators.order import percentiles
from framelake.plans.tables import table


def cosine_to_group_mean(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return vectors.similarity_to_mean(e, by="label", vector="embedding").select("vec_id", "label", F.round("similarity", 5).alias("similarity"))


def minmax_threshold_mask(spark, sf_dir):
    """WIN-09, FIL-10, IMG-14."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("x"))
    n = vectors.normalised_by(e, by="label", value="x")
    return n.select("vec_id", F.round("normalised", 6).alias("normalised"), F.when(F.col("normalised") >= 0.6, 255).otherwise(0).alias("mask"))


def pairwise_mean_abs_diff(spark, sf_dir):
    """MTH-01 against the vector with the next id."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(numbers.mean_abs_diff(F.col("embedding"), F.col("next")), 5).alias("diff"))


def pca_two_stage(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    basis = vectors.fit_basis(e, vector="embedding")
    out = vectors.apply_basis(e, basis, vector="embedding")
    return out.select("vec_id", "foreground", *[F.round(c, 6).alias(c) for c in "rgb"])


def pca_frame_rgb(spark, sf_dir):
    """ML-08."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return vectors.frame_rgb(e, by="label", key="vec_id", vector="embedding").select("vec_id", "label", *[F.round(c, 6).alias(c) for c in "rgb"])


def threshold_sweep(spark, sf_dir):
    """IMG-17, STR-11: one pass over values for a list of thresholds, that are a parameter."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("x"))
    n = vectors.normalised_by(e, by="label", value="x")
    counts = n.agg(*[F.count_if(F.col("normalised") >= t).alias(f"t{round(t * 100):03d}") for t in (0.25, 0.5, 0.75)])
    return counts


def quantile_gate(spark, sf_dir):
    """AGG-15, FIL-11: the gate is one number, joined to the rows by a constant key."""
    li = table(spark, sf_dir, "lineitem").withColumn("_k", F.lit(0))
    gate = percentiles(li, "l_extendedprice", 0.9, by=[], name="gate").withColumn("_k", F.lit(0))
    kept = li.join(F.broadcast(gate), "_k").where(F.col("l_extendedprice") >= F.col("gate"))
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("l_extendedprice"), 2).alias("least"))


def clip_rescaled(spark, sf_dir):
    """MTH-06, MTH-09."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(numbers.clip_rescale(F.col("p_retailprice"), F.lit(950.0), F.lit(1500.0)), 6).alias("scaled"), F.round(numbers.normalised(F.col("p_size"), 0.485, 0.229), 6).alias("normalised"), numbers.scaled_size(F.col("p_size"), F.lit(0.5)).alias("half"), numbers.padded_size(F.col("p_size"), 16).alias("padded"))


def components_pixels(spark, sf_dir):
    """IMG-07 on rasters that are made from events: 16 x 16 pixels a user."""
    ev = table(spark, sf_dir, "events").select("user_id", (F.floor("value") % 256).cast("int").alias("at"))
    px = ev.groupBy("user_id").agg(F.collect_set("at").alias("on"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.when(F.array_contains("on", i), "FF").otherwise("00"))
    masks = px.select(F.col("user_id").alias("key"), F.unhex(F.array_join(bits, "")).alias("mask"), F.lit(16).alias("h"), F.lit(16).alias("w"))
    return raster.mask_components(masks, min_area=2)


def mask_values(spark, sf_dir):
    """IMG-05, IMG-10, AGG-14 as columns."""
    ev = table(spark, sf_dir, "events").withColumn("v", F.floor("value").cast("int") % 256)
    norm = F.when(F.col("v") == 127, 127).when(F.col("v") > 127, 255).otherwise(0)
    kind = F.when(norm == 127, 1).when(norm == 255, 2).otherwise(0)
    return ev.groupBy("user_id").agg(F.round(F.avg((norm >= 1).cast("double")), 9).alias("coverage"), F.sum(kind).alias("classes"))


def contact_sheet(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("i"))
    return raster.grid_cells(p, order="i", columns=6, width=64, height=48).drop("i")


QUERIES = {f.__name__: f for f in (cosine_to_group_mean, minmax_threshold_mask, pairwise_mean_abs_diff, pca_two_stage, pca_frame_rgb, threshold_sweep, quantile_gate, clip_rescaled, components_pixels, mask_values, contact_sheet)}
_N = """e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x FROM embeddings),
n AS (SELECT vec_id, (x - min(x) OVER (PARTITION BY label)) / (max(x) OVER (PARTITION BY label) - min(x) OVER (PARTITION BY label) + 1e-6) AS normalised FROM e)"""
SQL = {
    "cosine_to_group_mean": """
WITH u AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings),
a AS (SELECT label, i, avg(x) AS m FROM u GROUP BY 1, 2), g AS (SELECT label, list(m ORDER BY i) AS m FROM a GROUP BY 1)
SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], m), 5) AS similarity FROM embeddings JOIN g USING (label)""",
    "minmax_threshold_mask": f"WITH {_N} SELECT vec_id, round(normalised, 6) AS normalised, CASE WHEN normalised >= 0.6 THEN 255 ELSE 0 END AS mask FROM n",
    "pairwise_mean_abs_diff": """
SELECT a.vec_id, round(list_avg(list_transform(list_zip(a.embedding, b.embedding), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))), 5) AS diff
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "threshold_sweep": f"WITH {_N} SELECT count(*) FILTER (normalised >= 0.25) AS t025, count(*) FILTER (normalised >= 0.5) AS t050, count(*) FILTER (normalised >= 0.75) AS t075 FROM n",
    "quantile_gate": """
WITH g AS (SELECT quantile_cont(l_extendedprice, 0.9) AS gate FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(min(l_extendedprice), 2) AS least FROM lineitem, g WHERE l_extendedprice >= gate GROUP BY 1""",
    "clip_rescaled": """
SELECT p_partkey, round(least(1.0, greatest(0.0, (p_retailprice - 950) / 550.0)), 6)::DOUBLE AS scaled, round((p_size / 255.0::DOUBLE - 0.485::DOUBLE) / 0.229::DOUBLE, 6) AS normalised,
       greatest(1, round_even(p_size * 0.5, 0))::INT AS half, (ceil(p_size / 16) * 16)::INT AS padded FROM part""",
    "mask_values": """
WITH v AS (SELECT user_id, floor(value)::INT % 256 AS v FROM events)
SELECT user_id, round(avg((v >= 127)::INT::DOUBLE), 9) AS coverage, sum(CASE WHEN v = 127 THEN 1 WHEN v > 127 THEN 2 ELSE 0 END)::BIGINT AS classes FROM v GROUP BY 1""",
    "contact_sheet": "SELECT p_partkey, (p_partkey // 6)::INT AS row, (p_partkey % 6)::INT AS col, (p_partkey % 6 * 64)::INT AS x, (p_partkey // 6 * 48)::INT AS y FROM part",
}
