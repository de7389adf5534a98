"""Vector analytics: group means, similarity, normalisation and two-stage PCA."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.numbers import clip_rescale, cosine, dot, min_max
from framelake.operators.order import quantiles
from framelake.scratch import Scratch


def mean_vectors(rows: DataFrame, *, by: str, vector: str) -> DataFrame:
    """AGG-19: the mean vector of each group; sums by (group, place) are combined map-side."""
    parts = rows.select(by, F.posexplode(vector).alias("_i", "_x")).groupBy(by, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return parts.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("mean_vector"))


def similarity_to_mean(rows: DataFrame, *, by: str, vector: str) -> DataFrame:
    """MTH-02, AGG-19: rows with `similarity` to their group's mean."""
    return rows.join(mean_vectors(rows, by=by, vector=vector), by).withColumn("similarity", cosine(F.col(vector), F.col("mean_vector"))).drop("mean_vector")


def normalised_by(rows: DataFrame, *, by: str, value: str) -> DataFrame:
    """WIN-09: rows with `normalised`, 0 to 1 in each group. Extremes are aggregated, so a hot group is combined map-side."""
    ends = rows.groupBy(by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return rows.join(ends, by).withColumn("normalised", min_max(F.col(value), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def kept_by(rows: DataFrame, *, by: str, value: str, threshold: float, least: int = 3) -> DataFrame:
    """FIL-10: rows whose value reaches the threshold; a group that keeps fewer than `least` is an error as the query runs."""
    kept = rows.groupBy(F.col(by).alias("_by")).agg(F.count_if(F.col(value) >= threshold).alias("_n"))
    few = F.raise_error(F.concat(F.lit(f"fewer than {least} rows reach {threshold} in "), F.coalesce(F.col("_by").cast("string"), F.lit("null"))))
    kept = kept.where(F.when(F.col("_n") < least, few.isNull()).otherwise(True))
    return rows.where(F.col(value) >= threshold).join(kept, F.col(by).eqNullSafe(F.col("_by"))).select(*rows.columns)


@dataclass
class Basis:
    """SRC-17: a frozen two-stage basis."""

    mean_a: np.ndarray
    axis_a: np.ndarray
    threshold: float
    mean_b: np.ndarray
    axes_b: np.ndarray  # 3 x D
    lo: np.ndarray
    hi: np.ndarray

    def row(self) -> tuple:
        return tuple(x if isinstance(x, float) else x.tolist() for x in (self.mean_a, self.axis_a, self.threshold, self.mean_b, self.axes_b, self.lo, self.hi))

    SCHEMA = "mean_a array<double>, axis_a array<double>, threshold double, mean_b array<double>, axes_b array<array<double>>, lo array<double>, hi array<double>"

    def save(self, spark, path: str) -> None:
        spark.createDataFrame([self.row()], self.SCHEMA).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> Basis:
        r = spark.read.parquet(path).first()
        return cls(np.array(r.mean_a), np.array(r.axis_a), r.threshold, np.array(r.mean_b), np.array(r.axes_b), np.array(r.lo), np.array(r.hi))


def axes(rows: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, k axes, rows) of vectors: covariance is summed on the executors, D x D numbers reach the driver."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    v = rows.select(array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    stats = v.select(Summarizer.metrics("mean", "count").summary(v.v).alias("s")).select("s.mean", "s.count").first()
    if stats[1] < 4:
        raise ValueError("fewer than 4 rows")
    from pyspark.ml.feature import PCA

    model = PCA(k=k, inputCol="v", outputCol="p").fit(v)
    return stats[0].toArray(), model.pc.toArray().T, stats[1]


def _project(vector: str, axis: np.ndarray, mean: np.ndarray | None = None) -> Column:
    d = dot(F.col(vector), F.lit(axis.tolist()))
    return d - F.lit(float(axis @ mean)) if mean is not None else d


def _signed(rows: DataFrame, vector: str, found: np.ndarray) -> np.ndarray:
    """ML-05: axes whose mean cubed projection isn't negative."""
    cubes = rows.agg(*[F.avg(F.pow(_project(vector, a), 3)).alias(f"c{i}") for i, a in enumerate(found)]).first()
    return np.array([-a if cubes[i] < 0 else a for i, a in enumerate(found)])


def fit_basis(rows: DataFrame, *, vector: str, quantile: float = 0.9, anchors: tuple[float, float] = (1.0, 99.0)) -> Basis:
    """ML-03..06: an axis over all rows, a gate at a quantile of its projection, three axes over the rows that pass.

    As in the behaviour it reproduces, anchors come from projections that are not
    centred, while rendering subtracts the mean.
    """
    mean_a, first, _ = axes(rows, vector, 1)
    axis_a = _signed(rows, vector, first)[0]
    projected = rows.withColumn("_p", _project(vector, axis_a))
    threshold = float(quantiles(projected, {"gate": F.col("_p")}, [quantile]).first()[0])
    front = projected.where(F.col("_p") >= threshold)
    mean_b, three, _ = axes(front, vector, 3)
    axes_b = _signed(front, vector, three)
    ends = quantiles(front, {f"p{i}": _project(vector, a) for i, a in enumerate(axes_b)}, [x / 100 for x in anchors]).first()
    return Basis(mean_a, axis_a, threshold, mean_b, axes_b, *(np.array([ends[f"p{i}_{k}"] for i in range(len(axes_b))]) for k in range(2)))


def apply_basis(rows: DataFrame, basis: Basis, *, vector: str) -> DataFrame:
    """ML-07, FIL-11, IMG-16: `foreground` and r, g, b of each row; background is 0. Narrow: no shuffle."""
    front = _project(vector, basis.axis_a) >= basis.threshold
    out = rows.withColumn("foreground", front)
    for name, a, lo, hi in zip("rgb", basis.axes_b, basis.lo, basis.hi):
        out = out.withColumn(name, F.when(F.col("foreground"), clip_rescale(_project(vector, a, basis.mean_b), F.lit(float(lo)), F.lit(float(hi)))).otherwise(0.0))
    return out


def explained_variance(rows: DataFrame, *, vector: str, projections: list[Column]) -> DataFrame:
    """AGG-21: one row: for each projection its variance over that of all elements of all vectors, which is no share."""
    elements = rows.select(F.explode(F.col(vector).cast("array<double>")).alias("_x")).agg(F.var_pop("_x").alias("_all")).withColumn("_k", F.lit(0))
    own = rows.agg(*[F.var_pop(p).alias(f"axis_{i}") for i, p in enumerate(projections)]).withColumn("_k", F.lit(0))
    return own.join(F.broadcast(elements), "_k").select(*[(F.col(f"axis_{i}") / F.col("_all")).alias(f"axis_{i}") for i in range(len(projections))])


#: Numbers of sums that a task holds before it sends them on.
HELD = 8_000_000


def group_moments(rows: DataFrame, *, by: str, vector: str) -> DataFrame:
    """(by, n, sums): the count of each group's vectors and its sums of elements and of their products, D and D x D numbers.

    Each task adds up its own rows, so a group of any size is combined before the
    shuffle, which moves a row for each number, task and group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            keys = batch.column(0).dictionary_encode()
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            of = np.asarray(keys.indices.fill_null(-1))
            for k in np.unique(of).tolist():
                own = x[of == k]
                n, sums = held.get(name := keys.dictionary[k].as_py() if k >= 0 else None, (0, 0))
                held[name] = n + len(own), sums + np.concatenate([own.sum(0), (own.T @ own).ravel()])
            if sum(len(s) for _, s in held.values()) > HELD:
                yield table(held, batch.schema.field(0).type)
                held = {}
        if held:
            yield table(held, batch.schema.field(0).type)

    def table(held: dict, kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([s.tolist() for _, s in held.values()], pa.list_(pa.float64()))], names=[by, "n", "sums"])

    kind = rows.schema[by].dataType.simpleString()
    given = rows.where(F.col(vector).isNotNull()).select(by, F.col(vector).cast("array<double>"))
    parts = given.mapInArrow(run, f"`{by}` {kind}, n long, sums array<double>")
    cells = parts.select(by, "n", F.posexplode("sums").alias("_i", "_x")).groupBy(by, "_i").agg(F.sum("n").alias("n"), F.sum("_x").alias("_x"))
    return cells.groupBy(by).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias("sums"))


def group_axes(moments: DataFrame, *, by: str, k: int = 3) -> DataFrame:
    """(by, mean, axes, shares): the k axes of most variance of each group's moments (by, n, sums), and their shares of it.

    An axis points so that its largest element, the first of those, is positive.
    Fewer than 3 vectors are an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, sums in zip(batch.column("n").to_pylist(), batch.column("sums").to_pylist()):
                if n < 3:
                    raise ValueError("fewer than 3 patches")
                d = int((4 * len(sums) + 1) ** 0.5 - 1) // 2
                s = np.array(sums)
                mean = s[:d] / n
                values, vectors = np.linalg.eigh(s[d:].reshape(d, d) / n - np.outer(mean, mean))
                own = vectors.T[::-1][:k]
                top = np.abs(own).round(12).argmax(1)
                own = own * np.where(own[np.arange(len(own)), top] < 0, -1, 1)[:, None]
                total = np.clip(values, 0, None).sum()
                out.append((mean.tolist(), own.tolist(), (np.clip(values[::-1][:k], 0, None) / total if total else np.zeros(len(own))).tolist()))
            kinds = (pa.list_(pa.float64()), pa.list_(pa.list_(pa.float64())), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(by), *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds))], names=[by, "mean", "axes", "shares"])

    kind = moments.schema[by].dataType.simpleString()
    return moments.select(by, "n", "sums").mapInArrow(run, f"`{by}` {kind}, mean array<double>, axes array<array<double>>, shares array<double>")


def frame_rgb(rows: DataFrame, *, by: str, key: str, vector: str) -> DataFrame:
    """ML-08: (by, key, r, g, b): a PCA of each frame's own patches, channels scaled to 0..1; fewer than 3 patches are an error.

    A group of any size: its axes come from its moments, its rows meet them in a join.
    Rows without a vector are left out, and channels beyond the vector's length are 0.
    """
    scratch = Scratch(rows.sparkSession, "frame_rgb")
    found = scratch.save(group_axes(group_moments(rows, by=by, vector=vector), by=by)).select(F.col(by).alias("_of"), "mean", "axes")
    given = rows.where(F.col(vector).isNotNull()).select(F.col(by).alias("_by"), F.col(key).alias("_key"), F.col(vector).alias("_v"))
    joined = given.join(found, F.col("_by").eqNullSafe(F.col("_of")))
    at = lambda i: F.coalesce(dot(F.col("_v"), F.get("axes", F.lit(i))) - dot(F.col("mean"), F.get("axes", F.lit(i))), F.lit(0.0))
    placed = scratch.save(joined.select("_by", "_key", *[at(i).alias(f"_{c}") for i, c in enumerate("rgb")]))
    ends = placed.groupBy(F.col("_by").alias("_of")).agg(*[f(f"_{c}").alias(f"_{name}_{c}") for c in "rgb" for name, f in (("lo", F.min), ("hi", F.max))])
    scaled = placed.join(ends, F.col("_by").eqNullSafe(F.col("_of")))
    return scaled.select(F.col("_by").alias(by), F.col("_key").alias(key), *[((F.col(f"_{c}") - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}") + 1e-6)).alias(c) for c in "rgb"])
