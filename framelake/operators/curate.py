"""Filters, rankings and samples that pick recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.checks import non_negative


def passes_thresholds(sharpness: float = 100.0, motion: float = 0.5, brightness: float = 60.0) -> Column:
    """FIL-01: all three metrics reach their inclusive floor."""
    return (F.col("sharpness") >= sharpness) & (F.col("motion") >= motion) & (F.col("brightness") >= brightness)


def in_date_range(day: Column, start: str | None, end: str | None) -> Column:
    """FIL-02: inclusive; a bound that is None doesn't count."""
    out = F.lit(True)
    if start is not None:
        out = out & (day >= F.lit(start).cast("date"))
    if end is not None:
        out = out & (day <= F.lit(end).cast("date"))
    return out


def diverse_top_n(scored: DataFrame, *, group: str, score: str, tie: str, n: int) -> DataFrame:
    """WIN-01/02: the best row of each group, then the n best of those, ranked from 1.

    Ties go to the smaller `tie`. The per-group pick is an aggregate, so a hot
    group is combined map-side; the top n is a TakeOrdered, ranked afterwards.
    """
    if n <= 0:
        return scored.limit(0).withColumn("rank", F.lit(0))
    others = [c for c in scored.columns if c not in (group, score, tie)]
    best = (
        scored.groupBy(group)
        .agg(F.min(F.struct((-F.col(score)).alias("_s"), F.col(tie), F.col(score), *others)).alias("_b"))
        .select(group, f"_b.{tie}", f"_b.{score}", *[f"_b.{c}" for c in others])
    )
    top = best.orderBy(F.col(score).desc(), tie).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc(), F.col(tie))))


def offset_rank(rows: DataFrame, part: str, *order: Column, name: str = "rank") -> DataFrame:
    """Numbers from 1 in (part, order), by counts of the parts before: parts are in order already, and stay (rows are written)."""
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return rows.withColumn("_rn", inner).join(sizes, part).withColumn(name, (F.col("_rn") + F.col("_before")).cast("long")).drop("_rn", "_before", part)


def last_n(rows: DataFrame, *, by: str, order: str, n: int) -> DataFrame:
    """WIN-05: the last n rows of each group in order; 0 keeps all."""
    if n == 0:
        return rows
    non_negative(n=n)
    w = Window.partitionBy(by).orderBy(F.col(order).desc())
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def first_then_backfill(rows: DataFrame, *, keys: list[str], order: Column, n: int) -> DataFrame:
    """WIN-06: the first row of each key, then the others, both in order (which no two rows share), up to n.

    First places are an aggregate, combined map-side, and the n rows a TakeOrdered: no group is gathered or sorted.
    """
    firsts = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(order).alias("_first"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    marked = rows.join(firsts, same).withColumn("is_first", order.eqNullSafe(F.col("_first"))).select(*rows.columns, "is_first")
    return marked.orderBy(F.col("is_first").desc(), order).limit(n)


def interleaved(times: DataFrame, *, by: list[str], time: str, k: int, seed: str) -> DataFrame:
    """WIN-04: distinct sorted times in k floor buckets, shuffled inside, taken in turn: `bucket`, `turn`, `place`.

    The shuffle is an order by MD5 of seed, keys and time.
    """
    distinct = times.select(*by, time).distinct()
    keys = Window.partitionBy(*by)
    j, n = F.row_number().over(keys.orderBy(time)) - 1, F.count(F.lit(1)).over(keys)
    text = F.md5(F.concat_ws("|", F.lit(seed), *by, F.col(time).cast("string")).cast("binary"))
    out = distinct.withColumns({"_j": j, "_n": n, "_h": text})
    plain = (F.col("_n") <= 1) | F.lit(k <= 1)
    out = out.withColumn("bucket", F.when(plain, 0).otherwise(F.floor(((F.col("_j") + 1) * k - 1) / F.col("_n"))).cast("int"))
    out = out.withColumn("turn", F.row_number().over(Window.partitionBy(*by, "bucket").orderBy("_h")))
    return out.withColumn("place", F.row_number().over(keys.orderBy("turn", "bucket"))).drop("_j", "_n", "_h")


def miss_streak(rows: DataFrame, *, by: str, order: list[str], ok: Column, limit: int) -> DataFrame:
    """WIN-10: rows up to the one at which `limit` misses in a row are reached (0: all rows), with `streak`."""
    w = Window.partitionBy(by).orderBy(*order)
    runs = rows.withColumn("_ok", ok.cast("int")).withColumn("_run", F.sum("_ok").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.withColumn("streak", F.when(F.col("_ok") == 1, 0).otherwise(F.sum(1 - F.col("_ok")).over(Window.partitionBy(by, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))))
    if limit:
        hit = F.sum((F.col("streak") == limit).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
        runs = runs.withColumn("_hit", F.coalesce(hit, F.lit(0))).where("_hit = 0").drop("_hit")
    return runs.drop("_ok", "_run")


def capped_successes(rows: DataFrame, *, by: str, order: list[str], ok: Column, cap: int) -> DataFrame:
    """WIN-10: rows of each group until `cap` successes are reached (0: no cap)."""
    if not cap:
        return rows
    before = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_done", F.coalesce(F.sum(ok.cast("int")).over(before), F.lit(0))).where(F.col("_done") < cap).drop("_done")


def hash_order(seed: str, *keys: str) -> Column:
    """SRT-01/06: a seeded order that does not depend on partitions."""
    return F.md5(F.concat_ws("|", F.lit(seed), *keys).cast("binary"))


def sampled(rows: DataFrame, *, seed: str, keys: list[str], n: int) -> DataFrame:
    """SRT-06: n rows without replacement."""
    non_negative(n=n)
    return rows.orderBy(hash_order(seed, *keys), *keys).limit(n)


def pick_one(items: Column, seed: Column) -> Column:
    """SRT-08: one element of an array, by the MD5 of the seed as text (null: empty), so that engines agree; null if there is none."""
    at = F.conv(F.substring(F.md5(F.coalesce(seed.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    return F.when(F.size(items) > 0, F.element_at(items, (at % F.size(items) + 1).cast("int")))


def allowed(rows: DataFrame, column: str, names: str | None) -> DataFrame:
    """FIL-07: rows whose column is in a comma-separated list; blanks in it are ignored, without a name all rows stay."""
    wanted = [x.strip() for x in (names or "").split(",") if x.strip()]
    return rows.where(F.col(column).isin(wanted)) if wanted else rows


def distinct_in_order(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """SET-05: the first row of each key; an aggregate, so a frequent key is combined map-side. The order column stays for the reader."""
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    first = rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_f"))
    return first.select(*[c if c in keys else F.col(f"_f.{c}").alias(c) for c in rows.columns])


def requested(available: DataFrame, wanted: list[str], column: str) -> DataFrame:
    """JOIN-06: the wanted names that are available, with their place in the request."""
    asked = available.sparkSession.createDataFrame([(name, i) for i, name in enumerate(dict.fromkeys(wanted))], f"{column} string, place int")
    return F.broadcast(asked).join(available.select(column).distinct(), column)


def enough(rows: DataFrame, n: int, strict: bool) -> DataFrame:
    """SRT-09: an error if strict and fewer than n rows are there, checked as the query runs."""
    if not strict:
        return rows
    total = rows.agg(F.assert_true(F.count(F.lit(1)) >= n, f"fewer than {n} rows").alias("ok"))
    return rows.join(F.broadcast(total.select(F.lit(1).alias("_k"), F.isnull("ok").alias("_ok"))), F.lit(1) == F.col("_k")).where("_ok").drop("_k", "_ok")


def last_write_wins(records: DataFrame, *, keys: list[str], value: str, order: str) -> DataFrame:
    """WIN-08, SRC-09: the latest value of each key."""
    return records.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def pending(listed: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """FIL-12, JOIN-07, SET-03: listed rows without a terminal record."""
    return listed.join(done.select(*keys).distinct(), keys, "left_anti")
