"""Order over all rows without a task that holds them all: ranks, running sums, quantiles, folds.

For ranks and sums rows are range partitioned once and written, so that the counts of the parts and
the rows themselves come from the same parts; a part is numbered by its own task,
and what the parts before it hold is added.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.checks import in_range
from framelake.scratch import Scratch

PART = "_part"
#: Rows that are numbered by one task.
SMALL = 20_000


def parted(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with PART, the number of their range in the order; written, so that it stays. Up to SMALL rows are one part."""
    scratch = Scratch(rows.sparkSession, "parts")
    once = scratch.save(rows.withColumn(PART, F.lit(0)))  # ranges are sampled before rows are dealt
    if once.count() <= SMALL:
        return once
    found = scratch.save(once.drop(PART).repartitionByRange(*order).withColumn(PART, F.spark_partition_id()))
    scratch.drop(once)
    return found


def before_parts(sums: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """sums (PART, by, names: a row for each part and key) with names as sums over the parts before."""
    before = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(PART, *by, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in names])


def running(rows: DataFrame, values: dict[str, Column], *, by: list[str], order: list[Column]) -> DataFrame:
    """rows, which are parted by (by, order), with running sums of values within each key."""
    named = rows.withColumns({f"_v_{n}": v for n, v in values.items()})
    sums = named.groupBy(PART, *by).agg(*[F.sum(f"_v_{n}").alias(n) for n in values])
    inner = Window.partitionBy(PART, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    named = named.withColumns({f"_i_{n}": F.sum(f"_v_{n}").over(inner) for n in values})
    keys = [PART, *by]
    offsets = before_parts(sums, list(values), by).select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[f"_{n}" for n in values])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = named.join(offsets, same)
    return out.select(*rows.columns, *[(F.col(f"_i_{n}") + F.col(f"_{n}")).alias(n) for n in values])


def ranked(rows: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """WIN-02 for any number of rows: rank from 1 in a total order."""
    return running(parted(rows, *order), {name: F.lit(1).cast("long")}, by=[], order=list(order)).drop(PART)


#: Cells into which the values that may hold a rank are counted.
CELLS = 1024


def quantiles(rows: DataFrame, values: dict[str, Column], ps: Sequence[float], *, by: Sequence[str] = ()) -> DataFrame:
    """AGG-03, AGG-15: (by, a column for each name, or name_0, name_1, ... for several ps): exact quantiles of some values in each group, between neighbours linear.

    Nulls and NaN don't count; groups without values have no row. Ranks are found by
    histograms: a pass counts the values of each group in `CELLS` cells between their
    least and greatest, map-side; the cell that holds a rank is counted again between
    its own least and greatest value, until these are equal. So rows are never sorted,
    shuffled or written, and two or three passes serve any number of rows. What is
    saved is a row for each rank; the driver learns only whether some are open.
    """
    for p in ps:
        in_range(0, 1, p=p)
    scratch, keys = Scratch(rows.sparkSession, "quantiles"), [*by, "_name"]
    named = rows.select(*by, F.inline(F.array(*[F.struct(F.lit(n).alias("_name"), v.cast("double").alias("_v")) for n, v in values.items()])))
    named = named.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    ends = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    places = F.array(*[F.struct(F.lit(i).alias("_p"), ((F.col("_all") - 1) * F.lit(float(p))).alias("_at")) for i, p in enumerate(ps)])
    wanted = ends.select(*keys, "_lo", "_hi", F.inline(places)).withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))))
    now = scratch.save(wanted.withColumn("_k", F.col("_rank")))  # _k: the rank among the values from _lo to _hi
    while not (unsettled := now.where("_lo < _hi")).isEmpty():
        ranges = unsettled.select(*[F.col(c).alias(f"_r{c}") for c in (*keys, "_lo", "_hi")]).distinct()
        found = named.join(ranges, _alike(keys, [f"_r{k}" for k in keys]) & F.col("_v").between(F.col("_r_lo"), F.col("_r_hi")))
        cells = found.groupBy(*ranges.columns, _cell(F.col("_v"), F.col("_r_lo"), F.col("_r_hi")).alias("_cell")).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        upto = Window.partitionBy(*ranges.columns).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)  # CELLS rows at most
        cells = cells.withColumn("_upto", F.sum("_n").over(upto))
        hit = unsettled.join(cells, _alike([*keys, "_lo", "_hi"], ranges.columns) & (F.col("_upto") > F.col("_k")) & (F.col("_upto") - F.col("_n") <= F.col("_k")))
        hit = hit.select(*keys, F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), "_p", "_at", "_rank", (F.col("_k") - F.col("_upto") + F.col("_n")).alias("_k"))
        after = scratch.save(now.where("_lo >= _hi").unionByName(hit))
        scratch.drop(now)
        now = after
    share = F.max("_at") - F.min("_rank")
    ends = now.groupBy(*keys, "_p").agg(F.min("_lo").alias("_lo"), F.max("_lo").alias("_hi"), share.alias("_share"))
    value = F.when(F.col("_hi") > F.col("_lo"), F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_share")).otherwise(F.col("_lo"))
    ends = ends.withColumn("_value", value)
    pick = lambda n, i: F.max(F.when((F.col("_name") == n) & (F.col("_p") == i), F.col("_value")))
    return ends.groupBy(*by).agg(*[pick(n, i).alias(n if len(ps) == 1 else f"{n}_{i}") for n in values for i in range(len(ps))])


def _alike(left: list[str], right: list[str]) -> Column:
    """Columns equal each other, nulls too."""
    same = F.lit(True)
    for a, b in zip(left, right, strict=True):
        same = same & F.col(a).eqNullSafe(F.col(b))
    return same


def _cell(v: Column, lo: Column, hi: Column) -> Column:
    """The cell of a value between lo and hi; infinite values have cells of their own, and halves keep differences finite."""
    big = F.lit(float("inf"))
    low, high = F.greatest(lo, F.lit(-1.7976931348623157e308)), F.least(hi, F.lit(1.7976931348623157e308))
    inner = F.floor((v / 2 - low / 2) / (high / 2 - low / 2) * CELLS).cast("int")
    return F.when(v == -big, -1).when(v == big, CELLS).when(v == lo, 0).when(v == hi, CELLS - 1).otherwise(F.least(F.greatest(inner, F.lit(0)), F.lit(CELLS - 1)))


def percentiles(rows: DataFrame, value: str, p: float, *, by: list[str], name: str) -> DataFrame:
    """AGG-03, AGG-15: the exact percentile of one column in each group; nulls and NaN don't count. by may be empty: then there is one row."""
    return quantiles(rows, {name: F.col(value)}, [p], by=by)


def folded(rows: DataFrame, *, by: str, order: list[str], start: Callable[[], object], step: Callable[[object, tuple], tuple | None], schema: str) -> DataFrame:
    """Rows that `step` gives while it goes over each group in order.

    rows is dealt by `by` and sorted, then streamed: a worker holds one batch and
    the state of one group, however long the group is. start() is a new state;
    step(state, row) changes it and gives a row of `schema`, or None.
    """
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        kind = _arrow(schema)
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != last:
                    last, state = row[0], start()
                made = step(state, row)
                if made is not None:
                    out.append(made)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind.field(i).type) for i in range(len(names))], schema=kind)

    parts = rows.repartition(by).sortWithinPartitions(by, *order)
    return parts.select(by, *[c for c in rows.columns if c != by]).mapInArrow(run, schema)


_TYPES = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([pa.field(name, _TYPES[kind]) for name, kind in (f.split() for f in schema.split(","))])
