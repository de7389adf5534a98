"""What the text operators share: word rules, scratch tables, size-checked joins."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.scratch import Scratch

#: Fixed by the contracts: what separates words, and what a word is.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A side is broadcast only if rows times bytes per row stay under this.
BROADCAST_BYTES = 32 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def words(text: Column) -> Column:
    """The words of a text in order, as an array of strings."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once; inside lambdas an expression would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of at most `rows` rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def packed(docs: DataFrame, *names: str | Column) -> DataFrame:
    """`names` beside the whole row as a struct `_row`, so that other columns can't clash with an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *names)


def unpacked(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of `_row`, those named in `new` replaced."""
    return df.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in columns])


def checked(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """Broadcast a side if its counted rows fit BROADCAST_BYTES; else leave the join to shuffle."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def without_ids(docs: DataFrame, dropped: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of docs whose key isn't in dropped; rows with a null key stay."""
    return docs.join(checked(dropped.select(key).distinct(), 16), key, "left_anti").select(*docs.columns)


def without_rows(docs: DataFrame, digest: Column, found: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id and digest are kept in found (doc_id, digest, kept; a row for each of docs); one of those equal in both.

    Nulls equal each other. Of equal rows the first by its JSON form stays; only such rows are grouped.
    """
    keys = found.groupBy("doc_id", "digest").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1 or not kept")
    keys = Scratch(docs.sparkSession, "rows").save(keys.select(F.col("doc_id").alias("_k"), F.col("digest").alias("_d"), "kept"))
    rows = packed(docs, F.col("doc_id").alias("_id"), digest.alias("_digest"))
    same = F.col("_id").eqNullSafe(F.col("_k")) & F.col("_digest").eqNullSafe(F.col("_d"))
    stay = rows.join(checked(keys, 112), same, "left_anti")
    twice = keys.where("kept")
    if not twice.isEmpty():
        ones = rows.join(checked(twice, 112), same, "left_semi").groupBy("_id", "_digest").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
        stay = stay.unionByName(ones.select(*stay.columns))
    return unpacked(stay, docs.columns)
