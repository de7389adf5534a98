"""Sharding by extendible hashing.

The directory is indexed by leading bits of a 60-bit hash of the key. A bucket
whose bytes pass the limit splits on its next bit, and only that bucket, until
each fits. Splits are found on sums of `STEP` more bits at a time: a round sums
bytes by prefix map-side, takes for each cell the first depth at which its
bucket fits, and goes on with the cells that fit at none. Only cell tables are
shuffled, never rows, until each row looks its cell up.

A bucket of one row can't be split, nor one of rows with equal keys: it stands
alone at its depth and is marked as not `fits`.

Defined results: a null text has 0 bytes. A null key hashes as an empty string.
Repeated rows have one hash and stay together. An empty table gives an empty
result and an empty directory. Other columns are not read by `assign`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import Scratch, checked, documents, packed

LIMIT_BYTES = 1 << 20
BITS = 60
STEP = 12


def key_hash(key: Column) -> Column:
    """60 bits: the first 15 hexadecimal digits of the key's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def prefix(h: Column, depth: Column) -> Column:
    """The leading `depth` of a hash's bits."""
    return F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def split(scratch: Scratch, rows: DataFrame, limit: int) -> DataFrame:
    """The directory of rows (h, bytes): cell, cell_depth, depth, prefix, shard_bytes, shard_rows, fits; cells don't overlap."""
    done, cells, low = [], scratch.save(rows), 0
    while True:
        high = min(low + STEP, BITS)
        sums = cells.groupBy(prefix(F.col("h"), F.lit(high)).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("h").alias("h0"), F.max("h").alias("h1"))
        levels = sums.withColumn("depth", F.explode(F.sequence(F.lit(low + (low > 0)), F.lit(high))))
        levels = levels.withColumn("prefix", F.call_function("shiftright", F.col("cell"), (F.lit(high) - F.col("depth")).cast("int")))
        by = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"), F.min("h0").alias("h0"), F.max("h1").alias("h1"))
        by = by.withColumn("fits", F.col("shard_bytes") <= limit).withColumn("ends", F.col("fits") | (F.col("h0") == F.col("h1")))
        chosen = levels.select("cell", "depth", "prefix").join(by.where("ends").drop("ends", "h0", "h1"), ["depth", "prefix"])
        first = chosen.groupBy("cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_rows", "fits")).alias("s")).select("cell", F.lit(high).alias("cell_depth"), "s.*")
        first = scratch.save(first)
        done.append(first)
        left = cells.withColumn("cell", prefix(F.col("h"), F.lit(high))).join(checked(first.select("cell"), 16), "cell", "left_anti").select("h", "bytes")
        left = scratch.save(left)
        if left.isEmpty():
            break
        cells, low = left, high
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def assign(docs: DataFrame, *, key: str = "doc_id", limit: int = LIMIT_BYTES) -> DataFrame:
    """The key, bytes, shard (depth:prefix), depth, shard_bytes, shard_rows, fits of each row of docs (key, text)."""
    scratch = Scratch(docs.sparkSession, "shards")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = scratch.save(docs.select(key, key_hash(F.col(key)).alias("h"), size.alias("bytes")))
    directory = scratch.save(split(scratch, rows.select("h", "bytes"), limit))
    n = directory.count()
    depths = [r[0] for r in directory.select("cell_depth").distinct().collect()]  # at most BITS / STEP
    found = None
    for d in sorted(depths):
        at = rows.withColumn("cell", prefix(F.col("h"), F.lit(d))).join(checked(directory.where(F.col("cell_depth") == d), 72, n), "cell")
        found = at if found is None else found.unionByName(at)
    if found is None:
        found = rows.withColumn("cell", F.col("h")).join(directory, "cell")
    shard = F.concat_ws(":", "depth", "prefix")
    return found.select(key, "bytes", shard.alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_rows", "fits")


def write(docs: DataFrame, path: str, *, key: str = "doc_id", limit: int = LIMIT_BYTES) -> None:
    """docs as Parquet, a folder a shard; rows of a shard are written by one task (or few, if split as skewed).

    The folders' column is `shard`; a column of docs with that name is written with underscores behind it.
    """
    shards = assign(docs, key=key, limit=limit).select(F.col(key).alias("_key"), F.col("shard").alias("_shard")).distinct()
    rows = packed(docs, F.col(key).alias("_own")).join(shards, F.col("_own").eqNullSafe(F.col("_key")))
    free = "shard_"
    while free in docs.columns:
        free += "_"
    rows = rows.select(*[F.col("_row").getField(c).alias(free if c == "shard" else c) for c in docs.columns], F.col("_shard").alias("shard"))
    rows.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)


def op5(spark, sf_dir: str) -> DataFrame:
    return assign(documents(spark, sf_dir).select("doc_id", "text"))


OP5_SQL = f"""
WITH r AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
l AS (SELECT doc_id, bytes, h, d AS depth, h >> ({BITS} - d) AS prefix FROM r, (SELECT unnest(range(0, {BITS} + 1))::INT AS d)),
s AS (SELECT depth, prefix, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows, sum(bytes) <= {LIMIT_BYTES} AS fits,
             sum(bytes) <= {LIMIT_BYTES} OR min(h) = max(h) AS ends FROM l GROUP BY ALL),
c AS (SELECT l.doc_id, l.bytes, s.* FROM l JOIN s USING (depth, prefix) WHERE ends)
SELECT doc_id, bytes, depth || ':' || prefix AS shard, depth, shard_bytes, shard_rows, fits
FROM c QUALIFY depth = min(depth) OVER (PARTITION BY doc_id)
"""
