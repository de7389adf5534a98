"""Exact deduplication over a log-structured merge index of text digests.

Each task's rows are a memtable that is flushed as a run: a file sorted by
digest, with a filter beside it, the 64 leading bits of each digest
(`fingerprint`). Compaction merges the runs to one entry a digest that keeps the
smallest doc_id. It consults the filters first: a digest whose fingerprint stands
in the filters once only is in no other run, nor twice in its own, so it is its own
entry and is neither merged nor looked up. The others are read from the runs and
merged. Digests that then occur twice or more are hits: the bytes of their texts are compared
(smallest against largest text of the digest, which map-side aggregation does
without bringing a group together), and should bytes differ under one digest,
its texts are told apart by their bytes. `lookup` asks the same filters for a later batch.

Defined results: a null text is an empty text; empty texts equal each other. A
null doc_id never names a group that has another id, and only a group of null
ids has a null keep_id. Rows that repeat a doc_id and its text have the same
answer; `dedup` keeps one of them, so each text stays once. An empty table gives an empty result. Other columns
of the input pass `dedup` unchanged and aren't read by `classes`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import Scratch, checked, text_or_empty, without_rows

def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; single spaces need no rewriting."""
    return F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def fingerprint(digest: Column) -> Column:
    """64 leading bits of a digest (all of it, if it is shorter)."""
    return F.conv(F.hex(F.substring(digest, 1, 8)), 16, -10).cast("long")


def flushed(scratch: Scratch, entries: DataFrame) -> DataFrame:
    """The runs of entries (doc_id, digest, ..): a file for each task, sorted by digest, with their filter as column `fp`."""
    return scratch.save(entries.withColumn("fp", fingerprint(F.col("digest"))).sortWithinPartitions("digest"))


def suspects(runs: DataFrame) -> DataFrame:
    """Fingerprints (fp) that the filters hold twice or more; only that column of the runs is read."""
    return runs.groupBy("fp").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("fp")


def compacted(scratch: Scratch, runs: DataFrame) -> DataFrame:
    """digest, keep_id, group_size of the digests that pass the filters; all others are alone."""
    passed = scratch.save(suspects(runs))
    merged = runs.select("doc_id", "digest", "fp").join(checked(passed, 16), "fp", "left_semi").groupBy("digest")
    return scratch.save(merged.agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))


def lookup(runs: DataFrame, batch: DataFrame) -> DataFrame:
    """digest and keep_id of the digests of a later batch (digest) that the runs hold; runs are read only where their filter holds one."""
    asked = batch.select("digest").distinct().withColumn("fp", fingerprint(F.col("digest")))
    hits = runs.join(checked(asked, 56), ["fp", "digest"], "left_semi")
    return hits.groupBy("digest").agg(F.min("doc_id").alias("keep_id"))


def classes(docs: DataFrame, *, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept for each row of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "exact")
    text = normalised(text_or_empty())
    runs = flushed(scratch, docs.select("doc_id", digest(text).alias("digest"), F.sha2(text, 256).alias("text_sha256")))
    index = compacted(scratch, runs)
    hits = index.where("group_size > 1")
    hit_rows = docs.select(text.alias("text"), digest(text).alias("digest")).join(checked(hits.select("digest"), 48), "digest", "left_semi")
    differ = scratch.save(hit_rows.groupBy("digest").agg(F.min("text").alias("lo"), F.max("text").alias("hi")).where("lo <> hi").select("digest"))
    alone = {"keep_id": F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")), "group_size": F.coalesce("group_size", F.lit(1))}
    entries = runs.drop("fp")
    if differ.isEmpty():
        answer = entries.join(checked(hits, 64), "digest", "left").withColumns(alone)
    else:
        # A digest that stands for different bytes: its texts are grouped by their bytes.
        odd = docs.select("doc_id", text.alias("text"), digest(text).alias("digest"), F.sha2(text, 256).alias("text_sha256")).join(differ, "digest", "left_semi")
        keep = odd.groupBy("digest", "text").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        told = odd.join(keep, ["digest", "text"]).drop("text")
        answer = entries.join(hits, "digest", "left").join(differ, "digest", "left_anti").withColumns(alone).unionByName(told)
    return answer.select("doc_id", "keep_id", F.col("group_size").cast("long"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def dedup(docs: DataFrame, **options) -> DataFrame:
    """docs with one row for each text, of its smallest doc_id; all columns stay. Rows are told apart by doc_id and text."""
    found = classes(docs, **options).select("doc_id", F.col("text_sha256").alias("digest"), "kept")
    return without_rows(docs, F.sha2(normalised(text_or_empty()), 256), found)


def op8(spark, sf_dir: str) -> DataFrame:
    from framelake.llm.common import documents

    return classes(documents(spark, sf_dir))


OP8_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
"""
