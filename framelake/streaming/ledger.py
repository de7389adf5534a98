"""A sink that holds each batch once: records in a folder by batch, and a ledger of the batches that are whole."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.sources import exists
from framelake.sources.sinks import replace_file


class Ledger:
    """Records (JSON lines) of numbered batches under a path.

    A batch is written to its own folder, in place of what a broken run left there,
    and then entered by a small file that appears in one step. A batch that is entered
    is not written again, and readers see entered batches only; so a batch that runs
    again, whole or from its middle, adds each record once.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.root, self.schema = spark, path.rstrip("/"), schema

    def has(self, batch: int) -> bool:
        return exists(self.spark, self._entry(batch))

    def _entry(self, batch: int) -> str:
        return f"{self.root}/ledger/{batch:012d}.json"

    def write(self, records: DataFrame, batch: int) -> bool:
        """Whether the batch was written; False if it was there."""
        if self.has(batch):
            return False
        records.withColumn("number", F.monotonically_increasing_id()).write.mode("overwrite").option("ignoreNullFields", True).json(f"{self.root}/records/batch={batch}")
        replace_file(self.spark, self._entry(batch), json.dumps({"batch": batch}).encode())
        return True

    def entered(self) -> DataFrame:
        """(batch) of the batches that are whole."""
        if not exists(self.spark, f"{self.root}/ledger"):
            return self.spark.createDataFrame([], "batch long")
        return self.spark.read.schema("batch long").option("pathGlobFilter", "*.json").json(f"{self.root}/ledger").where("batch is not null")

    def next_batch(self) -> int:
        return (self.entered().agg(F.max("batch")).first()[0] or 0) + 1

    def records(self) -> DataFrame:
        """The records of entered batches, with batch and number, which order them."""
        if not exists(self.spark, f"{self.root}/records"):
            return self.spark.createDataFrame([], f"{self.schema}, number long, batch long")
        found = self.spark.read.schema(f"{self.schema}, number long, batch long").json(f"{self.root}/records")
        return found.join(self.entered(), "batch", "left_semi").select(*[c for c in found.columns if c != "batch"], "batch")
