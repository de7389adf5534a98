"""Tables that cut a plan's lineage: Parquet in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set, a temporary one, which only a driver that runs all tasks itself may have."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="framelake-"))
    return sc.getCheckpointDir()


class Scratch:
    """Parquet tables of one operator run in the shared folder; they outlive executors, and go when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)

    def save(self, df: DataFrame, **options: str) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete saved tables that nothing will read again."""
        jvm = self.spark.sparkContext._jvm
        for df in tables:
            for file in df.inputFiles()[:1]:
                at = jvm.org.apache.hadoop.fs.Path(file).getParent()
                if str(at.getParent().toString()).endswith(self.root.rpartition("/")[2]):
                    at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
