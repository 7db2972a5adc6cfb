"""Answers of providers, kept so that no call is paid for twice.

A folder of Parquet files, one folder a run: ``digest`` (of provider, options and what
was asked) and the answer's columns. A run writes its answers as its tasks end: each
task's file is moved into place when the task is committed, not when the job is, so
a run that is killed leaves the answers of the tasks that had ended. The next run
asks only for digests without an answer. Failed calls are written as rows with an
``error_kind``; they are results of their run, but no answers, and are asked again.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def digest_of(*asked: str | Column) -> Column:
    """SHA-256 of the given columns as JSON; nulls and empty strings differ."""
    return F.sha2(F.to_json(F.struct(*asked), {"ignoreNullFields": "false"}), 256)


class AnswerLedger:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def _exists(self) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.exists(path) and len(fs.listStatus(path)) > 0

    def rows(self, schema: str, run: str | None = None) -> DataFrame:
        """Everything that was written (by one run)."""
        if not self._exists():
            return self.spark.createDataFrame([], f"digest string, {schema}")
        out = self.spark.read.option("basePath", self.root).schema(f"digest string, {schema}, run string").parquet(self.root)
        return (out if run is None else out.where(F.col("run") == run)).drop("run")

    def answers(self, schema: str) -> DataFrame:
        """One answer a digest, of several (of runs at the same time) the least."""
        rows = self.rows(schema).where("error_kind is null")
        values = [c for c in rows.columns if c != "digest"]
        return rows.groupBy("digest").agg(F.min(F.struct(*values)).alias("a")).select("digest", "a.*")

    def add(self, answered: DataFrame) -> str:
        """Write rows as they come (see above); returns the run's name."""
        run = uuid.uuid4().hex
        # a task's file is in place when the task is committed
        answered.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(os.path.join(self.root, f"run={run}"))
        return run
