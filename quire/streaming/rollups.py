"""Roll-ups kept up to date while their logs arrive.

The same aggregations as in batch (``completion.usage_rollup``, ``checks.latest_status``)
run on a stream of log rows. Spark's state store holds a row a group, checkpointed with the
stream's offsets, so a log row is read once however long the log gets. After every
micro-batch the groups as they then stand are written to a folder of that batch: a batch
that is repeated after a failure writes the same folder again, with the same totals.
Groups are few (a provider and model, a component), so a folder is small.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire.operators import checks, completion

#: Batches whose totals stay, for readers that began before the newest one.
KEEP = 10


class RunningRollup:
    """Totals of a log under ``root``, with the stream's checkpoint beside them: neither is of use without the other.

    One stream at a time may run on a root. ``start`` takes the streaming aggregation, always the same one.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(self.root, *parts))

    def _batches(self) -> list[int]:
        """Batches whose totals are written whole, in order."""
        folder = self._path("totals")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[len("batch-"):]) for n in found
                      if n.startswith("batch-") and fs.exists(self._path("totals", n, "_SUCCESS")))

    def start(self, totals: DataFrame, available_now: bool = True, processing_time: str = "10 seconds") -> StreamingQuery:
        """Start the stream; ``available_now`` takes what is there and stops. Without new log rows nothing is written."""

        def each(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(os.path.join(self.root, "totals", f"batch-{batch_id}"))
            for old in self._batches():
                if old <= batch_id - KEEP:
                    folder = self._path("totals", f"batch-{old}")
                    folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

        out = totals.writeStream.outputMode("complete").foreachBatch(each).option(
            "checkpointLocation", os.path.join(self.root, "checkpoint"))
        return (out.trigger(availableNow=True) if available_now else out.trigger(processingTime=processing_time)).start()

    def read(self) -> DataFrame:
        """The totals after the newest batch."""
        batches = self._batches()
        if not batches:
            raise FileNotFoundError(f"no totals yet under {self.root}")
        return self.spark.read.parquet(os.path.join(self.root, "totals", f"batch-{batches[-1]}"))


def start_usage_rollup(completions: DataFrame, root: str, **trigger) -> StreamingQuery:
    """A5 on a stream of completions; ``read_usage_rollup`` gives what ``usage_rollup`` gives of all that arrived."""
    return RunningRollup(completions.sparkSession, root).start(completion.usage_rollup(completions), **trigger)


def read_usage_rollup(spark: SparkSession, root: str) -> DataFrame:
    return RunningRollup(spark, root).read()


def start_health_rollup(status: DataFrame, root: str, **trigger) -> StreamingQuery:
    """A6 on a stream of status rows, in any order: a late row doesn't replace a newer one. Of rows of a component with
    equal times any may count, as in batch."""
    return RunningRollup(status.sparkSession, root).start(checks.latest_status(status), **trigger)


def read_health_rollup(spark: SparkSession, root: str, components: bool = False) -> DataFrame:
    """The overall status by the components' latest flags (see ``checks.health_rollup``)."""
    return checks.overall_health(checks.with_status_word(RunningRollup(spark, root).read()), components)
