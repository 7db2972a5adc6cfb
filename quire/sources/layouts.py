"""Tables laid out for how they are read: bucketed for joins (J1, J2, J4), sorted in ranges for listings (O2, K3)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.store import DEFAULT_PAGE_SIZE


def bucketed_table(df: DataFrame, by: str, path: str, buckets: int) -> DataFrame:
    """``df`` written under ``path``, bucketed and sorted by ``by``, and read back as a table.

    Tables bucketed alike join on ``by`` and are grouped by it without an exchange, however often. ``df`` is dealt out by
    ``by`` once, so a bucket is one file. A key with a large share of the rows fills its bucket, which AQE doesn't split:
    where that is so, the plain tables are the better ones.
    """
    name = f"quire_{uuid.uuid4().hex}"
    (df.repartition(buckets, by).write.format("parquet").bucketBy(buckets, by).sortBy(by)
     .option("path", path).saveAsTable(name))
    return df.sparkSession.table(name)


class SortedListing:
    """A listing by ``file_id`` whose pages cost the same however deep they lie.

    ``build`` writes the documents in ``ranges`` ranges of file_id, a folder each, and how many each holds. ``page`` adds
    up those counts (a number a range) and reads the ranges that the page lies in, not those before it. The listing is a
    copy as of when it was built.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def build(self, documents: DataFrame, ranges: int) -> SortedListing:
        rows = os.path.join(self.root, "rows")
        (documents.repartitionByRange(ranges, "file_id").withColumn("r", F.spark_partition_id())
         .sortWithinPartitions("r", "file_id").write.partitionBy("r").parquet(rows))
        self.spark.read.parquet(rows).groupBy("r").agg(F.count(F.lit(1)).alias("n")).write.parquet(os.path.join(self.root, "counts"))
        return self

    def counts(self) -> list[tuple[int, int]]:
        """(range, documents in it), in order: one row with a number a range."""
        found = self.spark.read.parquet(os.path.join(self.root, "counts")).agg(
            F.sort_array(F.collect_list(F.struct("r", "n"))).alias("all")).first()["all"]
        return [(x.r, x.n) for x in found]

    def page(self, skip: int = 0, limit: int = DEFAULT_PAGE_SIZE) -> DataFrame:
        """Documents ``skip`` to ``skip + limit`` in the order of file_id."""
        before, first, wanted = 0, 0, []
        for r, n in self.counts():
            if before + n > skip and before < skip + limit:
                if not wanted:
                    first = before
                wanted.append(r)
            before += n
        rows = self.spark.read.parquet(os.path.join(self.root, "rows")).where(F.col("r").isin(wanted)).drop("r")
        return rows.orderBy("file_id").offset(max(0, skip - first)).limit(limit)
