"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def literal_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from Python values, built in the JVM (no Python worker in the plan).

    Its row count is known on the driver, which is what lets callers broadcast
    it without a sizing job.
    """
    fields = StructType.fromDDL(schema).fields
    if not rows:
        return spark.createDataFrame([], schema)
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def checked_broadcast(df: DataFrame, max_rows: int, known_rows: int | None = None) -> DataFrame:
    """Broadcast ``df`` only where its row count is known beforehand (a literal frame) and within ``max_rows``.

    Otherwise no hint is given and no job is run to find out: AQE picks the
    join from the sizes it measures.
    """
    if known_rows is not None and known_rows <= max_rows:
        return F.broadcast(df)
    return df
