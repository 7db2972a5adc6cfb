"""Readers for the Parquet tables a job starts from."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table under ``root``.

    Reads are lazy: Catalyst prunes columns and pushes filters into the scan,
    so callers select what they need and never pre-materialise.
    """
    return spark.read.parquet(os.path.join(root, f"{name}.parquet"))
