"""Contracts on results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class NotUnique(ValueError):
    pass


def uniqueness(frame: DataFrame, *keys: str) -> DataFrame:
    """One row: n_rows, n_keys (NULL is a value) and whether they are equal."""
    # rows are counted per key first: two aggregations that combine before they shuffle
    each = frame.groupBy(*keys).agg(F.count("*").alias("n"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys")).withColumn("is_unique", F.col("n_rows") == F.col("n_keys"))


def assert_unique(frame: DataFrame, *keys: str) -> DataFrame:
    found = uniqueness(frame, *keys).first()
    if not found["is_unique"]:
        raise NotUnique(f"{found['n_rows']} rows, but {found['n_keys']} values of {', '.join(keys)}")
    return frame
