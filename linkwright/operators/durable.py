"""Intermediate tables that later steps read more than once."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def durable(frame: DataFrame) -> DataFrame:
    """frame, computed now and kept in the checkpoint folder, so that a plan that reads it often holds it once.

    The folder is the one that spark.checkpoint.dir names; only a local[...] master may go without one.
    """
    spark = frame.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and re.match(r"local(\[|$)", spark.sparkContext.master) is None:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="linkwright-"))
    return frame.checkpoint(eager=True)
