"""Spark plumbing of the operators: durable intermediate tables and Arrow batch settings."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch. Texts can be long, so a batch holds fewer than Spark's 10,000 rows.
BATCH_ROWS = 1_000


_shipped: set[str] = set()


def _ship(spark: SparkSession) -> None:
    """Sends this package to the executors, which need not have it on their path."""
    if spark.sparkContext.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="linkwright-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(spark.sparkContext.applicationId)


def prepared(spark: SparkSession) -> None:
    """The package on the executors, a checkpoint folder, and for this session batches of BATCH_ROWS rows.

    The folder is the one that spark.checkpoint.dir names; only a local[...] master may go without one.
    """
    _ship(spark)
    if not spark.sparkContext.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and re.match(r"local(\[|$)", spark.sparkContext.master) is None:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="linkwright-"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def durable(frame: DataFrame) -> DataFrame:
    """frame, computed now and kept in the shared checkpoint folder; lost executors cost nothing done before."""
    prepared(frame.sparkSession)
    return frame.checkpoint(eager=True)


def release(spark: SparkSession, wait: float = 0.2, turns: int = 2) -> None:
    """Lets Spark remove shuffle files (and checkpoints, where the session cleans them) that no frame refers to any more.

    What the last job used is found unused in the second turn only. wait: seconds a turn, given to the
    executors, which remove files in the background.
    """
    for _ in range(turns):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(wait)


def text_volume(docs: DataFrame, column: str = "text") -> int:
    return int(docs.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
