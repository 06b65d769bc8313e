"""The newest snapshot of each state and year in a state=/year=/month=/day= tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def path_key(path: Column, key: str) -> Column:
    """The value of key= in a path, NULL if there is none."""
    found = F.regexp_extract(path, f"(?<={key}=)[^/]+", 0)
    return F.when(found != "", found)


def path_date(path: Column) -> Column:
    """year=/month=/day= as a date, padded with zeros or not."""
    number = lambda k: F.regexp_extract(path, f"(?<={k}=)[0-9]+", 0).try_cast("int")
    return F.make_date(number("year"), number("month"), number("day"))


def output_subdir(path: Column) -> Column:
    """The output partition of a snapshot: year first, then state."""
    return F.concat(F.lit("year="), path_key(path, "year"), F.lit("/state="), path_key(path, "state"))


def list_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """One row per day directory, listed by the file system that the path belongs to."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/state=*/year=*/month=*/day=*")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    paths = spark.createDataFrame([(f.getPath().toString(),) for f in found], "path string")
    parts = [path_key(F.col("path"), k).cast("string" if k == "state" else "int").alias(k) for k in ("state", "year", "month", "day")]
    return paths.select(*parts, "path")


def latest_snapshots(snapshots: DataFrame, keys: tuple[str, ...] = ("state", "year"), date: str | None = None) -> DataFrame:
    """Of each key, the newest date's row; equal dates go by path."""
    when = F.col(date) if date else F.make_date("year", "month", "day")
    best = F.max_by(F.struct(*[c for c in snapshots.columns if c not in keys]), F.struct(when, F.col("path") if "path" in snapshots.columns else F.lit("")))
    return snapshots.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def resolve_snapshot(spark: SparkSession, root: str, state: str, year: int) -> str | None:
    found = latest_snapshots(list_snapshots(spark, root).where((F.col("state") == state) & (F.col("year") == year))).first()
    return found["path"] if found else None


def read_latest(spark: SparkSession, root: str, years: list[int] | None = None, states: list[str] | None = None) -> DataFrame:
    """Voters of the newest snapshots only: the resolved leaves are read, stale ones are not opened. NULL where a leaf lacks a column."""
    leaves = latest_snapshots(list_snapshots(spark, root))
    if years is not None:
        leaves = leaves.where(F.col("year").isin(years))
    if states is not None:
        leaves = leaves.where(F.col("state").isin(states))
    paths = [r.path for r in leaves.select("path").collect()]  # one for each state and year: some hundred
    if not paths:
        return schemas.empty(spark, schemas.schema(LALVOTERID="string", state="string", year="int", month="int", day="int"))
    return spark.read.option("basePath", root).option("mergeSchema", "true").parquet(*paths)


def absent(spark: SparkSession) -> DataFrame:
    return schemas.empty(spark, schemas.SNAPSHOTS)
