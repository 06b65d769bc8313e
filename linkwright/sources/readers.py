"""Readers and writers of the registries' files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from .catalogue import taxonomy_vintage


def read_parquet(spark: SparkSession, *paths: str, columns: T.StructType | None = None) -> DataFrame:
    """Parquet files or trees; with columns, exactly these, NULL where a file lacks one (else the files' schemas are merged)."""
    reader = spark.read.schema(columns) if columns else spark.read.option("mergeSchema", "true")
    return reader.parquet(*paths)


def read_csv(spark: SparkSession, *paths: str, columns: T.StructType | None = None, headers: str = "keep") -> DataFrame:
    """CSV files with a header: all strings unless columns are declared; headers='snake' lower-cases and joins names."""
    if columns is None:
        frame = spark.read.option("header", True).csv(list(paths))
    else:
        # by name, not by place: the header decides which column is which; a value that is none of its type is NULL in any session
        frame = spark.read.option("header", True).csv(list(paths))
        frame = frame.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in columns.fields])
    return frame.toDF(*[c.lower().replace(" ", "_") for c in frame.columns]) if headers == "snake" else frame


def read_table(spark: SparkSession, path: str, columns: T.StructType) -> DataFrame:
    """A declared table, in the format that the path's extension names."""
    if path.endswith(".csv"):
        return read_csv(spark, path, columns=columns)
    frame = spark.read.parquet(path)
    return frame.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in columns.fields])


def read_provider_core(spark: SparkSession, path: str) -> DataFrame:
    """One year's provider core file; ZIP codes stay strings and keep their zeros."""
    return read_table(spark, path, schemas.PROVIDER_CORE)


def read_centroids(spark: SparkSession, path: str) -> DataFrame:
    """Centroids by ZIP code area; of a code that the file repeats, the first row."""
    rows = read_csv(spark, path, columns=schemas.CENTROIDS).withColumn("_at", F.monotonically_increasing_id())
    return rows.groupBy("zcta5").agg(F.min_by(F.struct("intptlat", "intptlong"), "_at").alias("_p")).select("zcta5", "_p.*")


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    """Provider attributes: npi, grd_yr, med_sch of a CSV file with any further columns."""
    frame = read_csv(spark, path, headers="snake")
    return frame.select(F.col("npi").try_cast("long").alias("npi"), F.col("grd_yr").try_cast("int").alias("grd_yr"), "med_sch")


def newest_per_key(frame: DataFrame, key: str | list[str], *newest: Column) -> DataFrame:
    """The first row of each key in the given order."""
    keys = [key] if isinstance(key, str) else key
    order = Window.partitionBy(*keys).orderBy(*newest)
    return frame.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def read_taxonomy_union(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(npi, taxonomy_code) of the newest listed vintage that has the provider; the order of paths is of no matter."""
    frames = []
    for path in paths:
        if vintage := taxonomy_vintage(path):
            frame = read_table(spark, path, schemas.TAXONOMY)
            frames.append(frame.where("seq = 1").select("npi", F.col("ptaxcode").alias("taxonomy_code"), F.lit(vintage).alias("vintage")))
    if not frames:
        return schemas.empty(spark, schemas.schema(npi="long", taxonomy_code="string"))
    union = frames[0]
    for f in frames[1:]:
        union = union.unionByName(f)
    return newest_per_key(union, "npi", F.desc("vintage"), F.asc("taxonomy_code")).drop("vintage")


def write_dataset(frame: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Replaces the dataset, or of a partitioned one the partitions that frame has, and reads it back."""
    spark = frame.sparkSession
    writer = frame.write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def write_single(frame: DataFrame, path: str) -> None:
    """A small table (training samples, summaries) as one file."""
    frame.coalesce(1).write.mode("overwrite").parquet(path)
