"""The linkage's tables acted out by the driver's star schema.

Entities are customers, years those of their orders, voters suppliers; a pair's score is
1 - discount - tax and its distance the quantity. Registry names are the addresses of pages. Every
proxy reads its whole tables and whole columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

YEARS = tuple(range(1995, 2002))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scored row per (npi, year, voter)."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = line.join(orders, line.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("npi"),
        F.year("o_orderdate").alias("year"),
        F.col("l_suppkey").alias("voter"),
        F.round(1 - F.col("l_discount") - F.col("l_tax"), 2).alias("match_prob"),
        F.col("l_quantity").alias("zip_dist"),
        F.col("l_tax").alias("full_name_sim"),
    )
    pairs = rows.groupBy("npi", "year", "voter").agg(F.max("match_prob").alias("match_prob"), F.min("zip_dist").alias("zip_dist"), F.max("full_name_sim").alias("full_name_sim"))
    homes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("npi"), F.col("c_nationkey").alias("cn"))
    seats = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("voter"), F.col("s_nationkey").alias("sn"))
    pairs = pairs.join(homes, "npi").join(seats, "voter").withColumn("state_agree", F.col("cn") == F.col("sn"))
    return pairs.withColumn("LALVOTERID", F.lpad(F.col("voter").cast("string"), 9, "0")).withColumn("state", F.col("cn").cast("string")).drop("voter", "cn", "sn")


def gap_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    rows = customers.select(F.col("c_custkey").alias("npi"), F.col("c_nationkey").alias("b"), F.explode(F.array(*map(F.lit, YEARS))).alias("year"))
    moved = F.when((F.col("npi") + F.col("year")) % 20 == 0, (F.col("b") + 1) % 25).otherwise(F.col("b"))
    return rows.select("npi", "year", moved.cast("string").alias("state"))


def gap_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = F.explode(F.array(*map(F.lit, YEARS))).alias("year")
    grid = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("b"), years)
    return grid.where((F.col("b") * 7 + F.col("year")) % 11 != 0).select(F.col("b").cast("string").alias("state"), "year")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as registry rows: the address is the name; without its query and fragment it is the short one, its language the middle one."""
    pages, url = table(spark, sf_dir, "pages"), F.lower("url")
    language = F.split_part(url, F.lit("/"), F.lit(4))
    middle = F.when(F.col("page_id") % 5 < 2, F.substring(language, 1, 1)).otherwise(language)
    return pages.select(
        "page_id",
        F.split_part(url, F.lit(":"), F.lit(1)).alias("kind"),
        url.alias("name"),
        F.regexp_replace(url, "[?#].*", "").alias("short"),
        middle.alias("mid"),
        F.substring(language, 1, 1).alias("mi"),
        (F.floor(F.col("page_id") / 12) % 4).cast("string").alias("block"),
        (F.floor(F.col("page_id") / 6) % 3 == 0).alias("is_left"),
    )


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of entities as their orders state them: some orders contradict the others in one, the other or both."""
    orders, key = table(spark, sf_dir, "orders"), F.col("o_custkey")
    year = 1960 + key % 40 + F.when(F.floor("o_totalprice") % 25 == 0, 1).otherwise(0)
    school = F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P"), "other").otherwise(F.concat(F.lit("school "), (key % 7).cast("string")))
    return orders.select(key.alias("npi"), year.cast("int").alias("grd_yr"), F.when(key % 11 != 0, school).alias("med_sch"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("name"))
