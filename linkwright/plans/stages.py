"""Queries that run the linkage's stages and its sources and sinks as a build does: on files, with names, states and years."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LinkageConfig
from ..functions.geo import state_adjacency
from ..functions.text import register_sql_functions
from ..operators import candidates, sampling
from ..sources import catalogue, readers, snapshots
from .build import core_of_years
from .linkage import year_state_grid
from .proxies import table

STATES = ("CT", "NY", "MA", "RI")


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that spark.checkpoint.dir names; only a local[...] master may go without."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and re.match(r"local(\[|$)", spark.sparkContext.master) is None:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='linkwright-')}/{uuid.uuid4().hex}"


def _zip(c):
    return F.concat(F.lpad((c % 60).cast("string"), 5, "0"), F.lit("-0001"))


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as people: name parts, a state, a year, an age; missing and short middle names among them."""
    key = F.col("p_partkey")
    middle = F.when(key % 5 == 0, F.lit(None)).otherwise(F.substring("p_brand", 7, 10))
    state = F.element_at(F.array(*map(F.lit, STATES)), (key % 4 + 1).cast("int"))
    people = table(spark, sf_dir, "part").select(key.alias("key"), F.col("p_name").alias("first"), middle.alias("middle"), F.concat_ws(" ", "p_type", "p_size").alias("last"), state.alias("state"), (2018 + F.floor(key / 4) % 2).cast("int").alias("year"))
    return people.withColumns({"zip": _zip(F.col("key") * 7), "left": F.floor(F.col("key") / 8) % 3 == 0})


def _providers(people: DataFrame) -> DataFrame:
    names = [F.col(c).alias(f"provider_{c}_name") for c in ("first", "middle", "last")]
    rows = people.where("left").select(F.col("key").alias("npi"), *names, "state", "year", "zip", (1960 + F.col("key") % 40).cast("int").alias("grd_yr"))
    return candidates.prepare_providers(rows)


def _voters(people: DataFrame) -> DataFrame:
    job = F.when(F.col("key") % 3 == 0, "Medical-Doctor").when(F.col("key") % 3 == 1, "Unknown")
    rows = people.where("not left").select(
        F.concat(F.lit("V"), F.col("key").cast("string")).alias("LALVOTERID"),
        *[F.col(c).alias(f"Voters_{c.title()}Name") for c in ("first", "middle", "last")],
        F.col("state").alias("Residence_Addresses_State"),
        F.col("zip").alias("Residence_Addresses_Zip"),
        F.lit("Town").alias("Residence_Addresses_City"),
        F.make_date(1930 + (F.col("key") % 50).cast("int"), F.lit(5), F.lit(1)).alias("Voters_BirthDate"),
        job.alias(candidates.OCCUPATION),
        F.lit("left out").alias("Other"),
        "state",
        "year",
    )
    return candidates.prepare_voters(rows)


def provider_names(spark, sf_dir):
    return _providers(_people(spark, sf_dir)).select("npi", "full_name", "full_name_no_mid", "st", "mi", "frst_nm", "mid_nm", "last_nm")


def voter_columns(spark, sf_dir):
    return _voters(_people(spark, sf_dir)).drop("Residence_Addresses_City", "Voters_BirthDate")


def _centroids(spark, sf_dir):
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.lpad((key * 3).cast("string"), 5, "0").alias("zcta5"), (25 + key * 0.9).alias("intptlat"), (-120 + key * 2.1).alias("intptlong"))


PAIR = ("npi", "LALVOTERID", "full_name_sim", "state_agree", "mid_initial_agree", "mid_name_agree", "phys_mid_name_len", "voters_mid_name_len", "year_dist", "zip_dist")


def _shown(pairs: DataFrame) -> DataFrame:
    shown = pairs.select(*PAIR)
    return shown.withColumns({c: F.round(c, 9 if c != "zip_dist" else 6) for c in ("full_name_sim", "mid_name_agree", "zip_dist")})


def stage_a_pairs(spark, sf_dir):
    people = _people(spark, sf_dir)
    return _shown(candidates.match_pairs(_providers(people), _voters(people), _centroids(spark, sf_dir)))


def stage_b_pairs(spark, sf_dir):
    people = _people(spark, sf_dir)
    providers, voters, centroids = _providers(people), _voters(people), _centroids(spark, sf_dir)
    first = candidates.match_pairs(providers, voters, centroids)
    return _shown(candidates.cross_border(providers, voters, first, state_adjacency(spark), centroids, voters.select("year", "state").distinct()))


def source_catalogue(spark, sf_dir):
    rows = [("core", str(f.year), f.month, f.format, f.url) for f in map(catalogue.core_file, range(2018, 2026))]
    rows += [("taxonomy", v, None, None, url) for v, url in catalogue.TAXONOMY_FILES.items()]
    return spark.createDataFrame(rows, "kind string, vintage string, month int, format string, url string")


def scoped_grid(spark, sf_dir):
    config = LinkageConfig()
    return year_state_grid(spark, config.years, config.states)


def core_files(spark, sf_dir):
    """Customers as one CSV and one Parquet file of provider cores, read back as two years."""
    key, folder = F.col("c_custkey"), scratch(spark)
    state = F.when(key % 7 != 0, F.lit("CT"))
    rows = table(spark, sf_dir, "customer").select(
        F.lit("x").alias("more"), _zip(key).alias("pmailzip"), F.when(key % 5 == 0, 2).otherwise(1).alias("entity"), F.col("c_name").alias("pfname"), F.lit(None).cast("string").alias("pmname"),
        F.col("c_mktsegment").alias("plname"), state.alias("plocstatename"), F.lpad((key % 1000).cast("string"), 5, "0").alias("ploczip"), F.lit("NY").alias("pmailstatename"), key.alias("npi"),
    )
    rows.write.csv(f"{folder}/core.csv", header=True)
    rows.where(key % 2 == 0).write.parquet(f"{folder}/core.parquet")
    return core_of_years(spark, {2018: f"{folder}/core.csv", 2019: f"{folder}/core.parquet"}, [2018, 2019])


def taxonomy_files(spark, sf_dir):
    """Orders as taxonomy files of three vintages and one that no list names."""
    folder, paths, key = scratch(spark), [], F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    for part, vintage in enumerate(("2019-12", "2025-12", "2023-05", None)):
        path = f"{folder}/{catalogue.TAXONOMY_FILES[vintage].rsplit('/', 1)[1] if vintage else 'other.parquet'}"
        rows = orders.where(key % 4 == part).groupBy(F.col("o_custkey").alias("npi"), (key % 8 + 1).cast("int").alias("seq")).agg(F.min("o_orderpriority").alias("ptaxcode"))
        rows = rows.withColumn("seq", F.ceil(F.col("seq") / 4).cast("int")).groupBy("npi", "seq").agg(F.min("ptaxcode").alias("ptaxcode"))
        if path.endswith(".csv"):
            rows.write.csv(path, header=True)
        else:
            rows.write.parquet(path)
        paths.append(path)
    return readers.read_taxonomy_union(spark, paths)


def loose_csv(spark, sf_dir):
    """Attributes of a CSV file with more columns, headers of any case, and values that are no numbers."""
    path, key = f"{scratch(spark)}/attributes.csv", F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.col("c_name").alias("Display Name"), key.alias("NPI"), F.when(key % 3 == 0, "none").otherwise((1950 + key % 50).cast("string")).alias("grd_yr"), F.col("c_mktsegment").alias("Med_Sch"))
    rows.write.csv(path, header=True)
    return readers.read_attributes(spark, path)


def centroid_file(spark, sf_dir):
    """A CSV file of centroids that repeats codes: the first row of each."""
    path, key = f"{scratch(spark)}/centroids.csv", F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(F.lpad((key % 7).cast("string"), 5, "0").alias("zcta5"), (25 + key).cast("double").alias("intptlat"), (key - 120).cast("double").alias("intptlong"))
    rows.coalesce(1).sortWithinPartitions(F.desc("intptlat")).write.csv(path, header=True)
    return readers.read_centroids(spark, path)


def snapshot_tree(spark, sf_dir):
    """Events as a tree of snapshots by kind and day, of which the newest of each kind and year is read."""
    root = scratch(spark)
    events = table(spark, sf_dir, "events").select("event_id", F.upper(F.substring("event_type", 1, 2)).alias("state"), F.year("ts").alias("year"), F.month("ts").alias("month"), F.dayofmonth("ts").alias("day"))
    events.repartition("day").write.partitionBy("state", "year", "month", "day").parquet(root)
    subdir = snapshots.output_subdir(F.input_file_name())
    return snapshots.read_latest(spark, root).select("event_id", "state", "year", "month", "day", subdir.alias("subdir"))


def replaced_partitions(spark, sf_dir):
    """Orders written by status, one status replaced, and the whole replaced once before."""
    path = f"{scratch(spark)}/orders"
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    readers.write_dataset(orders.limit(10), path)
    spark.read.parquet(path)
    readers.write_dataset(orders, f"{path}-parts", ("o_orderstatus",))
    return readers.write_dataset(orders.where("o_orderstatus = 'P'").withColumn("o_custkey", -F.col("o_custkey")), f"{path}-parts", ("o_orderstatus",))


def several_files(spark, sf_dir):
    """Labels as two files, one without a column and each written as a single one, read together."""
    folder, labels = scratch(spark), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    readers.write_single(labels.where("doc_id % 2 = 0"), f"{folder}/one.parquet")
    readers.write_single(labels.where("doc_id % 2 = 1").drop("toxic"), f"{folder}/two.parquet")
    return readers.read_parquet(spark, f"{folder}/one.parquet", f"{folder}/two.parquet")


def training_parts(spark, sf_dir):
    """Rough sample with its overlapping parts, rule-labelled positives and negatives."""
    pairs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 50 == 0, "MD").alias("Voters_NameSuffix"), (F.col("doc_id") % 30).alias("year_dist"))
    parts = sampling.training_samples(pairs, "doc_id", total=300, sizes=(70, 160, 70), negatives=160)
    out = None
    for name, frame in parts.items():
        rows = frame.select(F.lit(name).alias("part"), "doc_id", F.col("match").cast("double").alias("match"))
        out = rows if out is None else out.unionByName(rows)
    return out


def coder_join(spark, sf_dir):
    """Two coders' labels of the observations that both have."""
    labels = table(spark, sf_dir, "labels")
    one = labels.where("doc_id % 3 != 0").select(F.col("doc_id").alias("observation"), F.col("quality").alias("match"))
    two = labels.where("doc_id % 3 != 1").select(F.col("doc_id").alias("observation"), F.col("toxic").alias("match"))
    return sampling.joined_labels(one, two).toDF("observation", "match_x", "match_y")


def sql_functions(spark, sf_dir):
    """The functions that SQL text can use."""
    register_sql_functions(spark)
    near = "jaccard_ngram(a.n_name, b.n_name, 2) AS sim, haversine_miles(25 + a.n_nationkey, -120, 25 + b.n_nationkey, -100.5) AS miles"
    table(spark, sf_dir, "nation").createOrReplaceTempView("_nations")
    out = spark.sql(f"SELECT a.n_nationkey AS a, b.n_nationkey AS b, {near} FROM _nations a JOIN _nations b ON b.n_nationkey = a.n_nationkey + 1")
    return out.select("a", "b", F.round("sim", 9).alias("sim"), F.round("miles", 6).alias("miles"))


QUERIES = {
    f.__name__: f
    for f in (
        provider_names, voter_columns, stage_a_pairs, stage_b_pairs, source_catalogue, scoped_grid, core_files, taxonomy_files, loose_csv, centroid_file, snapshot_tree, replaced_partitions,
        several_files, training_parts, coder_join, sql_functions,
    )
}
