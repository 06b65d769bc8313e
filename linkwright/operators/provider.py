"""The provider dimension and its conflict report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_distinct_values

GROUPING = "Allopathic & Osteopathic Physicians"


def conflict_split(attributes: DataFrame, key: str = "npi") -> tuple[DataFrame, DataFrame]:
    """(rows of keys with one distinct row, keys with several); NULL attributes are values."""
    rows = attributes.distinct()
    conflicted = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    return rows.join(conflicted, key, "left_anti"), conflicted


def practice_address(core: DataFrame) -> DataFrame:
    """addr_source, state and zip: the practice's address if it names a state, else the mailing one."""
    practice = F.coalesce(F.col("plocstatename") != "", F.lit(False))
    pick = lambda a, b: F.when(practice, F.col(a)).otherwise(F.col(b))
    return core.withColumns({"addr_source": F.when(practice, "practice").otherwise("mailing"), "state": pick("plocstatename", "pmailstatename"), "zip": pick("ploczip", "pmailzip")})


def provider_dimension(core: DataFrame, taxonomy: DataFrame, cms: DataFrame, nucc: DataFrame, grouping: str = GROUPING) -> DataFrame:
    """One row per (npi, year) of individuals in the grouping, all years of core at once."""
    clean, conflicted = conflict_split(cms.select(F.col("npi").cast("long").alias("npi"), "grd_yr", "med_sch"))
    people = practice_address(core.where("entity = 1")).select(
        F.col("npi").cast("long").alias("npi"),
        F.col("pfname").alias("provider_first_name"),
        F.col("pmname").alias("provider_middle_name"),
        F.col("plname").alias("provider_last_name"),
        "state",
        "zip",
        "addr_source",
        *(["year"] if "year" in core.columns else []),
    )
    # the grouping is demanded of every row, so the crosswalk joins as an inner one
    codes = nucc.where(F.col("grouping") == grouping).withColumnRenamed("code", "taxonomy_code")
    return people.join(conflicted, "npi", "left_anti").join(taxonomy, "npi").join(codes, "taxonomy_code").join(clean, "npi", "left")


def count_conflicts(attributes: DataFrame, key: str = "npi", first: str = "grd_yr", second: str = "med_sch") -> DataFrame:
    """One row: how many keys have conflicting rows, and in which attribute."""
    each = attributes.select(key, first, second).distinct().groupBy(key).agg(F.count("*").alias("n"), count_distinct_values(first).alias("f"), count_distinct_values(second).alias("s"))
    out = each.agg(
        F.count("*").alias("n_npi"),
        F.count_if(F.col("n") > 1).alias("n_conflicting"),
        F.max("n").alias("max_rows_per_npi"),
        F.count_if((F.col("f") > 1) & (F.col("s") == 1)).alias("n_grd_yr_only"),
        F.count_if((F.col("f") == 1) & (F.col("s") > 1)).alias("n_med_sch_only"),
        F.count_if((F.col("f") > 1) & (F.col("s") > 1)).alias("n_both"),
    )
    share = F.try_divide(F.col("n_conflicting").cast("double"), F.col("n_npi").cast("double"))
    return out.select("n_npi", "n_conflicting", share.alias("pct_conflicting"), "max_rows_per_npi", "n_grd_yr_only", "n_med_sch_only", "n_both")
