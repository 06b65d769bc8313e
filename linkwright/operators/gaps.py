"""Panel gaps: years in which an entity is on record without a match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_distinct_values

GAP_COLUMNS = "npi year state n_anchor_years n_anchor_voters n_anchor_states anchor_state fill_LALVOTERID anchor_match_prob anchor_zip_dist anchor_year l2_present has_anchor unambiguous state_stable near fillable fill_tier".split()


def classify_gaps(panel: DataFrame, universe: DataFrame, snapshots: DataFrame, min_fill_prob: float = 0.9, max_fill_zip_dist: float = 50.0) -> DataFrame:
    """Every gap with its four gates and tier: 1 no snapshot, 2 fillable within one, 3 not fillable."""
    universe = universe.select("npi", F.col("year").cast("int").alias("year"), "state").distinct()
    present = snapshots.select("state", F.col("year").cast("int").alias("year")).distinct().withColumn("l2_present", F.lit(True))
    anchors = panel.where(F.col("match_prob").isNotNull() & (F.col("match_prob") >= min_fill_prob))
    anchors = anchors.join(universe.select("npi", "year", F.col("state").alias("anchor_state")), ["npi", "year"], "left")
    best = F.min_by(F.struct("LALVOTERID", "match_prob", "zip_dist", "year"), F.struct(-F.col("match_prob"), F.col("LALVOTERID"), F.col("year")))
    support = anchors.groupBy("npi").agg(
        count_distinct_values("year").alias("n_anchor_years"),
        count_distinct_values("LALVOTERID").alias("n_anchor_voters"),
        count_distinct_values("anchor_state").alias("n_anchor_states"),
        F.min("anchor_state").alias("anchor_state"),
        best.alias("b"),
    )
    named = {"fill_LALVOTERID": "LALVOTERID", "anchor_match_prob": "match_prob", "anchor_zip_dist": "zip_dist", "anchor_year": "year"}
    support = support.select("*", *[F.col(f"b.{c}").alias(n) for n, c in named.items()]).drop("b")
    gaps = universe.join(panel.select("npi", "year").distinct(), ["npi", "year"], "left_anti").join(support, "npi", "left").join(present, ["state", "year"], "left")
    sure = lambda c: F.coalesce(c, F.lit(False))
    gaps = gaps.withColumns({"l2_present": sure(F.col("l2_present")), "has_anchor": F.col("fill_LALVOTERID").isNotNull()})
    gaps = gaps.withColumns(
        {
            "unambiguous": F.col("has_anchor") & sure(F.col("n_anchor_voters") == 1),
            "state_stable": F.col("has_anchor") & sure(F.col("n_anchor_states") == 1) & sure(F.col("anchor_state") == F.col("state")),
            "near": F.col("has_anchor") & sure(F.col("anchor_zip_dist") <= max_fill_zip_dist),
        }
    )
    gaps = gaps.withColumn("fillable", F.col("unambiguous") & F.col("state_stable") & F.col("near"))
    tier = F.when(F.col("fillable") & ~F.col("l2_present"), 1).when(F.col("fillable"), 2).otherwise(3)
    return gaps.withColumn("fill_tier", tier).select(*GAP_COLUMNS)


def fill_gaps(panel: DataFrame, gaps: DataFrame) -> DataFrame:
    """The panel with a row for every fillable gap; filled rows have no scores."""
    filled = gaps.where(F.col("fill_tier").isin(1, 2)).select("npi", "year", F.col("fill_LALVOTERID").alias("LALVOTERID"), F.lit(True).alias("filled"), "fill_tier")
    seen = panel.withColumns({"filled": F.lit(False), "fill_tier": F.lit(None).cast("int")})
    return seen.unionByName(filled, allowMissingColumns=True)


def summarise_gaps(gaps: DataFrame, max_fill_zip_dist: float = 50.0) -> DataFrame:
    """One row of counts; a gap may fail several gates."""
    lost = (F.col("fill_tier") == 3) & F.col("has_anchor")
    distance = F.col("anchor_zip_dist")
    return gaps.agg(
        F.count("*").alias("n_gaps"),
        count_distinct_values("npi").alias("n_npi_with_gap"),
        *[F.count_if(F.col("fill_tier") == t).alias(f"n_tier_{t}") for t in (1, 2, 3)],
        F.count_if((F.col("fill_tier") == 3) & ~F.col("has_anchor")).alias("n_fail_no_anchor"),
        F.count_if(lost & ~F.col("unambiguous")).alias("n_fail_ambiguous"),
        F.count_if(lost & ~F.col("state_stable")).alias("n_fail_moved"),
        F.count_if(lost & (distance > max_fill_zip_dist)).alias("n_fail_far"),
        F.count_if(lost & distance.isNull()).alias("n_fail_no_zip"),
        F.count_if((F.col("fill_tier") == 3) & ~F.col("l2_present")).alias("n_no_l2_unfilled"),
    )
