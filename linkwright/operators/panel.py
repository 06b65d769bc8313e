"""Best voter per entity and year, and one best match per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_per_year(scored: DataFrame) -> DataFrame:
    """The rows that reach the highest match_prob of their (npi, year); tied where there are several."""
    year = Window.partitionBy("npi", "year")
    best = scored.withColumn("_max", F.max("match_prob").over(year)).where("match_prob = _max").drop("_max")
    return best.withColumn("tied", F.count("*").over(year) > 1).select("npi", "year", "LALVOTERID", "match_prob", "state_agree", "zip_dist", "full_name_sim", "n", "tied")


def reconcile(panel: DataFrame) -> DataFrame:
    """One row per npi: the best match over all years with what the panel says around it.

    One aggregation: the best row is an arg-min over a total order (probability, then voter, then year),
    and the best is tied if the order by falling voters ends at another voter; both combine before the shuffle.
    """
    best = F.min_by(F.struct("LALVOTERID", "match_prob", "year", "state_agree"), F.struct(-F.col("match_prob"), F.col("LALVOTERID"), F.col("year")))
    return (
        panel.groupBy("npi")
        .agg(
            best.alias("b"),
            F.max_by("LALVOTERID", F.struct("match_prob", "LALVOTERID")).alias("_last"),
            F.count_distinct("year").alias("n_years_matched"),
            F.count_distinct("LALVOTERID").alias("n_distinct_voters"),
            F.bool_or("tied").alias("any_tied_in_year"),
        )
        .select(
            "npi",
            F.col("b.LALVOTERID").alias("best_LALVOTERID"),
            F.col("b.match_prob").alias("best_match_prob"),
            F.col("b.year").alias("best_year"),
            "n_years_matched",
            "n_distinct_voters",
            (F.col("n_distinct_voters") > 1).alias("mover"),
            "any_tied_in_year",
            (F.col("_last") != F.col("b.LALVOTERID")).alias("best_is_tied"),
            (~F.col("b.state_agree")).alias("best_cross_border"),
        )
    )
