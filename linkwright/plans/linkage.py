"""The whole linkage as one lazy plan: years and states are keys in the data, not branches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LinkageConfig
from ..functions.geo import state_adjacency
from ..operators import candidates, gaps, panel, provider, scoring


def year_state_grid(spark: SparkSession, years: list[int], states: list[str]) -> DataFrame:
    """Every year with every state (some hundred rows)."""
    return spark.createDataFrame([(y, s) for y in years for s in states], "year int, state string")


def link(spark: SparkSession, core: DataFrame, taxonomy: DataFrame, cms: DataFrame, nucc: DataFrame, voters: DataFrame, centroids: DataFrame, model: PipelineModel | DataFrame, config: LinkageConfig | None = None, keep: Callable[[str, DataFrame], DataFrame] = lambda name, frame: frame) -> dict[str, DataFrame]:
    """Every table of the linkage by name. core has a year column; voters are those of the newest
    snapshots with their state and year; model is a fitted forest or the labelled pairs to fit one on.
    keep(name, frame) is applied to each table before later ones read it: persist it, or write and reread it."""
    cfg = config or LinkageConfig()
    grid = year_state_grid(spark, cfg.years, cfg.states)
    physicians = keep("physician_data", provider.provider_dimension(core.where(F.col("year").isin(cfg.years)), taxonomy, cms, nucc))
    left = candidates.prepare_providers(physicians)
    # the grid has at most some hundred rows
    own = left.join(F.broadcast(grid), ["year", "state"], "left_semi")
    right = candidates.prepare_voters(voters)
    available = voters.select("year", "state").distinct()
    keyed = lambda f: f.withColumns({c: F.col(f"`{c}.x`") for c in ("year", "state")})
    stage_a = keep("lsh_pairs", keyed(candidates.match_pairs(own, right, centroids, k=cfg.ngram, threshold=cfg.threshold)))
    stage_b = keep("cross_border_pairs", keyed(candidates.cross_border(own, right, stage_a, state_adjacency(spark), centroids, available, cfg.ngram, cfg.threshold, cfg.min_name_sim)))
    fitted = model if isinstance(model, PipelineModel) else scoring.train_forest(model, trees=cfg.trees)
    scored = keep("scored_pairs", scoring.score_pairs(fitted, stage_a, stage_b))
    best = keep("physician_year_panel", panel.best_per_year(scored))
    found = keep("panel_gaps", gaps.classify_gaps(best, physicians, available, cfg.min_fill_prob, cfg.max_fill_zip_dist))
    return {
        "physician_data": physicians,
        "lsh_pairs": stage_a,
        "cross_border_pairs": stage_b,
        "scored_pairs": scored,
        "physician_year_panel": best,
        "physician_matches": keep("physician_matches", panel.reconcile(best)),
        "panel_gaps": found,
        "physician_year_panel_filled": keep("physician_year_panel_filled", gaps.fill_gaps(best, found)),
        "panel_gap_summary": keep("panel_gap_summary", gaps.summarise_gaps(found, cfg.max_fill_zip_dist)),
        "cms_npi_conflicts": keep("cms_npi_conflicts", provider.count_conflicts(cms)),
    }
