"""The build from files to files: read, link, write every table, check its contract, reread it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LinkageConfig
from ..operators.checks import assert_unique
from ..sources import catalogue, readers, snapshots
from .linkage import link


@dataclass(frozen=True)
class Inputs:
    """Where the sources are. core has a file for each year; voters is the root of a state=/year=/month=/day= tree."""

    core: dict[int, str]
    taxonomy: list[str]
    cms: str
    nucc: str
    centroids: str
    voters: str
    labelled: list[str]


#: What makes a row of each table; tables that are not listed have one row or no key.
KEYS = {
    "physician_data": ("npi", "year"),
    "lsh_pairs": ("npi", "LALVOTERID", "year"),
    "cross_border_pairs": ("npi", "LALVOTERID", "year"),
    "scored_pairs": ("npi", "LALVOTERID", "year"),
    "physician_year_panel": ("npi", "LALVOTERID", "year"),
    "physician_matches": ("npi",),
    "panel_gaps": ("npi", "year"),
}
PARTITIONS = {name: ("year", "state") for name in ("physician_data", "lsh_pairs", "cross_border_pairs")}


def fetched(folder: str, config: LinkageConfig | None = None) -> tuple[dict[int, str], list[str]]:
    """The public provider files of the configured years, fetched where they are not there yet: core by year, and taxonomy."""
    cfg = config or LinkageConfig()
    return {y: catalogue.fetch_core(y, folder) for y in cfg.years}, catalogue.fetch_taxonomy(folder)


def core_of_years(spark: SparkSession, files: dict[int, str], years: list[int]) -> DataFrame:
    """The core files of the years, each row with its file's year."""
    frames = [readers.read_provider_core(spark, files[y]).withColumn("year", F.lit(y)) for y in years]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def written(out: str) -> Callable[[str, DataFrame], DataFrame]:
    """A keep() for link(): replaces the table under out, checks its key, and reads it back."""

    def keep(name: str, frame: DataFrame) -> DataFrame:
        table = readers.write_dataset(frame, f"{out}/{name}", PARTITIONS.get(name, ()))
        if name in KEYS:
            assert_unique(table, *KEYS[name])
        if name == "physician_year_panel_filled":
            assert_unique(table.where("filled"), "npi", "year")
        return table

    return keep


def build(spark: SparkSession, inputs: Inputs, out: str, config: LinkageConfig | None = None, model: PipelineModel | None = None) -> dict[str, DataFrame]:
    """Every table of the linkage, written under out. model: a fitted forest, else one is fitted on the labelled files."""
    cfg = config or LinkageConfig()
    return link(
        spark,
        core_of_years(spark, inputs.core, cfg.years),
        readers.read_taxonomy_union(spark, inputs.taxonomy),
        readers.read_attributes(spark, inputs.cms),
        readers.read_csv(spark, inputs.nucc, headers="snake"),
        snapshots.read_latest(spark, inputs.voters, cfg.years),
        readers.read_centroids(spark, inputs.centroids),
        model or readers.read_parquet(spark, *inputs.labelled),
        cfg,
        keep=written(out),
    )
