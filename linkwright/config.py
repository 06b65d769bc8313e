"""Parameters of the linkage and the years and states that a run covers."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from .functions.geo import STATES

YEARS_VARIABLE, STATES_VARIABLE = "LINK_YEARS", "LINK_STATES"


def _listed(name: str) -> list[str]:
    return [x.strip() for x in os.environ.get(name, "").split(",") if x.strip()]


def scoped_years() -> list[int]:
    """The years to build: 2018 to 2025, or those that LINK_YEARS lists."""
    return [int(y) for y in _listed(YEARS_VARIABLE)] or list(range(2018, 2026))


def scoped_states() -> list[str]:
    """The states to build: all 50 and DC, or those that LINK_STATES lists."""
    return [s.upper() for s in _listed(STATES_VARIABLE)] or list(STATES)


@dataclass(frozen=True)
class LinkageConfig:
    ngram: int = 3
    middle_ngram: int = 2
    threshold: float = 0.7
    min_name_sim: float = 0.85
    min_fill_prob: float = 0.9
    max_fill_zip_dist: float = 50.0
    trees: int = 2_000
    years: list[int] = field(default_factory=scoped_years)
    states: list[str] = field(default_factory=scoped_states)
