"""State borders and great-circle distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The states, and for each the later ones that it has a land border or corner with
#: (borders in water only are left out).
STATES = "AL AK AZ AR CA CO CT DC DE FL GA HI IA ID IL IN KS KY LA MA MD ME MI MN MO MS MT NC ND NE NH NJ NM NV NY OH OK OR PA RI SC SD TN TX UT VA VT WA WI WV WY".split()
BORDERS = {
    "AL": "FL GA MS TN",
    "AR": "LA MO MS OK TN TX",
    "AZ": "CA CO NM NV UT",
    "CA": "NV OR",
    "CO": "KS NE NM OK UT WY",
    "CT": "MA NY RI",
    "DC": "MD VA",
    "DE": "MD NJ PA",
    "FL": "GA",
    "GA": "NC SC TN",
    "IA": "IL MN MO NE SD WI",
    "ID": "MT NV OR UT WA WY",
    "IL": "IN KY MO WI",
    "IN": "KY MI OH",
    "KS": "MO NE OK",
    "KY": "MO OH TN VA WV",
    "LA": "MS TX",
    "MA": "NH NY RI VT",
    "MD": "PA VA WV",
    "ME": "NH",
    "MI": "OH WI",
    "MN": "ND SD WI",
    "MO": "NE OK TN",
    "MS": "TN",
    "MT": "ND SD WY",
    "NC": "SC TN VA",
    "ND": "SD",
    "NE": "SD WY",
    "NH": "VT",
    "NJ": "NY PA",
    "NM": "OK TX UT",
    "NV": "OR UT",
    "NY": "PA VT",
    "OH": "PA WV",
    "OK": "TX",
    "OR": "WA",
    "PA": "WV",
    "SD": "WY",
    "TN": "VA",
    "UT": "WY",
    "VA": "WV",
}
EARTH_MILES = 6371 / 1.609344


def adjacency_pairs() -> list[tuple[str, str]]:
    return [(a, b) for a, others in BORDERS.items() for b in others.split()]


def state_adjacency(spark: SparkSession) -> DataFrame:
    """(state_a, state_b), each undirected pair once."""
    return spark.createDataFrame(adjacency_pairs(), "state_a string, state_b string")


def symmetric_neighbours(pairs: DataFrame, a: str = "state_a", b: str = "state_b") -> DataFrame:
    """(state, neighbour) in both directions."""
    both = pairs.select(F.col(a).alias("state"), F.col(b).alias("neighbour"))
    return both.unionByName(both.select(F.col("neighbour").alias("state"), F.col("state").alias("neighbour"))).distinct()


def adjacent_states(state: str) -> list[str]:
    pairs = adjacency_pairs()
    return sorted({b for a, b in pairs if a == state} | {a for a, b in pairs if b == state})


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance of points in degrees; NULL where a coordinate is missing."""
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    # least() would pass over a NULL
    return F.when(h.isNotNull(), 2 * EARTH_MILES * F.asin(F.sqrt(F.least(F.lit(1.0), h))))


def haversine_sql() -> str:
    """The same as a SQL function body over lat1, lon1, lat2, lon2."""
    return f"2 * {EARTH_MILES!r} * asin(sqrt(least(1.0D, pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon1)) / 2), 2))))"
