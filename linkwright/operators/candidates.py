"""Candidate pairs of providers and voters: within a block, then across neighbouring blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_miles, symmetric_neighbours
from ..functions.text import clean_name, initial, jaccard_ngram, joined_name, mentions
from .durable import durable
from .simjoin import similarity_join

OCCUPATION = "CommercialData_Occupation"
OCCUPATION_LATER = "ConsumerData_Occupation_of_Person"


def prepare_providers(frame: DataFrame, missing: str | None = "NA") -> DataFrame:
    """full_name, full_name_no_mid, st and mi, and the short names of the name columns."""
    first, middle, last = (F.col(f"provider_{p}_name") for p in ("first", "middle", "last"))
    return frame.withColumns(
        {
            "full_name": joined_name(first, F.coalesce(middle, F.lit("")), last, missing=missing),
            "full_name_no_mid": joined_name(first, last, missing=missing),
            "st": F.lower(F.coalesce("state", F.lit(""))),
            "mi": initial(middle),
        }
    ).withColumnsRenamed({"provider_first_name": "frst_nm", "provider_middle_name": "mid_nm", "provider_last_name": "last_nm"})


def occupation(frame: DataFrame, year: str = "year", last_old: int = 2024) -> Column:
    """The occupation under whichever name the row's year uses; a missing column reads as NULL."""
    named = lambda c: F.col(c) if c in frame.columns else F.lit(None).cast("string")
    return F.when(F.col(year) <= last_old, named(OCCUPATION)).otherwise(named(OCCUPATION_LATER))


def prepare_voters(frame: DataFrame, extra: list[str] | None = None, missing: str | None = "NA") -> DataFrame:
    """Voter columns that exist among those wanted, the occupation under one name, and derived keys."""
    from ..schemas import VOTER_COLUMNS

    needed = ["LALVOTERID", "Residence_Addresses_Zip", "Residence_Addresses_State", "Residence_Addresses_City"]
    frame = frame.withColumn("_occupation", occupation(frame))
    wanted = [c for c in frame.columns if c in needed or c in VOTER_COLUMNS or c.startswith("Voters_") or "Occupation" in c or c in (extra or ["state", "year"])]
    frame = frame.select(*[c for c in wanted if c not in (OCCUPATION, OCCUPATION_LATER)], F.col("_occupation").alias(OCCUPATION))
    first, last = F.col("Voters_FirstName"), F.col("Voters_LastName")
    middle = F.col("Voters_MiddleName") if "Voters_MiddleName" in frame.columns else F.lit(None).cast("string")
    job = F.col(OCCUPATION)
    return frame.withColumns(
        {
            "full_name": joined_name(first, F.coalesce(middle, F.lit("")), last, missing=missing),
            "full_name_no_mid_l2": joined_name(first, last, missing=missing),
            "st": F.lower(F.coalesce("Residence_Addresses_State", F.lit(""))),
            "mi": initial(middle),
            "medical": mentions(job, "Medical"),
            "na_medical": F.coalesce(job == "Unknown", F.lit(True)),
            "medical_sub": F.when(mentions(job, "Medical"), job).otherwise("None"),
        }
    )


def candidate_ids(providers: DataFrame, voters: DataFrame, left_key: str, right_key: str, names: tuple[str, str] = ("full_name", "full_name"), short_names: tuple[str, str] = ("full_name_no_mid", "full_name_no_mid_l2"), middles: tuple[str, str] = ("mid_nm", "Voters_MiddleName"), blocks: dict[str, str] | None = None, k: int = 3, threshold: float = 0.7, clean: bool = True) -> DataFrame:
    """(left_id, right_id): whole names alike, or names without middle ones where a middle one is at most an initial."""
    blocks = blocks or {}
    tidy = clean_name if clean else (lambda c: c)
    text = lambda f, c: f.withColumn("_text", tidy(F.col(c)))
    whole = similarity_join(text(providers, names[0]), text(voters, names[1]), left_key, right_key, "_text", k=k, threshold=threshold, blocks=blocks)
    short = similarity_join(text(providers, short_names[0]), text(voters, short_names[1]), left_key, right_key, "_text", k=k, threshold=threshold, blocks={**blocks, "mi": "mi"})
    length = lambda f, key, c, out: f.select(F.col(key).alias(out), F.char_length(F.coalesce(c, F.lit(""))).alias(f"len_{out}"))
    lengths = short.join(length(providers, left_key, middles[0], "left_id"), "left_id").join(length(voters, right_key, middles[1], "right_id"), "right_id")
    short = lengths.where("len_left_id <= 1 or len_right_id <= 1")
    return whole.select("left_id", "right_id").unionByName(short.select("left_id", "right_id")).distinct()


def pair_features(pairs: DataFrame, centroids: DataFrame | None = None) -> DataFrame:
    """Features of attribute-joined pairs (clashing names carry .x for the provider, .y for the voter).

    What name_features() has found is taken from its columns.
    """
    x, y = (lambda c: F.col(f"`{c}.x`")), (lambda c: F.col(f"`{c}.y`"))
    known = {c: F.coalesce(F.col(c), F.lit("")) for c in ("mid_nm", "Voters_MiddleName")}
    found = lambda c, made: F.col(f"_{c}") if f"_{c}" in pairs.columns else made
    out = pairs.withColumns(known).withColumns(
        {
            "full_name_sim": found("full_name_sim", jaccard_ngram(x("full_name"), y("full_name"), 3)),
            "state_agree": x("st") == y("st"),
            "mid_initial_agree": F.lower(F.substring("mid_nm", 1, 1)) == F.lower(F.substring("Voters_MiddleName", 1, 1)),
            "mid_name_agree": found("mid_name_agree", jaccard_ngram(F.lower("mid_nm"), F.lower("Voters_MiddleName"), 2)),
            "phys_mid_name_len": F.char_length("mid_nm"),
            "voters_mid_name_len": F.char_length("Voters_MiddleName"),
            "year_dist": F.col("grd_yr") - F.year(F.to_date("Voters_BirthDate")),
        }
    ).drop("_full_name_sim", "_mid_name_agree")
    return zip_distance(out, centroids, "zip", "Residence_Addresses_Zip") if centroids is not None else out


def zip_distance(frame: DataFrame, centroids: DataFrame, left_zip: str, right_zip: str, out: str = "zip_dist") -> DataFrame:
    """Miles between the centroids of two ZIP codes' first five digits; NULL where one has none.

    A code that centroids repeat (readers.read_centroids() keeps the first) counts with its least coordinates.
    """
    points = centroids.groupBy("zcta5").agg(F.min(F.struct("intptlat", "intptlong")).alias("_p")).select("zcta5", "_p.*")
    side = lambda s: points.select(F.col("zcta5").alias(f"_z{s}"), F.col("intptlat").alias(f"_lat{s}"), F.col("intptlong").alias(f"_lon{s}"))
    # no hint: the national file (33,000 rows, under 1 MB) is under Spark's own broadcast limit
    frame = frame.join(side(1), F.substring(left_zip, 1, 5) == F.col("_z1"), "left").join(side(2), F.substring(right_zip, 1, 5) == F.col("_z2"), "left")
    return frame.withColumn(out, haversine_miles(*map(F.col, ("_lat1", "_lon1", "_lat2", "_lon2")))).drop("_z1", "_z2", "_lat1", "_lon1", "_lat2", "_lon2")


def attach(ids: DataFrame, providers: DataFrame, voters: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Attributes of both sides of (left_id, right_id); shared names get .x and .y."""
    shared = set(providers.columns) & set(voters.columns)
    side = lambda f, key, end, out: f.select(F.col(key).alias(out), *[F.col(f"`{c}`").alias(f"{c}.{end}" if c in shared else c) for c in f.columns])
    return ids.join(side(providers, left_key, "x", "left_id"), "left_id").join(side(voters, right_key, "y", "right_id"), "right_id").drop("left_id", "right_id")


def name_features(ids: DataFrame, left: DataFrame, right: DataFrame, middles: tuple[str, str] = ("mid_nm", "Voters_MiddleName")) -> DataFrame:
    """ids with the names' keys in place of their numbers, and the features that depend on the names alone."""
    side = lambda f, middle, s: f.select(F.col("_number").alias(f"{s}_id"), F.col("_key").alias(f"{s}_key"), F.col("full_name").alias(f"{s}_name"), F.lower(F.coalesce(F.col(middle), F.lit(""))).alias(f"{s}_mid"))
    rows = ids.join(side(left, middles[0], "left"), "left_id").join(side(right, middles[1], "right"), "right_id")
    return rows.select(F.col("left_key").alias("left_id"), F.col("right_key").alias("right_id"), jaccard_ngram(F.col("left_name"), F.col("right_name"), 3).alias("_full_name_sim"), jaccard_ngram(F.col("left_mid"), F.col("right_mid"), 2).alias("_mid_name_agree"))


def _named_pairs(providers: DataFrame, voters: DataFrame, centroids: DataFrame, blocks: dict[str, str], k: int, threshold: float) -> DataFrame:
    """Candidate pairs with features. Rows of a block that agree in all names are compared as one, and each name's rows follow at last.

    Names have numbers meanwhile. Their pairs are kept, so that no plan holds both joins and what follows them:
    the driver plans anew after each stage, and what it needs for that grows with the square of a plan.
    """
    parts = ("full_name", "mi")
    left = ("full_name_no_mid", "mid_nm", *parts, *blocks)
    right = ("full_name_no_mid_l2", "Voters_MiddleName", *parts, *blocks.values())
    # a missing value is left out of the text, so that it differs from an empty one
    key = lambda f, columns: f.withColumn("_key", F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])))
    a, b = key(providers, left), key(voters, right)
    names = [durable(f.select("_key", *columns).distinct().withColumn("_number", F.monotonically_increasing_id())) for f, columns in ((a, left), (b, right))]
    ids = durable(candidate_ids(*names, "_number", "_number", blocks=blocks, k=k, threshold=threshold))
    return pair_features(attach(name_features(ids, *names), a, b, "_key", "_key").drop("_key.x", "_key.y"), centroids)


def match_pairs(providers: DataFrame, voters: DataFrame, centroids: DataFrame, blocks: tuple[str, ...] = ("year", "state"), k: int = 3, threshold: float = 0.7) -> DataFrame:
    """Stage A: candidate pairs within blocks, with features."""
    return _named_pairs(providers, voters, centroids, {c: c for c in blocks}, k, threshold)


def unmatched(providers: DataFrame, pairs: DataFrame, keys: tuple[str, ...] = ("npi", "year", "state"), sim: str = "full_name_sim", min_name_sim: float = 0.85) -> DataFrame:
    """Providers that have not exactly one strong candidate in their own block."""
    strong = pairs.where(F.col(sim) >= min_name_sim).groupBy(*keys).agg(F.count("*").alias("n")).where("n = 1").select(*keys)
    return providers.join(strong, list(keys), "left_anti")


def expand_to_neighbours(leftovers: DataFrame, pairs: DataFrame, available: DataFrame | None = None, state: str = "state", keys: tuple[str, ...] = ("year", "state")) -> DataFrame:
    """leftovers once per neighbouring block (nb_state); only of blocks that have voters themselves."""
    if available is not None:
        leftovers = leftovers.join(available.select(*keys).distinct(), list(keys), "left_semi")
    # 109 pairs of states: a fixed size
    neighbours = symmetric_neighbours(pairs).select(F.col("state").alias(state), F.col("neighbour").alias("nb_state"))
    return leftovers.join(F.broadcast(neighbours), state)


def cross_border(providers: DataFrame, voters: DataFrame, stage_a: DataFrame, adjacency: DataFrame, centroids: DataFrame, available: DataFrame, k: int = 3, threshold: float = 0.7, min_name_sim: float = 0.85) -> DataFrame:
    """Stage B: leftovers of Stage A against the neighbouring states' voters of the same year."""
    own = stage_a.select("npi", F.col("`year.x`").alias("year"), F.col("`state.x`").alias("state"), "full_name_sim")
    rest = expand_to_neighbours(unmatched(providers, own, min_name_sim=min_name_sim), adjacency, available)
    return _named_pairs(durable(rest), voters, centroids, {"year": "year", "nb_state": "state"}, k, threshold).drop("nb_state")
