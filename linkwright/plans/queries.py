"""The query catalogue: every operator of the linkage on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import adjacency_pairs, haversine_miles, state_adjacency, symmetric_neighbours
from ..functions.text import count_distinct_values, jaccard_ngram, mentions
from ..operators import candidates, checks, gaps, panel, provider, sampling, scoring
from ..operators.durable import durable
from ..operators.simjoin import similarity_join
from ..sources.readers import newest_per_key
from ..sources.snapshots import latest_snapshots, path_date, path_key
from .proxies import YEARS, attributes, documents, gap_snapshots, gap_universe, names, pair_rows, table

MIN_PROB, MAX_DIST = 0.99, 25.0


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.candidate_count(pair_rows(spark, sf_dir), "npi", "year")


def panel_best_per_year(spark, sf_dir):
    return panel.best_per_year(_scored(spark, sf_dir))


def reconcile_best_match(spark, sf_dir):
    return panel.reconcile(panel_best_per_year(spark, sf_dir))


def _gaps(spark, sf_dir):
    best = panel.best_per_year(_scored(spark, sf_dir))
    return best, gaps.classify_gaps(best, gap_universe(spark, sf_dir), gap_snapshots(spark, sf_dir), MIN_PROB, MAX_DIST)


def gap_classify(spark, sf_dir):
    return _gaps(spark, sf_dir)[1]


def gap_fill_panel(spark, sf_dir):
    return gaps.fill_gaps(*_gaps(spark, sf_dir))


def gap_summary(spark, sf_dir):
    return gaps.summarise_gaps(_gaps(spark, sf_dir)[1], MAX_DIST)


def cms_conflicts(spark, sf_dir):
    return provider.count_conflicts(attributes(spark, sf_dir))


def provider_dim(spark, sf_dir):
    customers, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    nations = nation.select(F.col("n_nationkey"), F.col("n_name"))
    core = customers.join(nations, customers.c_nationkey == nations.n_nationkey).select(
        F.col("c_custkey").alias("npi"),
        F.when(F.col("c_custkey") % 5 == 0, 2).otherwise(1).alias("entity"),
        F.col("c_name").alias("pfname"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("pmname"),
        F.col("c_mktsegment").alias("plname"),
        F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("n_name")).alias("plocstatename"),
        F.lpad((F.col("c_custkey") % 1000).cast("string"), 5, "0").alias("ploczip"),
        F.lit("MAIL").alias("pmailstatename"),
        F.lit("00501").alias("pmailzip"),
    )
    taxonomy = customers.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("npi"), F.col("n_regionkey").cast("string").alias("taxonomy_code"))
    crosswalk = region.select(F.col("r_regionkey").cast("string").alias("code"), F.when(F.col("r_regionkey") < 3, provider.GROUPING).otherwise("Other").alias("grouping"), F.col("r_name").alias("classification"))
    return provider.provider_dimension(core, taxonomy, attributes(spark, sf_dir), crosswalk)


def taxonomy_newest_wins(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("npi"), F.col("o_orderpriority").alias("taxonomy_code"), F.year("o_orderdate").alias("vintage"))
    return newest_per_key(orders, "npi", F.desc("vintage"), F.asc("taxonomy_code"))


def latest_snapshot(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.weekofyear("ts").alias("week"), F.to_date("ts").alias("day"))
    newest = latest_snapshots(events.select("event_type", "week", "day").distinct(), ("event_type", "week"), "day")
    return events.join(newest, ["event_type", "week", "day"], "left_semi").withColumn("day", F.col("day").cast("string"))


def path_key_parse(spark, sf_dir):
    d = F.to_date("ts")
    event = F.col("event_id")
    month = F.when(event % 2 == 0, F.lpad(F.month(d).cast("string"), 2, "0")).otherwise(F.month(d).cast("string"))
    path = F.concat(F.lit("raw/state="), F.upper(F.substring("event_type", 1, 2)), F.lit("/year="), F.year(d).cast("string"), F.lit("/month="), month, F.lit("/day="), F.dayofmonth(d).cast("string"), F.lit("/part.parquet"))
    rows = table(spark, sf_dir, "events").select("event_id", path.alias("path"))
    return rows.select("event_id", path_key(F.col("path"), "state").alias("state"), path_key(F.col("path"), "year").cast("int").alias("year"), path_date(F.col("path")).cast("string").alias("extract_date"))


def schema_drift_coalesce(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.year("o_orderdate").alias("year"),
        F.when(F.year("o_orderdate") <= 1997, F.col("o_orderpriority")).alias(candidates.OCCUPATION),
        F.when(F.year("o_orderdate") > 1997, F.col("o_orderstatus")).alias(candidates.OCCUPATION_LATER),
    )
    job = candidates.occupation(orders, last_old=1997)
    return orders.select("o_orderkey", job.alias("occupation"), mentions(job, "urgent").alias("medical"), F.coalesce(job == "F", F.lit(True)).alias("unknown"))


def stage_b_selector(spark, sf_dir):
    pairs = pair_rows(spark, sf_dir)
    universe = gap_universe(spark, sf_dir)
    return candidates.unmatched(universe, pairs, ("npi", "year"), "match_prob", 0.99)


def ngram_jaccard_pairs(spark, sf_dir, k: int = 3):
    """Each whole document text against the next one's."""
    docs = documents(spark, sf_dir)
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("name").alias("next_name"))
    return docs.join(other, "doc_id").select("doc_id", F.round(jaccard_ngram(F.col("name"), F.col("next_name"), k), 9).alias("sim"))


def ngram_jaccard_k2(spark, sf_dir):
    return ngram_jaccard_pairs(spark, sf_dir, 2)


def _simjoin(spark, sf_dir, blocks):
    rows = names(spark, sf_dir)
    found = similarity_join(rows, rows, "page_id", "page_id", "name", threshold=0.7, blocks=blocks, ascending=True)
    return found.select("left_id", "right_id", F.round("sim", 9).alias("sim"))


def simjoin_unblocked(spark, sf_dir):
    return _simjoin(spark, sf_dir, [])


def simjoin_blocked(spark, sf_dir):
    return _simjoin(spark, sf_dir, ["kind"])


def _registries(spark, sf_dir):
    rows = names(spark, sf_dir)
    return rows.where("is_left").drop("is_left"), rows.where("not is_left").drop("is_left")


def candidate_union_features(spark, sf_dir):
    left, right = _registries(spark, sf_dir)
    ids = candidates.candidate_ids(left, right, "page_id", "page_id", ("name", "name"), ("short", "short"), ("mid", "mid"), {"kind": "kind", "block": "block"}, clean=False)
    side = lambda f, key, end: f.select(F.col("page_id").alias(key), F.col("name").alias(f"name_{end}"), F.col("mid").alias(f"mid_{end}"), F.col("mi").alias(f"mi_{end}"))
    pairs = ids.join(side(left, "left_id", "x"), "left_id").join(side(right, "right_id", "y"), "right_id")
    return pairs.select(
        "left_id",
        "right_id",
        F.round(jaccard_ngram(F.col("name_x"), F.col("name_y"), 3), 9).alias("full_name_sim"),
        F.round(jaccard_ngram(F.col("mid_x"), F.col("mid_y"), 2), 9).alias("mid_name_agree"),
        (F.col("mi_x") == F.col("mi_y")).alias("mid_initial_agree"),
    )


def _ring(spark):
    return spark.createDataFrame([(str(i), str((i + 1) % 4)) for i in range(4)], "state_a string, state_b string")


def cross_block_retry(spark, sf_dir):
    left, right = _registries(spark, sf_dir)
    own = similarity_join(left, right, "page_id", "page_id", "name", threshold=0.7, blocks=["kind", "block"]).withColumnRenamed("left_id", "page_id")
    rest = durable(candidates.unmatched(left, own, ("page_id",), "sim", 0.85))  # the second join reads it more than once
    far = candidates.expand_to_neighbours(rest, _ring(spark), right, state="block", keys=("block",))
    key = F.concat_ws("|", F.col("page_id").cast("string"), "nb_state")
    found = similarity_join(far.withColumn("_key", key), right, "_key", "page_id", "name", threshold=0.7, blocks={"kind": "kind", "nb_state": "block"})
    return found.select(F.split("left_id", r"\|")[0].cast("long").alias("left_id"), F.split("left_id", r"\|")[1].alias("nb_block"), "right_id", F.round("sim", 9).alias("sim"))


def state_adjacency_closure(spark, sf_dir):
    return symmetric_neighbours(state_adjacency(spark)).orderBy("state", "neighbour")


def _points(spark, sf_dir):
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", (25 + key * 0.9).alias("lat"), (-120 + key * 2.1).alias("lon"))


def haversine_nation_pairs(spark, sf_dir):
    a, b = (_points(spark, sf_dir).toDF(f"k{s}", f"lat{s}", f"lon{s}") for s in (1, 2))
    # all ordered pairs of 25 nations: the table has a fixed size
    return a.join(F.broadcast(b), F.col("k1") < F.col("k2")).select("k1", "k2", F.round(haversine_miles(*map(F.col, ("lat1", "lon1", "lat2", "lon2"))), 6).alias("miles"))


def zip_prefix_lookup(spark, sf_dir):
    points = _points(spark, sf_dir).select(F.lpad((F.col("n_nationkey") * 3).cast("string"), 5, "0").alias("zcta5"), F.col("lat").alias("intptlat"), F.col("lon").alias("intptlong"))
    zip_of = lambda c: F.concat(F.lpad((c % 60).cast("string"), 5, "0"), F.lit("-0001"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", zip_of(F.col("c_custkey")).alias("zip_a"), zip_of(F.col("c_nationkey") * 3).alias("zip_b"))
    return candidates.zip_distance(rows, points, "zip_a", "zip_b").select("c_custkey", F.round("zip_dist", 6).alias("zip_dist"))


def candidate_count_n(spark, sf_dir):
    return _scored(spark, sf_dir).select("npi", "year", "LALVOTERID", "n")


def _labelled(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return scoring.candidate_count(line, "l_orderkey").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").alias("zip_dist"),
        F.when(F.col("l_linenumber") == 2, F.lit(None)).otherwise(F.year("l_shipdate") - 1960).alias("year_dist"),
        F.col("l_discount").alias("full_name_sim"),
        (F.col("l_linestatus") == "O").alias("mid_initial_agree"),
        F.col("l_tax").alias("mid_name_agree"),
        "n",
        F.when(F.col("l_linenumber") == 3, F.lit(None)).when(F.col("l_returnflag") == "N", "Medical-Nurse").otherwise("Unknown").alias("CommercialData_Occupation"),
        (F.col("l_returnflag") == "R").cast("double").alias("match"),
    )


def feature_matrix(spark, sf_dir):
    return scoring.feature_columns(_labelled(spark, sf_dir)).select("l_orderkey", "l_linenumber", *scoring.PREDICTORS)


def rf_score_pairs(spark, sf_dir, training_rows: int = 5_000, trees: int = 30):
    """match_prob of every lineitem row, n being counted over all rows of its order.

    training_rows: the most rows that the forest is fitted on, those first by a hash of their key
    (a training set has a fixed size); trees: the forest's size.
    """
    rows = _labelled(spark, sf_dir)
    train = sampling.draw(rows, training_rows, 1, "l_orderkey", "l_linenumber")
    scored = scoring.score_pairs(scoring.train_forest(train, trees=trees), rows.drop("n"), keys=("l_orderkey",))
    return scored.select("l_orderkey", "l_linenumber", "n", F.round("match_prob", 9).alias("match_prob"))


def grid_cross_join(spark, sf_dir):
    years = spark.createDataFrame([(y,) for y in YEARS], "year int")
    nation = table(spark, sf_dir, "nation").select(F.col("n_name").alias("state"))
    return nation.crossJoin(F.broadcast(years))  # years x states, both of a fixed size


def uniqueness_check(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    one = checks.uniqueness(line, "l_orderkey", "l_linenumber").withColumn("key", F.lit("orderkey,linenumber"))
    return one.unionByName(checks.uniqueness(line, "l_orderkey").withColumn("key", F.lit("orderkey")))


def null_aware_distinct(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("p", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    return rows.groupBy("o_custkey").agg(count_distinct_values("p").alias("n_values"), F.count_distinct("p").alias("n_known"))


def sample_training(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return sampling.draw(docs, 1_500, 0, "doc_id").select("doc_id", "lang", "observation")


def coder_agreement_kappa(spark, sf_dir):
    out = sampling.coder_agreement(table(spark, sf_dir, "labels"), "quality", "toxic")
    return out.select("n", F.round("agreement", 9).alias("agreement"), F.round("kappa", 9).alias("kappa"))


QUERIES = {
    f.__name__: f
    for f in (
        panel_best_per_year, reconcile_best_match, gap_classify, gap_fill_panel, gap_summary, cms_conflicts, provider_dim, taxonomy_newest_wins, latest_snapshot, path_key_parse,
        schema_drift_coalesce, stage_b_selector, ngram_jaccard_pairs, ngram_jaccard_k2, simjoin_unblocked, simjoin_blocked, candidate_union_features, cross_block_retry,
        state_adjacency_closure, haversine_nation_pairs, zip_prefix_lookup, candidate_count_n, feature_matrix, rf_score_pairs, grid_cross_join, uniqueness_check,
        null_aware_distinct, sample_training, coder_agreement_kappa,
    )
}
ADJACENCY_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in adjacency_pairs())
