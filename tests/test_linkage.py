from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkwright import config, schemas
from linkwright.functions import geo, text
from linkwright.operators import candidates, checks, gaps, panel, provider, sampling, scoring
from linkwright.operators.simjoin import similarity_join
from linkwright.sources import catalogue, readers, snapshots


CORE = T.StructType([*schemas.PROVIDER_CORE.fields, T.StructField("year", T.IntegerType())])


def rows(frame, *names):
    return sorted(tuple(r[n] for n in names) for r in frame.collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_adjacency(spark):
    pairs = geo.adjacency_pairs()
    assert len(pairs) == len(set(pairs)) == 109
    assert not {(b, a) for a, b in pairs} & set(pairs) and all(a != b for a, b in pairs)
    assert len({s for p in pairs for s in p}) == 49
    assert geo.adjacent_states("DC") == ["MD", "VA"] and geo.adjacent_states("AK") == [] == geo.adjacent_states("HI")
    both = set(pairs) | {(b, a) for a, b in pairs}
    assert {("AZ", "CO"), ("NM", "UT"), ("MI", "WI"), ("NY", "PA")} <= both
    assert not {("RI", "NY"), ("MI", "IL"), ("MI", "NY"), ("MI", "PA"), ("MI", "MN")} & both
    assert geo.symmetric_neighbours(geo.state_adjacency(spark)).count() == 218


def test_haversine(spark):
    assert len(geo.STATES) == 51 and geo.EARTH_MILES == pytest.approx(3958.756, rel=1e-6)
    miles = one(spark, geo.haversine_miles(*map(F.lit, (41.3053, -72.9276, 40.7506, -73.9971))))
    assert miles == pytest.approx(67.649, abs=1e-3)
    assert one(spark, geo.haversine_miles(F.lit(None).cast("double"), *map(F.lit, (1.0, 2.0, 3.0)))) is None
    text.register_sql_functions(spark)
    assert spark.sql("SELECT haversine_miles(41.3053D, -72.9276D, 40.7506D, -73.9971D)").first()[0] == pytest.approx(miles)
    assert spark.sql("SELECT jaccard_ngram('abcd', 'abce', 3)").first()[0] == pytest.approx(1 / 3)


def test_ngram_jaccard(spark):
    j = lambda a, b, k: one(spark, text.jaccard_ngram(F.lit(a).cast("string"), F.lit(b).cast("string"), k))
    assert j("anna", "anne", 2) == pytest.approx(0.5)
    assert j("ab", "ab", 3) is None and j("ab", "abc", 3) == 0.0 and j(None, "abc", 3) is None


def test_similarity_join_is_exact(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(25)]
    data = [(i, "".join(c if rng.random() > 0.08 else rng.choice("abcd") for c in rng.choice(base)), rng.choice(["x", "y", None])) for i in range(160)]
    frame = spark.createDataFrame(data, "id long, name string, b string")
    grams = {i: {n[k : k + 3] for k in range(len(n) - 2)} for i, n, _ in data}
    for blocks in ([], ["b"]):
        want = {(i, j) for i, _, x in data for j, _, y in data if grams[i] and grams[j] and (not blocks or x == y is not None) and len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= 0.7}
        if blocks:
            want = {(i, j) for i, j in want if data[i][2] is not None}
        got = similarity_join(frame, frame, "id", "id", "name", blocks=blocks).collect()
        assert {(r.left_id, r.right_id) for r in got} == want and len(got) == len(want)
        half = similarity_join(frame, frame, "id", "id", "name", blocks=blocks, ascending=True).collect()
        assert {(r.left_id, r.right_id) for r in half} == {(i, j) for i, j in want if i < j} and all(r.sim == pytest.approx(len(grams[r.left_id] & grams[r.right_id]) / len(grams[r.left_id] | grams[r.right_id])) for r in half)


def scored(spark):
    data = [
        (21, 2018, "V21", 0.90, True), (21, 2019, "V21", 0.90, True), (21, 2018, "V21b", 0.30, True),
        (22, 2018, "V22a", 0.80, True), (22, 2019, "V22b", 0.95, True), (23, 2018, "V23", 0.70, True),
        (24, 2018, "V24a", 0.60, True), (24, 2018, "V24b", 0.60, True), (25, 2018, "V25", 0.88, False),
        (26, 2018, "V26a", 0.85, True), (26, 2019, "V26b", 0.85, True),
    ]
    return spark.createDataFrame([(n, v, p, a, 5.0, 0.9, 1, y) for n, y, v, p, a in data], schemas.SCORED)


def test_panel_and_reconcile(spark):
    best = panel.best_per_year(scored(spark))
    assert best.where("npi = 24").count() == 2 and best.where("npi = 24 and tied").count() == 2 and best.where("npi = 23").count() == 1
    out = {r.npi: r for r in panel.reconcile(best).collect()}
    assert len(out) == 6 and not out[21].mover and out[21].best_year == 2018 and out[21].n_years_matched == 2
    assert out[22].mover and out[22].n_distinct_voters == 2 and out[22].best_LALVOTERID == "V22b"
    assert out[24].any_tied_in_year and out[24].best_is_tied and out[24].best_LALVOTERID == "V24a" and out[24].mover
    assert out[25].best_cross_border and out[26].best_is_tied and not out[26].any_tied_in_year
    shuffled = panel.reconcile(panel.best_per_year(scored(spark).orderBy(F.rand(3)).repartition(3)))
    assert {r.npi: r for r in shuffled.collect()} == out
    checks.assert_unique(panel.reconcile(best), "npi")
    with pytest.raises(checks.NotUnique):
        checks.assert_unique(best, "npi")


def gap_tables(spark):
    universe, seen = [], []
    for npi, state in ((101, "MD"), (102, "CT"), (103, "CT"), (104, "CT"), (106, "CT"), (107, "CT")):
        years = (2023, 2024) if npi == 101 else (2018, 2019)
        universe += [(npi, y, state) for y in years]
    universe += [(105, 2018, "CT"), (105, 2019, "MA"), (110, 2018, "CT"), (110, 2019, "CT"), (110, 2020, "CT"), (108, 2018, "CT"), (109, 2018, "CT"), (109, 2019, "CT")]
    seen = [(101, 2023, "V101", 0.95, 3.0), (102, 2018, "V102", 0.95, 3.0), (103, 2018, "V103", 0.20, 3.0), (104, 2018, "V104a", 0.95, 3.0), (104, 2018, "V104b", 0.95, 3.0)]
    seen += [(105, 2018, "V105", 0.95, 3.0), (106, 2018, "V106", 0.95, 500.0), (107, 2018, "V107", 0.95, None), (108, 2018, "V108", 0.95, 1.0)]
    seen += [(109, 2018, "V109", 0.95, 1.0), (109, 2019, "V109", 0.95, 1.0), (110, 2018, "V110a", 0.95, 1.0), (110, 2018, "V110b", 0.95, 1.0)]
    best = panel.best_per_year(spark.createDataFrame([(n, v, p, True, z, 0.9, 1, y) for n, y, v, p, z in seen], schemas.SCORED))
    leaves = spark.createDataFrame([("CT", y) for y in (2018, 2019, 2020)] + [("MA", 2019), ("MD", 2023)], "state string, year int")
    return best, spark.createDataFrame(universe, "npi long, year int, state string"), leaves


def test_gaps(spark):
    best, universe, leaves = gap_tables(spark)
    found = gaps.classify_gaps(best, universe, leaves)
    assert rows(found, "npi", "year", "fill_tier") == [(101, 2024, 1), (102, 2019, 2), (103, 2019, 3), (104, 2019, 3), (105, 2019, 3), (106, 2019, 3), (107, 2019, 3), (110, 2019, 3), (110, 2020, 3)]
    s = gaps.summarise_gaps(found).first()
    assert (s.n_gaps, s.n_npi_with_gap, s.n_tier_1, s.n_tier_2, s.n_tier_3) == (9, 8, 1, 1, 7)
    assert (s.n_fail_no_anchor, s.n_fail_ambiguous, s.n_fail_moved, s.n_fail_far, s.n_fail_no_zip) == (1, 3, 1, 1, 1)
    filled = gaps.fill_gaps(best, found)
    assert filled.where("filled").count() == 2 and filled.where("not filled").count() == best.count() and filled.where("filled and match_prob is null").count() == 2
    tiers = lambda **k: {r.npi: r.fill_tier for r in gaps.classify_gaps(best, universe, leaves, **k).collect()}
    assert set(tiers(min_fill_prob=0.99).values()) == {3}
    assert tiers(max_fill_zip_dist=1000.0)[106] == 2 and tiers(min_fill_prob=0.1)[103] == 2
    none = gaps.classify_gaps(best, universe, schemas.empty(spark, schemas.SNAPSHOTS))
    assert none.where("fillable and fill_tier != 1").count() == 0


def test_provider_dimension(spark):
    core = [
        (31, 1, "Ann", None, "Quill", "CT", "06510", "MA", "02101"), (32, 1, "Bo", "X", "Fern", "", "06511", "RI", "02901"),
        (33, 1, "Cy", "Y", "Moss", "NY", "10001", "CT", "06510"), (34, 2, "Org", None, "Inc", "NY", "10001", None, None),
    ]
    core = spark.createDataFrame([(*r, 2018) for r in core], CORE)
    taxonomy = spark.createDataFrame([(31, "A"), (32, "A"), (33, "A"), (34, "A")], "npi long, taxonomy_code string")
    nucc = spark.createDataFrame([("A", provider.GROUPING), ("B", "Other")], "code string, grouping string")
    cms = spark.createDataFrame([(33, 1990, "S"), (33, 1990, "S"), (31, 1980, None)], "npi long, grd_yr int, med_sch string")
    out = provider.provider_dimension(core, taxonomy, cms, nucc)
    assert rows(out, "npi", "state", "zip", "addr_source") == [(31, "CT", "06510", "practice"), (32, "RI", "02901", "mailing"), (33, "NY", "10001", "practice")]
    assert provider.provider_dimension(core, taxonomy, cms.union(spark.createDataFrame([(33, 1990, None)], cms.schema)), nucc).where("npi = 33").count() == 0
    c = provider.count_conflicts(spark.createDataFrame([(1, 1, "a"), (1, 1, None), (2, 1, "a"), (3, 1, "a"), (3, 2, "b")], cms.schema)).first()
    assert (c.n_npi, c.n_conflicting, c.n_grd_yr_only, c.n_med_sch_only, c.n_both, c.max_rows_per_npi) == (3, 2, 0, 1, 1, 2)


def test_taxonomy_union(spark, tmp_path):
    paths = []
    for vintage, data in (("2025-12", [(31, 1, "P")]), ("2019-12", [(31, 1, "O"), (33, 1, "P"), (33, 2, "Z")]), ("2023-05", [(34, 1, "P")])):
        path = str(tmp_path / catalogue.TAXONOMY_FILES[vintage].rsplit("/", 1)[1])
        frame = spark.createDataFrame(data, schemas.TAXONOMY)
        frame.write.csv(path, header=True) if path.endswith(".csv") else frame.write.parquet(path)
        paths.append(path)
    want = [(31, "P"), (33, "P"), (34, "P")]
    assert rows(readers.read_taxonomy_union(spark, paths), "npi", "taxonomy_code") == want == rows(readers.read_taxonomy_union(spark, paths[::-1]), "npi", "taxonomy_code")
    assert readers.read_taxonomy_union(spark, [str(tmp_path / "other.parquet")]).count() == 0


def test_snapshots(spark, tmp_path):
    for leaf, ident in (("state=CT/year=2018/month=06/day=01", "stale"), ("state=CT/year=2018/month=11/day=15", "new"), ("state=CT/year=2019/month=6/day=9", "unpadded")):
        spark.createDataFrame([(ident,)], "LALVOTERID string").write.parquet(str(tmp_path / leaf))
    root = str(tmp_path)
    assert snapshots.resolve_snapshot(spark, root, "CT", 2018).endswith("month=11/day=15") and snapshots.resolve_snapshot(spark, root, "NY", 2019) is None
    assert rows(snapshots.read_latest(spark, root), "LALVOTERID") == [("new",), ("unpadded",)]
    path = F.lit("x/state=NY/year=2019/month=6/day=9")
    assert str(one(spark, snapshots.path_date(path))) == "2019-06-09" and one(spark, snapshots.output_subdir(path)) == "year=2019/state=NY"


def test_stage_b_selector(spark):
    people = spark.createDataFrame([(i, 2018, "CT") for i in range(1, 6)], "npi long, year int, state string")
    pairs = spark.createDataFrame([(1, 2018, "CT", 0.99), (2, 2018, "CT", 0.4), (4, 2018, "CT", 0.8), *[(5, 2018, "CT", 0.99)] * 3], "npi long, year int, state string, full_name_sim double")
    assert rows(candidates.unmatched(people, pairs), "npi") == [(2,), (3,), (4,), (5,)]
    assert (4,) not in rows(candidates.unmatched(people, pairs, min_name_sim=0.75), "npi")
    assert candidates.unmatched(people, pairs.limit(0)).count() == 5


def linkage_inputs(spark):
    core = [(101, 1, "Avery", "J", "Quillfeather", "CT", "06510", None, None), (102, 1, "Morgan", None, "Brackenridge", "CT", "06510", None, None), (103, 1, "Robin", "Lee", "Thistlewood", "NY", "10001", None, None)]
    core = spark.createDataFrame([(*r, 2018) for r in core], CORE)
    taxonomy = spark.createDataFrame([(n, "A") for n in (101, 102, 103)], "npi long, taxonomy_code string")
    nucc = spark.createDataFrame([("A", provider.GROUPING)], "code string, grouping string")
    cms = spark.createDataFrame([(101, 1995, "S")], "npi long, grd_yr int, med_sch string")
    voters = [("V1", "Avery", "J", "Quillfeather", "CT", "06510", "Medical-Doctor"), ("V2", "Morgan", None, "Brackenridge", "NY", "10001", None), ("V3", "Robin", "Lee", "Thistlewood", "NY", "10001", "Unknown"), ("V4", "Casey", None, "Umberfield", "CT", "06510", None)]
    voters = spark.createDataFrame([(i, f, m, n, s, z, j, s, 2018, "1970-05-01", "Town") for i, f, m, n, s, z, j in voters], "LALVOTERID string, Voters_FirstName string, Voters_MiddleName string, Voters_LastName string, Residence_Addresses_State string, Residence_Addresses_Zip string, CommercialData_Occupation string, state string, year int, Voters_BirthDate string, Residence_Addresses_City string")
    centroids = spark.createDataFrame([("06510", 41.3053, -72.9276), ("10001", 40.7506, -73.9971)], schemas.CENTROIDS)
    labelled = spark.createDataFrame([(float(i % 7) if i % 3 else None, 25.0 if i % 5 else None, 0.95 if i % 2 else 0.4, bool(i % 2), 0.9 if i % 2 else None, 1, "Medical-Doctor" if i % 4 else None, float(i % 2)) for i in range(120)], "zip_dist double, year_dist double, full_name_sim double, mid_initial_agree boolean, mid_name_agree double, n int, CommercialData_Occupation string, match double")
    return core, taxonomy, cms, nucc, voters, centroids, labelled


def test_whole_linkage(spark):
    from linkwright.plans.linkage import link

    out = link(spark, *linkage_inputs(spark), config.LinkageConfig(years=[2018], states=["CT", "NY"], trees=20), keep=lambda name, f: f.persist())
    assert rows(out["lsh_pairs"], "npi", "LALVOTERID") == [(101, "V1"), (103, "V3")]
    assert rows(out["cross_border_pairs"], "npi", "LALVOTERID", "state_agree") == [(102, "V2", False)]
    assert sorted(out["lsh_pairs"].columns) == sorted(out["cross_border_pairs"].columns)
    scored_rows = out["scored_pairs"].select("npi", "match_prob", "n").collect()
    assert len(scored_rows) == 3 and all(0 <= r.match_prob <= 1 and r.n == 1 for r in scored_rows)
    assert out["cross_border_pairs"].first()["zip_dist"] == pytest.approx(67.649, abs=1e-3)
    assert {r.npi: r.best_cross_border for r in out["physician_matches"].collect()} == {101: False, 102: True, 103: False}
    assert len(scoring.PREDICTORS) == 8 and "state_agree" not in scoring.PREDICTORS


def source_files(spark, folder):
    """The linkage's inputs as files: CSV and Parquet sources, labelled pairs in two files, a stale snapshot beside the newest."""
    core, taxonomy, cms, nucc, voters, centroids, labelled = linkage_inputs(spark)
    at = lambda name: str(folder / name)
    text = core.drop("year")
    text.coalesce(1).write.csv(at("core201812.csv"), header=True)
    text.where("npi != 103").withColumn("extra", F.lit(1)).write.parquet(at("core_201912.parquet"))
    newest = catalogue.TAXONOMY_FILES["2025-12"].rsplit("/", 1)[1]
    taxonomy.select("npi", F.lit(1).alias("seq"), F.col("taxonomy_code").alias("ptaxcode")).write.parquet(at(newest))
    cms.select(F.col("npi").alias("NPI"), "grd_yr", "med_sch", F.lit("x").alias("Other Column")).coalesce(1).write.csv(at("cms.csv"), header=True)
    nucc.select(F.col("code").alias("Code"), F.col("grouping").alias("Grouping"), F.lit("s").alias("Display Name")).coalesce(1).write.csv(at("nucc.csv"), header=True)
    repeated = centroids.unionByName(spark.createDataFrame([("06510", 0.0, 0.0)], schemas.CENTROIDS))
    repeated.coalesce(1).write.csv(at("centroids.csv"), header=True)
    for year in (2018, 2019):
        for r in voters.select("state").distinct().collect():
            part = voters.where(F.col("state") == r.state).drop("state", "year")
            if year == 2019:
                part = part.withColumnRenamed("CommercialData_Occupation", "ConsumerData_Occupation_of_Person")
            part.write.parquet(at(f"voters/state={r.state}/year={year}/month=06/day=01"))
            part.withColumn("LALVOTERID", F.lit("stale")).write.parquet(at(f"voters/state={r.state}/year={year}/month=5/day=30"))
    labelled.where("match = 0").write.parquet(at("labels/one.parquet"))
    labelled.where("match = 1").drop("mid_name_agree").write.parquet(at("labels/two.parquet"))
    from linkwright.plans.build import Inputs

    return Inputs({2018: at("core201812.csv"), 2019: at("core_201912.parquet")}, [at(newest)], at("cms.csv"), at("nucc.csv"), at("centroids.csv"), at("voters"), [at("labels/one.parquet"), at("labels/two.parquet")])


def test_build_from_files_to_files(spark, tmp_path):
    from linkwright.plans import build

    inputs, out = source_files(spark, tmp_path), str(tmp_path / "out")
    cfg = config.LinkageConfig(years=[2018, 2019], states=["CT", "NY"], trees=20, min_fill_prob=0.0)
    tables = build.build(spark, inputs, out, cfg)
    physicians = spark.read.parquet(f"{out}/physician_data")
    assert rows(physicians, "npi", "year", "zip") == [(101, 2018, "06510"), (101, 2019, "06510"), (102, 2018, "06510"), (102, 2019, "06510"), (103, 2018, "10001")]
    assert {"display_name", "grd_yr", "med_sch", "addr_source"} <= set(physicians.columns)
    assert rows(spark.read.parquet(f"{out}/lsh_pairs"), "npi", "LALVOTERID", "year", "state") == [(101, "V1", 2018, "CT"), (101, "V1", 2019, "CT"), (103, "V3", 2018, "NY")]
    assert rows(spark.read.parquet(f"{out}/cross_border_pairs"), "npi", "LALVOTERID", "year", "state") == [(102, "V2", 2018, "CT"), (102, "V2", 2019, "CT")]
    assert {"phys_mid_name_len", "voters_mid_name_len", "full_name.x", "full_name.y", "year_dist", "zip_dist"} <= set(tables["lsh_pairs"].columns)
    assert tables["cross_border_pairs"].first()["zip_dist"] == pytest.approx(67.649, abs=1e-3)  # the first centroid of a repeated code
    assert spark.read.parquet(f"{out}/scored_pairs").count() == 5 and spark.read.parquet(f"{out}/physician_matches").count() == 3
    assert rows(spark.read.parquet(f"{out}/panel_gap_summary"), "n_gaps") == [(0,)]
    assert (tmp_path / "out/physician_data/year=2018/state=CT").is_dir()
    # a rerun of one year replaces its partitions and leaves the other year's
    changed = tables["physician_data"].where("year = 2018 and state = 'CT'").withColumn("zip", F.lit("00000")).collect()
    again = build.written(out)("physician_data", spark.createDataFrame(changed, tables["physician_data"].schema))
    assert rows(again, "npi", "year", "zip") == [(101, 2018, "00000"), (101, 2019, "06510"), (102, 2018, "00000"), (102, 2019, "06510"), (103, 2018, "10001")]
    with pytest.raises(checks.NotUnique):
        build.written(out)("physician_matches", spark.createDataFrame([(1,), (1,)], "npi long"))


def test_readers(spark, tmp_path):
    (tmp_path / "core.csv").write_text("pmailzip,npi,entity,pfname,pmname,plname,plocstatename,ploczip,pmailstatename,more\n00501,12,1,Ann,,Quill,CT,06510,NY,x\n,x,2,,,,,,,\n")
    got = readers.read_provider_core(spark, str(tmp_path / "core.csv"))
    assert got.schema == schemas.PROVIDER_CORE and [(r.npi, r.ploczip, r.pmailzip, r.pmname) for r in got.orderBy("npi").collect()] == [(None, None, None, None), (12, "06510", "00501", None)]
    got.write.parquet(str(tmp_path / "core.parquet"))
    assert readers.read_provider_core(spark, str(tmp_path / "core.parquet")).schema == schemas.PROVIDER_CORE
    (tmp_path / "c.csv").write_text("zcta5,intptlat,intptlong\n00501,40.8,-73.0\n00501,1.0,2.0\n06510,41.3,-72.9\n")
    assert rows(readers.read_centroids(spark, str(tmp_path / "c.csv")), "zcta5", "intptlat") == [("00501", 40.8), ("06510", 41.3)]
    (tmp_path / "n.csv").write_text("Code,Display Name,NPI\n0A,b,7\n")
    assert readers.read_csv(spark, str(tmp_path / "n.csv"), headers="snake").columns == ["code", "display_name", "npi"]
    (tmp_path / "a.csv").write_text("NPI,grd_yr,med_sch,Zip\n7,1990,S,00501\n8,old,,\n")
    assert [tuple(r) for r in readers.read_attributes(spark, str(tmp_path / "a.csv")).orderBy("npi").collect()] == [(7, 1990, "S"), (8, None, None)]
    frame = spark.createDataFrame([(1, 2018, "a"), (2, 2019, "b")], "id int, year int, x string")
    path = str(tmp_path / "set")
    readers.write_dataset(frame, path, ("year",))
    out = readers.write_dataset(spark.createDataFrame([(3, 2019, "c")], frame.schema), path, ("year",))
    assert rows(out, "id", "year", "x") == [(1, 2018, "a"), (3, 2019, "c")]
    assert rows(readers.write_dataset(frame, str(tmp_path / "plain")), "id") == [(1,), (2,)] == rows(readers.write_dataset(frame, str(tmp_path / "plain")), "id")
    readers.write_single(frame, str(tmp_path / "one"))
    assert len(list((tmp_path / "one").glob("part-*"))) == 1
    more = frame.withColumn("extra", F.lit(1))
    more.write.parquet(str(tmp_path / "more"))
    both = readers.read_parquet(spark, str(tmp_path / "plain"), str(tmp_path / "more"))
    assert both.count() == 4 and "extra" in both.columns and readers.read_parquet(spark, str(tmp_path / "more"), columns=frame.schema).columns == frame.columns


def test_fetch_over_http(tmp_path):
    import functools
    import http.server
    import threading

    site = tmp_path / "site"
    site.mkdir()
    (site / "full.csv").write_text("npi\n1\n")
    (site / "empty.csv").write_text("")
    handler = functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(site))
    handler.log_message = lambda *a: None
    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        url, to = f"http://127.0.0.1:{server.server_address[1]}", tmp_path / "to"
        assert open(catalogue.fetch(f"{url}/full.csv", str(to))).read() == "npi\n1\n"
        (site / "full.csv").write_text("changed")
        assert open(catalogue.fetch(f"{url}/full.csv", str(to))).read() == "npi\n1\n"  # what is there is left alone
        with pytest.raises(OSError):
            catalogue.fetch(f"{url}/empty.csv", str(to))
        with pytest.raises(OSError):
            catalogue.fetch(f"{url}/none.csv", str(to))
        assert [p.name for p in to.iterdir() if not p.name.endswith(".part")] == ["full.csv"]
        server.shutdown()


def test_ngrams_of_any_letters(spark):
    for t in ("", "a", "ab", "aé😀b", "aaaa", "x" * 5000 + "y", None, " a b "):
        for k in (1, 2, 3):
            got = one(spark, text.ngrams(F.lit(t).cast("string"), k))
            assert (got if t is None else sorted(got)) == (None if t is None else sorted({t[i : i + k] for i in range(len(t) - k + 1)}))


def test_scope_catalogue_and_fetch(monkeypatch, tmp_path):
    assert config.scoped_years() == list(range(2018, 2026)) and len(config.scoped_states()) == 51
    monkeypatch.setenv(config.YEARS_VARIABLE, "2018, 2019")
    monkeypatch.setenv(config.STATES_VARIABLE, " ct , ny ")
    assert config.scoped_years() == [2018, 2019] and config.scoped_states() == ["CT", "NY"]
    assert len({f.year for f in catalogue.CORE_FILES}) == 8 and {f.year for f in catalogue.CORE_FILES if f.format == "csv"} == {2018, 2023}
    with pytest.raises(LookupError):
        catalogue.core_file(1999)
    there = tmp_path / catalogue.core_file(2018).url.rsplit("/", 1)[1]
    there.write_text("x")
    assert catalogue.fetch_core(2018, str(tmp_path)) == str(there) and there.read_text() == "x" and len(list(tmp_path.iterdir())) == 1
    assert len(set(schemas.VOTER_COLUMNS)) == 30


def test_kappa_and_samples(spark):
    data = [(1, 1)] * 20 + [(1, 0)] * 5 + [(0, 1)] * 10 + [(0, 0)] * 15
    k = sampling.coder_agreement(spark.createDataFrame(data, "a int, b int"), "a", "b").first()
    assert k.n == 50 and k.agreement == pytest.approx(0.7) and k.kappa == pytest.approx(0.4)
    coder = lambda m: spark.createDataFrame(m, "observation int, match int, note string")
    both = sampling.joined_labels(coder([(1, 1, ""), (2, 0, ""), (3, 1, "")]), coder([(2, 0, ""), (3, 0, ""), (4, 1, "")]))
    assert rows(both, "observation", "match.x", "match.y") == [(2, 0, 0), (3, 1, 0)] and sampling.coder_agreement(both, "match.x", "match.y").first().agreement == 0.5
    pairs = spark.range(3000).withColumn("year_dist", F.col("id") % 50)
    parts = sampling.training_samples(pairs, "id")
    assert {k: v.count() for k, v in parts.items()} == {"rough": 1500, "part_1": 350, "part_2": 800, "part_3": 350, "positives": 0, "negatives": 600}


def test_queries_match_their_sql(spark):
    import duckdb

    from linkwright.plans import oracles, queries, stages

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    every = queries.QUERIES | stages.QUERIES
    assert set(every) - set(oracles.SQL) == {"rf_score_pairs"} and set(oracles.SQL) <= set(every)
    for t in "region nation customer supplier part orders lineitem events documents pages labels".split():
        db.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    number = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    for name, sql in oracles.SQL.items():
        got = every[name](spark, sf)
        names = sorted(got.columns)
        have = sorted(str(tuple(number(r[c]) for c in names)) for r in got.collect())
        want = sorted(str(tuple(map(number, r))) for r in db.sql(f"select {', '.join(names)} from ({sql})").fetchall())
        assert have == want, name


def test_forest_scores_every_row(spark):
    from linkwright.plans import queries

    sf = "/root/testdata/sf0.001"
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    sizes = {r.l_orderkey: r["count"] for r in line.groupBy("l_orderkey").count().collect()}
    got = queries.rf_score_pairs(spark, sf, training_rows=500, trees=3).collect()
    assert sorted((r.l_orderkey, r.l_linenumber) for r in got) == rows(line, "l_orderkey", "l_linenumber")
    assert all(r.n == sizes[r.l_orderkey] and 0 <= r.match_prob <= 1 for r in got) and max(r.n for r in got) > 3
