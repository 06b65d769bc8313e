"""Joins of many equal, similar and odd names."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from linkwright.operators import candidates
from linkwright.operators.simjoin import similarity_join


def people(spark, copies=4):
    names = ["anna maria smith", "anna mario smith", "john kowalsky", "john kowalski", "peter q jones"]
    data = [(i, names[i // copies % len(names)], "CT" if i < 30 else "NY") for i in range(copies * len(names) * 3)]
    frame = spark.createDataFrame(data, "id long, name string, state string").withColumn("year", F.lit(2018))
    first, last = F.split_part("name", F.lit(" "), F.lit(1)), F.split_part("name", F.lit(" "), F.lit(-1))
    left = frame.select(F.col("id").alias("npi"), first.alias("provider_first_name"), F.lit(None).cast("string").alias("provider_middle_name"), last.alias("provider_last_name"), "state", "year", F.lit("00003").alias("zip"), F.lit(1990).alias("grd_yr"))
    right = frame.select(F.concat(F.lit("V"), F.col("id")).alias("LALVOTERID"), first.alias("Voters_FirstName"), F.lit("").alias("Voters_MiddleName"), last.alias("Voters_LastName"), F.col("state").alias("Residence_Addresses_State"), F.lit("00003").alias("Residence_Addresses_Zip"), F.lit("x").alias("Residence_Addresses_City"), F.lit("1960-01-01").alias("Voters_BirthDate"), F.lit(None).cast("string").alias(candidates.OCCUPATION), "state", "year")
    centroids = spark.createDataFrame([("00003", 40.0, -70.0)], "zcta5 string, intptlat double, intptlong double")
    return candidates.prepare_providers(left), candidates.prepare_voters(right), centroids


def test_equal_names_of_a_block_are_compared_once(spark, monkeypatch):
    left, right, centroids = people(spark)
    joined = []
    monkeypatch.setattr(candidates, "similarity_join", lambda a, b, *more, **options: joined.append((a.count(), b.count())) or similarity_join(a, b, *more, **options))
    pairs = candidates.match_pairs(left, right, centroids)
    names = left.select("full_name", "state").distinct().count()
    assert joined == [(names, names)] * 2
    grams = lambda s: {s[i : i + 3] for i in range(len(s) - 2)}
    alike = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    a, b = left.collect(), right.collect()
    want = {(x.npi, y.LALVOTERID): alike(x.full_name, y.full_name) for x in a for y in b if x.state == y.state and max(alike(x.full_name, y.full_name), alike(x.full_name_no_mid, y.full_name_no_mid_l2)) >= 0.7}
    got = pairs.collect()
    assert len(got) == len(want) and {(r.npi, r.LALVOTERID): r.full_name_sim for r in got} == pytest.approx(want)


def test_stage_b_holds_stage_a_no_more(spark):
    left, right, centroids = people(spark)
    marked = candidates.match_pairs(left, right, centroids).where("full_name_sim > -0.123454321")
    adjacency = spark.createDataFrame([("CT", "NY")], "state_a string, state_b string")
    pairs = candidates.cross_border(left, right, marked, adjacency, centroids, right.select("year", "state").distinct())
    assert "0.123454321" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    a, b, found = left.collect(), right.collect(), {(r.npi, r.LALVOTERID) for r in pairs.collect()}
    strong = {x.npi for x in a if sum(x.full_name == y.full_name and x.state == y.state for y in b) == 1}
    assert not strong and {(x.npi, y.LALVOTERID) for x in a for y in b if x.state != y.state and x.full_name == y.full_name} <= found
    assert not {(x.npi, y.LALVOTERID) for x in a for y in b if x.state == y.state} & found


def test_similarity_join_of_copies_in_chunks_and_parts(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abç😀") for _ in range(rng.randint(2, 9))) for _ in range(14)]
    data = [(i, rng.choice(base)) for i in range(90)]
    frame = spark.createDataFrame(data, "id long, name string").repartition(1)
    other = frame.withColumn("key", F.concat(F.lit("k"), F.col("id")))
    grams = {i: {n[j : j + 4] for j in range(len(n) - 3)} for i, n in data}
    want = {(i, j): len(grams[i] & grams[j]) / len(grams[i] | grams[j]) for i in grams for j in grams if grams[i] & grams[j]}
    want = {p: s for p, s in want.items() if s >= 0.5}
    got = similarity_join(frame, frame, "id", "id", "name", k=4, threshold=0.5, ascending=True, chunk=2, part=3).collect()
    assert len(got) == len({(r.left_id, r.right_id) for r in got}) and {(r.left_id, r.right_id): r.sim for r in got} == {(i, j): s for (i, j), s in want.items() if i < j}
    got = similarity_join(frame, other, "id", "key", "name", k=4, threshold=0.5, chunk=2, part=3).collect()
    assert len(got) == len(want) and {(r.left_id, int(r.right_id[1:])): r.sim for r in got} == want


def test_retry_holds_its_first_join_no_more(spark):
    from linkwright.plans import queries

    calls = []
    kept, queries.durable = queries.durable, lambda frame: calls.append(1) or kept(frame)
    try:
        queries.cross_block_retry(spark, "/root/testdata/sf0.001")
    finally:
        queries.durable = kept
    assert calls == [1]


def test_pairs_hold_the_joins_of_their_names_no_more(spark):
    left, right, centroids = people(spark)
    plan = lambda f: f._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan(candidates.match_pairs(left, right, centroids))
    met = plan(similarity_join(left, right, "npi", "LALVOTERID", "full_name", "full_name", blocks=["state"]))
    assert met.count("Generate explode") <= 3 and "count(1) AS df" not in met


def test_rows_that_meet_too_late_in_their_prefixes_are_not_compared(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from linkwright.operators import simjoin

    common = [f"~{i:02}" for i in range(15)]
    sets = [[f"{i:02x}{j}" for j in range(5)] + common for i in range(200)]  # 15 of 25 grams are shared, 17 of 23 would be needed
    rows = [{"gram": common[0], "p": 0, "q": 0, "left": True, "diagonal": True, "s": "".join(sorted(x)), "prefix": "".join(x[:7]), "lids": [{"id": i}], "rids": None} for i, x in enumerate(sets)]
    counted, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: counted.append(x.size) or count(x))
    schema = pa.schema([("gram", pa.string()), ("p", pa.int32()), ("q", pa.int32()), ("left", pa.bool_()), ("diagonal", pa.bool_()), ("s", pa.string()), ("prefix", pa.string()), ("lids", pa.list_(pa.struct([("id", pa.int64())]))), ("rids", pa.list_(pa.struct([("id", pa.int64())])))])
    found = simjoin._compared(["gram", "p", "q"], 3, 0.7, True, True)(iter(pa.Table.from_pylist(rows, schema).to_batches()))
    assert sum(b.num_rows for b in found) == 0 and sum(counted) == 0


@pytest.mark.parametrize("spread", [1, 12])
def test_similarity_join_of_many_rows_that_meet(spark, spread):
    rng = random.Random(3)
    hosts = ["http://one.example.net/en/", "http://one.example.net/fr/", "http://two.example.org/en/"]
    data = [(i, rng.choice(hosts) + str(rng.randrange(10**4, 10**5)) + "x?page=123456"[: rng.randrange(spread) + 1]) for i in range(1_200)]
    frame = spark.createDataFrame(data, "id long, name string")
    grams = [{n[j : j + 3] for j in range(len(n) - 2)} for _, n in data]
    want = {(i, j): s for i in range(1_200) for j in range(i + 1, 1_200) if (s := len(grams[i] & grams[j]) / len(grams[i] | grams[j])) >= 0.7}
    got = similarity_join(frame, frame, "id", "id", "name", ascending=True).collect()
    assert len(got) == len(want) and {(r.left_id, r.right_id): r.sim for r in got} == want
    odd = similarity_join(frame.where("id % 3 = 0"), frame.where("id % 3 > 0"), "id", "id", "name", part=90).collect()
    want = {(*p, s) if p[0] % 3 == 0 else (*p[::-1], s) for p, s in want.items() if (p[0] % 3 == 0) != (p[1] % 3 == 0)}
    assert len(odd) == len(want) and {(r.left_id, r.right_id, r.sim) for r in odd} == want
