"""SQL that gives the same rows as the queries, over the same tables."""

from __future__ import annotations

from ..functions.geo import EARTH_MILES, STATES
from ..sources.catalogue import CORE_FILES, TAXONOMY_FILES
from .proxies import YEARS
from .queries import ADJACENCY_VALUES

_YEARS = ", ".join(map(str, YEARS))


_PAIRS = """
pairs0 AS (
  SELECT o_custkey AS npi, CAST(year(o_orderdate) AS INT) AS year, l_suppkey AS voter, max(round(1 - l_discount - l_tax, 2)) AS match_prob, min(l_quantity) AS zip_dist, max(l_tax) AS full_name_sim
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
), pairs AS (
  SELECT npi, year, lpad(CAST(voter AS VARCHAR), 9, '0') AS LALVOTERID, match_prob, c_nationkey = s_nationkey AS state_agree, zip_dist, full_name_sim,
    count(*) OVER (PARTITION BY npi, year) AS n
  FROM pairs0 JOIN customer ON c_custkey = npi JOIN supplier ON s_suppkey = voter
), panel AS (
  SELECT npi, year, LALVOTERID, match_prob, state_agree, zip_dist, full_name_sim, n, count(*) OVER (PARTITION BY npi, year) > 1 AS tied
  FROM (SELECT *, max(match_prob) OVER (PARTITION BY npi, year) AS m FROM pairs) WHERE match_prob = m
)"""


_GAPS = f"""
WITH {_PAIRS}, universe AS (
  SELECT c_custkey AS npi, y AS year, CAST(CASE WHEN (c_custkey + y) % 20 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AS VARCHAR) AS state
  FROM customer, (SELECT unnest([{_YEARS}]) AS y)
), present AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS state, y AS year FROM nation, (SELECT unnest([{_YEARS}]) AS y) WHERE (n_nationkey * 7 + y) % 11 <> 0
), anchors AS (
  SELECT p.*, u.state AS anchor_state FROM panel p LEFT JOIN universe u USING (npi, year) WHERE match_prob >= 0.99
), best AS (
  SELECT npi, LALVOTERID AS fill_LALVOTERID, match_prob AS anchor_match_prob, zip_dist AS anchor_zip_dist, year AS anchor_year FROM anchors
  QUALIFY row_number() OVER (PARTITION BY npi ORDER BY match_prob DESC, LALVOTERID, year) = 1
), support AS (
  SELECT npi, count(DISTINCT year) AS n_anchor_years, count(DISTINCT LALVOTERID) AS n_anchor_voters,
    count(DISTINCT anchor_state) + CAST(bool_or(anchor_state IS NULL) AS INT) AS n_anchor_states, min(anchor_state) AS anchor_state FROM anchors GROUP BY npi
), g AS (
  SELECT u.npi, u.year, u.state, n_anchor_years, n_anchor_voters, n_anchor_states, anchor_state, fill_LALVOTERID, anchor_match_prob, anchor_zip_dist, anchor_year,
    x.state IS NOT NULL AS l2_present, fill_LALVOTERID IS NOT NULL AS has_anchor, coalesce(n_anchor_voters = 1, false) AS unambiguous,
    coalesce(n_anchor_states = 1 AND anchor_state = u.state, false) AS state_stable, coalesce(anchor_zip_dist <= 25, false) AS near
  FROM universe u LEFT JOIN support USING (npi) LEFT JOIN best USING (npi) LEFT JOIN present x ON x.state = u.state AND x.year = u.year
  WHERE NOT EXISTS (SELECT 1 FROM panel p WHERE p.npi = u.npi AND p.year = u.year)
), gaps AS (
  SELECT *, unambiguous AND state_stable AND near AS fillable,
    CAST(CASE WHEN unambiguous AND state_stable AND near THEN CASE WHEN l2_present THEN 2 ELSE 1 END ELSE 3 END AS INT) AS fill_tier FROM g
)
"""

_NAMES = """
words AS (
  SELECT page_id, lower(url) AS name, split_part(lower(url), '/', 4) AS language FROM pages
), names AS (
  SELECT page_id, split_part(name, ':', 1) AS kind, name, regexp_replace(name, '[?#].*', '') AS short, CASE WHEN page_id % 5 < 2 THEN left(language, 1) ELSE language END AS mid, left(language, 1) AS mi,
    CAST((page_id // 12) % 4 AS VARCHAR) AS block, (page_id // 6) % 3 = 0 AS is_left FROM words
)"""


def _grams(column: str, k: int) -> str:
    return f"CASE WHEN len({column}) >= {k} THEN list_distinct(list_transform(range(1, len({column}) - {k} + 2), lambda i: substring({column}, i, {k}))) ELSE [] END"


def _jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) > 0 THEN round(len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))), 9) END"


def _neighbours(k: int) -> str:
    return f"""
WITH docs AS (SELECT doc_id, lower(text) AS name FROM documents), g AS (SELECT doc_id, {_grams("name", k)} AS g FROM docs),
s AS (SELECT a.doc_id, a.g AS x, b.g AS y FROM g a JOIN g b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, {_jaccard("x", "y")} AS sim FROM s
"""


def _similar(left: str, right: str, name: str, on: str) -> str:
    """Pairs with Jaccard >= 0.7 by counting shared grams."""
    return f"""
      SELECT l.page_id AS left_id, r.page_id AS right_id, count(*) / (any_value(l.n) + any_value(r.n) - count(*)) AS sim
      FROM (SELECT *, len(g) AS n, unnest(g) AS t FROM (SELECT *, {_grams(name, 3)} AS g FROM {left})) l
      JOIN (SELECT *, len(g) AS n, unnest(g) AS t FROM (SELECT *, {_grams(name, 3)} AS g FROM {right})) r ON l.t = r.t AND {on}
      GROUP BY l.page_id, r.page_id HAVING count(*) / (any_value(l.n) + any_value(r.n) - count(*)) >= 0.7
    """


_SIDES = f"""
WITH {_NAMES}, lefts AS (SELECT * FROM names WHERE is_left), rights AS (SELECT * FROM names WHERE NOT is_left)
"""
_MILES = f"2 * {EARTH_MILES!r} * asin(sqrt(least(1.0, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2))))"
_POINTS = "points AS (SELECT n_nationkey, 25 + n_nationkey * 0.9::DOUBLE AS lat, -120 + n_nationkey * 2.1::DOUBLE AS lon FROM nation)"
_ATTRIBUTES = """SELECT o_custkey AS npi, CAST(1960 + o_custkey % 40 + CASE WHEN CAST(floor(o_totalprice) AS BIGINT) % 25 = 0 THEN 1 ELSE 0 END AS INT) AS grd_yr,
  CASE WHEN o_custkey % 11 <> 0 THEN CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN 'other' ELSE 'school ' || CAST(o_custkey % 7 AS VARCHAR) END END AS med_sch FROM orders"""

SQL = {
    "panel_best_per_year": f"WITH {_PAIRS} SELECT * FROM panel",
    "reconcile_best_match": f"""
WITH {_PAIRS}, b AS (
  SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY npi ORDER BY match_prob DESC, LALVOTERID, year) = 1
), c AS (
  SELECT npi, count(DISTINCT year) AS n_years_matched, count(DISTINCT LALVOTERID) AS n_distinct_voters, bool_or(tied) AS any_tied_in_year, max(match_prob) AS m FROM panel GROUP BY npi
), t AS (
  SELECT p.npi, count(DISTINCT LALVOTERID) AS k FROM panel p JOIN c ON c.npi = p.npi AND p.match_prob = c.m GROUP BY p.npi
)
SELECT npi, LALVOTERID AS best_LALVOTERID, match_prob AS best_match_prob, year AS best_year, n_years_matched, n_distinct_voters, n_distinct_voters > 1 AS mover, any_tied_in_year,
  k > 1 AS best_is_tied, NOT state_agree AS best_cross_border
FROM b JOIN c USING (npi) JOIN t USING (npi)
""",
    "gap_classify": _GAPS + "SELECT * FROM gaps",
    "gap_fill_panel": _GAPS
    + """
SELECT *, false AS filled, CAST(NULL AS INT) AS fill_tier FROM panel
UNION ALL BY NAME
SELECT npi, year, fill_LALVOTERID AS LALVOTERID, true AS filled, fill_tier FROM gaps WHERE fill_tier < 3
""",
    "gap_summary": _GAPS
    + """
SELECT count(*) AS n_gaps, count(DISTINCT npi) AS n_npi_with_gap, CAST(count_if(fill_tier = 1) AS BIGINT) AS n_tier_1, CAST(count_if(fill_tier = 2) AS BIGINT) AS n_tier_2, CAST(count_if(fill_tier = 3) AS BIGINT) AS n_tier_3,
  CAST(count_if(fill_tier = 3 AND NOT has_anchor) AS BIGINT) AS n_fail_no_anchor, CAST(count_if(fill_tier = 3 AND has_anchor AND NOT unambiguous) AS BIGINT) AS n_fail_ambiguous,
  CAST(count_if(fill_tier = 3 AND has_anchor AND NOT state_stable) AS BIGINT) AS n_fail_moved, CAST(count_if(fill_tier = 3 AND has_anchor AND anchor_zip_dist > 25) AS BIGINT) AS n_fail_far,
  CAST(count_if(fill_tier = 3 AND has_anchor AND anchor_zip_dist IS NULL) AS BIGINT) AS n_fail_no_zip, CAST(count_if(fill_tier = 3 AND NOT l2_present) AS BIGINT) AS n_no_l2_unfilled FROM gaps
""",
    "cms_conflicts": f"""
WITH e AS (SELECT npi, count(*) AS n, count(DISTINCT grd_yr) AS f, count(DISTINCT med_sch) + CAST(bool_or(med_sch IS NULL) AS INT) AS s FROM (SELECT DISTINCT * FROM ({_ATTRIBUTES})) GROUP BY npi)
SELECT count(*) AS n_npi, CAST(count_if(n > 1) AS BIGINT) AS n_conflicting, CAST(count_if(n > 1) AS BIGINT) / count(*) AS pct_conflicting, max(n) AS max_rows_per_npi, CAST(count_if(f > 1 AND s = 1) AS BIGINT) AS n_grd_yr_only,
  CAST(count_if(f = 1 AND s > 1) AS BIGINT) AS n_med_sch_only, CAST(count_if(f > 1 AND s > 1) AS BIGINT) AS n_both FROM e
""",
    "provider_dim": f"""
WITH a AS (SELECT DISTINCT * FROM ({_ATTRIBUTES})), bad AS (SELECT npi FROM a GROUP BY npi HAVING count(*) > 1)
SELECT c_custkey AS npi, c_name AS provider_first_name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS provider_middle_name, c_mktsegment AS provider_last_name,
  CASE WHEN c_custkey % 7 = 0 THEN 'MAIL' ELSE n_name END AS state, CASE WHEN c_custkey % 7 = 0 THEN '00501' ELSE lpad(CAST(c_custkey % 1000 AS VARCHAR), 5, '0') END AS zip,
  CASE WHEN c_custkey % 7 = 0 THEN 'mailing' ELSE 'practice' END AS addr_source, CAST(n_regionkey AS VARCHAR) AS taxonomy_code, 'Allopathic & Osteopathic Physicians' AS grouping,
  r_name AS classification, a.grd_yr, a.med_sch
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN a ON a.npi = c_custkey
WHERE c_custkey % 5 <> 0 AND r_regionkey < 3 AND c_custkey NOT IN (SELECT npi FROM bad)
""",
    "taxonomy_newest_wins": """
SELECT o_custkey AS npi, o_orderpriority AS taxonomy_code, CAST(year(o_orderdate) AS INT) AS vintage FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) DESC, o_orderpriority) = 1
""",
    "latest_snapshot": """
WITH e AS (SELECT event_id, event_type, CAST(weekofyear(ts) AS INT) AS week, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events)
SELECT * FROM e WHERE day = (SELECT max(day) FROM e x WHERE x.event_type = e.event_type AND x.week = e.week)
""",
    "path_key_parse": """
SELECT event_id, upper(left(event_type, 2)) AS state, CAST(year(ts) AS INT) AS year, CAST(CAST(ts AS DATE) AS VARCHAR) AS extract_date FROM events
""",
    "schema_drift_coalesce": """
WITH o AS (SELECT o_orderkey, CASE WHEN year(o_orderdate) <= 1997 THEN o_orderpriority ELSE o_orderstatus END AS occupation FROM orders)
SELECT o_orderkey, occupation, contains(lower(occupation), 'urgent') AS medical, coalesce(occupation = 'F', true) AS unknown FROM o
""",
    "stage_b_selector": _GAPS
    + """
SELECT u.npi, u.year, u.state FROM universe u LEFT JOIN (SELECT npi, year, count(*) AS k FROM pairs WHERE match_prob >= 0.99 GROUP BY ALL) s USING (npi, year) WHERE coalesce(k, 0) <> 1
""",
    "ngram_jaccard_pairs": _neighbours(3),
    "ngram_jaccard_k2": _neighbours(2),
    "simjoin_unblocked": f"WITH {_NAMES} SELECT left_id, right_id, round(sim, 9) AS sim FROM ({_similar('names', 'names', 'name', 'l.page_id < r.page_id')})",
    "simjoin_blocked": f"WITH {_NAMES} SELECT left_id, right_id, round(sim, 9) AS sim FROM ({_similar('names', 'names', 'name', 'l.page_id < r.page_id AND l.kind = r.kind')})",
    "candidate_union_features": _SIDES
    + f""", whole AS ({_similar("lefts", "rights", "name", "l.kind = r.kind AND l.block = r.block")}),
short AS ({_similar("lefts", "rights", "short", "l.kind = r.kind AND l.block = r.block AND l.mi = r.mi")}),
ids AS (
  SELECT left_id, right_id FROM whole
  UNION
  SELECT left_id, right_id FROM short JOIN lefts a ON a.page_id = left_id JOIN rights b ON b.page_id = right_id WHERE len(a.mid) <= 1 OR len(b.mid) <= 1
), s AS (
  SELECT left_id, right_id, {_grams("a.name", 3)} AS x, {_grams("b.name", 3)} AS y, {_grams("a.mid", 2)} AS u, {_grams("b.mid", 2)} AS v, a.mi = b.mi AS mid_initial_agree
  FROM ids JOIN lefts a ON a.page_id = left_id JOIN rights b ON b.page_id = right_id
)
SELECT left_id, right_id, {_jaccard("x", "y")} AS full_name_sim, {_jaccard("u", "v")} AS mid_name_agree, mid_initial_agree FROM s
""",
    "cross_block_retry": _SIDES
    + f""", own AS ({_similar("lefts", "rights", "name", "l.kind = r.kind AND l.block = r.block")}),
sure AS (SELECT left_id FROM own WHERE sim >= 0.85 GROUP BY left_id HAVING count(*) = 1),
rest AS (SELECT * FROM lefts WHERE page_id NOT IN (SELECT left_id FROM sure) AND block IN (SELECT block FROM rights)),
found AS ({_similar("rest", "rights", "name", "l.kind = r.kind AND (CAST(l.block AS INT) - CAST(r.block AS INT) + 4) % 4 IN (1, 3)")})
SELECT left_id, b.block AS nb_block, right_id, round(sim, 9) AS sim FROM found JOIN rights b ON b.page_id = right_id
""",
    "state_adjacency_closure": f"WITH p(a, b) AS (VALUES {ADJACENCY_VALUES}) SELECT a AS state, b AS neighbour FROM p UNION SELECT b, a FROM p",
    "haversine_nation_pairs": f"WITH {_POINTS} SELECT a.n_nationkey AS k1, b.n_nationkey AS k2, round({_MILES}, 6) AS miles FROM points a JOIN points b ON a.n_nationkey < b.n_nationkey",
    "zip_prefix_lookup": f"""
WITH {_POINTS} SELECT c_custkey, CASE WHEN a.lat IS NOT NULL AND b.lat IS NOT NULL THEN round({_MILES}, 6) END AS zip_dist FROM customer
LEFT JOIN points a ON a.n_nationkey * 3 = c_custkey % 60 LEFT JOIN points b ON b.n_nationkey * 3 = (c_nationkey * 3) % 60
""",
    "candidate_count_n": f"WITH {_PAIRS} SELECT npi, year, LALVOTERID, n FROM pairs",
    "feature_matrix": """
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS zip_dist, CASE WHEN l_linenumber <> 2 THEN CAST(year(l_shipdate) - 1960 AS DOUBLE) END AS year_dist, l_discount AS full_name_sim,
  CAST(CAST(l_linestatus = 'O' AS INT) AS DOUBLE) AS mid_initial_agree, l_tax AS mid_name_agree, CAST(count(*) OVER (PARTITION BY l_orderkey) AS DOUBLE) AS n,
  CAST(CAST(l_linenumber <> 3 AND l_returnflag = 'N' AS INT) AS DOUBLE) AS occ_medical, CAST(CAST(l_linenumber = 3 OR l_returnflag <> 'N' AS INT) AS DOUBLE) AS occ_unknown
FROM lineitem
""",
    "grid_cross_join": f"SELECT n_name AS state, y AS year FROM nation, (SELECT unnest([{_YEARS}]) AS y)",
    "uniqueness_check": """
SELECT count(*) AS n_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS n_keys, n_rows = n_keys AS is_unique, 'orderkey,linenumber' AS key FROM lineitem
UNION ALL
SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_keys, n_rows = n_keys AS is_unique, 'orderkey' AS key FROM lineitem
""",
    "null_aware_distinct": """
WITH o AS (SELECT o_custkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS p FROM orders)
SELECT o_custkey, count(DISTINCT p) + CAST(bool_or(p IS NULL) AS INT) AS n_values, count(DISTINCT p) AS n_known FROM o GROUP BY o_custkey
""",
    "sample_training": """
SELECT doc_id, lang, CAST(row_number() OVER (ORDER BY m, doc_id) AS INT) AS observation FROM (SELECT doc_id, lang, md5('0|' || CAST(doc_id AS VARCHAR)) AS m FROM documents ORDER BY m, doc_id LIMIT 1500)
""",
    "coder_agreement_kappa": """
WITH t AS (SELECT count(*) AS n, avg(CAST(quality = toxic AS INT)) AS po, avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)) AS pe FROM labels)
SELECT n, round(po, 9) AS agreement, round((po - pe) / (1 - pe), 9) AS kappa FROM t
""",
}

_PEOPLE = """
people AS (
  SELECT p_partkey AS key, p_name AS first, CASE WHEN p_partkey % 5 <> 0 THEN substring(p_brand, 7, 10) END AS middle, p_type || ' ' || CAST(p_size AS VARCHAR) AS last,
    ['CT', 'NY', 'MA', 'RI'][p_partkey % 4 + 1] AS state, CAST(2018 + (p_partkey // 4) % 2 AS INT) AS year, lpad(CAST(p_partkey * 7 % 60 AS VARCHAR), 5, '0') || '-0001' AS zip, (p_partkey // 8) % 3 = 0 AS is_left FROM part
), named AS (
  SELECT *, lower(first || coalesce(middle, '') || last) AS full_name, lower(first || last) AS short_name, lower(state) AS st, lower(left(coalesce(middle, ''), 1)) AS mi,
    regexp_replace(lower(first || coalesce(middle, '') || last), '[^\\p{L}\\p{N}]', '', 'g') AS whole_key, regexp_replace(lower(first || last), '[^\\p{L}\\p{N}]', '', 'g') AS short_key FROM people
), providers AS (SELECT * FROM named WHERE is_left), voters AS (SELECT * FROM named WHERE NOT is_left)
"""
_ADJACENT = f"adjacent AS (SELECT a, b FROM (VALUES {ADJACENCY_VALUES}) p(a, b) UNION SELECT b, a FROM (VALUES {ADJACENCY_VALUES}) p(a, b))"


def _matches(left: str, on: str) -> str:
    """Stage pairs: whole names alike, or short ones with one middle name of a letter at most."""

    def near(name: str, more: str) -> str:
        side = lambda f, s: f"(SELECT *, len(g) AS n, unnest(g) AS t FROM (SELECT *, {_grams(name, 3)} AS g FROM {f})) {s}"
        return f"""SELECT l.key AS x, r.key AS y FROM {side(left, "l")} JOIN {side("voters", "r")} ON l.t = r.t AND {on}{more}
          GROUP BY l.key, r.key, l.n, r.n HAVING count(*) / (l.n + r.n - count(*)) >= 0.7"""

    return f"""
      SELECT x, y FROM ({near("whole_key", "")})
      UNION
      SELECT x, y FROM ({near("short_key", " AND l.mi = r.mi")}) JOIN providers a ON a.key = x JOIN voters b ON b.key = y WHERE len(coalesce(a.middle, '')) <= 1 OR len(coalesce(b.middle, '')) <= 1
    """


def _features(pairs: str) -> str:
    mid = lambda s: f"lower(coalesce({s}.middle, ''))"
    return f"""
, featured AS (
  SELECT l.key AS npi, 'V' || CAST(r.key AS VARCHAR) AS LALVOTERID, {_grams("l.full_name", 3)} AS gx, {_grams("r.full_name", 3)} AS gy, {_grams(mid("l"), 2)} AS mx, {_grams(mid("r"), 2)} AS my, l.st = r.st AS state_agree,
    l.mi = r.mi AS mid_initial_agree, CAST(len(coalesce(l.middle, '')) AS INT) AS phys_mid_name_len, CAST(len(coalesce(r.middle, '')) AS INT) AS voters_mid_name_len, CAST(1960 + l.key % 40 - (1930 + r.key % 50) AS INT) AS year_dist,
    CASE WHEN a.lat IS NOT NULL AND b.lat IS NOT NULL THEN round({_MILES}, 6) END AS zip_dist
  FROM {pairs} JOIN providers l ON l.key = x JOIN voters r ON r.key = y LEFT JOIN points a ON lpad(CAST(a.n_nationkey * 3 AS VARCHAR), 5, '0') = left(l.zip, 5) LEFT JOIN points b ON lpad(CAST(b.n_nationkey * 3 AS VARCHAR), 5, '0') = left(r.zip, 5)
)
SELECT npi, LALVOTERID, {_jaccard("gx", "gy")} AS full_name_sim, state_agree, mid_initial_agree, {_jaccard("mx", "my")} AS mid_name_agree, phys_mid_name_len, voters_mid_name_len, year_dist, zip_dist FROM featured
"""


def _literal(value: object) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, int) else f"'{value}'"


def _values(rows) -> str:
    return ", ".join(f"({', '.join(map(_literal, r))})" for r in rows)


_STAGE_A = f"WITH {_PEOPLE}, {_POINTS}, first_pairs AS ({_matches('providers', 'l.year = r.year AND l.state = r.state')})"
_SAMPLE = "SELECT doc_id, row_number() OVER (ORDER BY md5('0|' || CAST(doc_id AS VARCHAR)), doc_id) AS o FROM documents"


def _part(k: int, n: int) -> str:
    return f"SELECT 'part_{k}' AS part, doc_id, CAST(NULL AS DOUBLE) AS match FROM rough WHERE o <= 300 QUALIFY row_number() OVER (ORDER BY md5('{k}|' || CAST(o AS VARCHAR)), o) <= {n}"


SQL |= {
    "provider_names": f"WITH {_PEOPLE} SELECT key AS npi, full_name, short_name AS full_name_no_mid, st, mi, first AS frst_nm, middle AS mid_nm, last AS last_nm FROM providers",
    "voter_columns": f"""
WITH {_PEOPLE}, v AS (SELECT *, CASE key % 3 WHEN 0 THEN 'Medical-Doctor' WHEN 1 THEN 'Unknown' END AS job FROM voters)
SELECT 'V' || CAST(key AS VARCHAR) AS LALVOTERID, first AS Voters_FirstName, middle AS Voters_MiddleName, last AS Voters_LastName, state AS Residence_Addresses_State, zip AS Residence_Addresses_Zip, state, year, job AS CommercialData_Occupation,
  full_name, short_name AS full_name_no_mid_l2, st, mi, coalesce(contains(job, 'Medical'), false) AS medical, coalesce(job = 'Unknown', true) AS na_medical, CASE WHEN contains(job, 'Medical') THEN job ELSE 'None' END AS medical_sub FROM v
""",
    "stage_a_pairs": _STAGE_A + _features("first_pairs"),
    "stage_b_pairs": f"""{_STAGE_A}, {_ADJACENT}, sure AS (
  SELECT x FROM (SELECT x, {_grams("l.full_name", 3)} AS gx, {_grams("r.full_name", 3)} AS gy FROM first_pairs JOIN providers l ON l.key = x JOIN voters r ON r.key = y)
  WHERE len(list_intersect(gx, gy)) / (len(gx) + len(gy) - len(list_intersect(gx, gy))) >= 0.85 GROUP BY x HAVING count(*) = 1
), rest AS (
  SELECT p.*, b AS nb_state FROM providers p JOIN adjacent ON a = state WHERE key NOT IN (SELECT x FROM sure) AND (year, state) IN (SELECT (year, state) FROM voters)
), second_pairs AS ({_matches('rest', 'l.year = r.year AND l.nb_state = r.state')})""" + _features("second_pairs"),
    "source_catalogue": f"SELECT kind, vintage, CAST(month AS INT) AS month, format, url FROM (VALUES {_values([('core', str(f.year), f.month, f.format, f.url) for f in CORE_FILES] + [('taxonomy', v, None, None, u) for v, u in TAXONOMY_FILES.items()])}) t(kind, vintage, month, format, url)",
    "scoped_grid": f"SELECT CAST(y AS INT) AS year, s AS state FROM (SELECT unnest(range(2018, 2026)) AS y), (VALUES {_values((s,) for s in STATES)}) t(s)",
    "core_files": """
WITH c AS (
  SELECT c_custkey AS npi, CAST(CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END AS INT) AS entity, c_name AS pfname, CAST(NULL AS VARCHAR) AS pmname, c_mktsegment AS plname, CASE WHEN c_custkey % 7 <> 0 THEN 'CT' END AS plocstatename,
    lpad(CAST(c_custkey % 1000 AS VARCHAR), 5, '0') AS ploczip, 'NY' AS pmailstatename, lpad(CAST(c_custkey % 60 AS VARCHAR), 5, '0') || '-0001' AS pmailzip FROM customer
)
SELECT *, CAST(2018 AS INT) AS year FROM c UNION ALL SELECT *, CAST(2019 AS INT) AS year FROM c WHERE npi % 2 = 0
""",
    "taxonomy_files": """
WITH t AS (
  SELECT o_custkey AS npi, CAST(ceil((o_orderkey % 8 + 1) / 4) AS INT) AS seq, ['2019-12', '2025-12', '2023-05', NULL][o_orderkey % 4 + 1] AS vintage, min(o_orderpriority) AS code FROM orders GROUP BY ALL
)
SELECT npi, code AS taxonomy_code FROM t WHERE seq = 1 AND vintage IS NOT NULL QUALIFY row_number() OVER (PARTITION BY npi ORDER BY vintage DESC, code) = 1
""",
    "loose_csv": "SELECT c_custkey AS npi, CAST(CASE WHEN c_custkey % 3 <> 0 THEN 1950 + c_custkey % 50 END AS INT) AS grd_yr, c_mktsegment AS med_sch FROM customer",
    "centroid_file": "SELECT lpad(CAST(n_nationkey % 7 AS VARCHAR), 5, '0') AS zcta5, CAST(max(25 + n_nationkey) AS DOUBLE) AS intptlat, CAST(max(n_nationkey - 120) AS DOUBLE) AS intptlong FROM nation GROUP BY n_nationkey % 7",
    "snapshot_tree": """
WITH e AS (SELECT event_id, upper(left(event_type, 2)) AS state, CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, CAST(day(ts) AS INT) AS day FROM events),
n AS (SELECT state, year, max(month * 100 + day) AS d FROM e GROUP BY ALL)
SELECT e.*, 'year=' || CAST(year AS VARCHAR) || '/state=' || state AS subdir FROM e JOIN n USING (state, year) WHERE month * 100 + day = d
""",
    "replaced_partitions": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN -o_custkey ELSE o_custkey END AS o_custkey, o_orderstatus FROM orders",
    "several_files": "SELECT doc_id, quality, CASE WHEN doc_id % 2 = 0 THEN toxic END AS toxic FROM labels",
    "training_parts": f"""
WITH rough AS ({_SAMPLE} QUALIFY o <= 300)
SELECT 'rough' AS part, doc_id, CAST(NULL AS DOUBLE) AS match FROM rough
UNION ALL FROM ({_part(1, 70)}) UNION ALL FROM ({_part(2, 160)}) UNION ALL FROM ({_part(3, 70)})
UNION ALL SELECT 'positives', doc_id, 1.0 FROM documents WHERE doc_id % 50 = 0
UNION ALL FROM (SELECT 'negatives', doc_id, 0.0 FROM documents WHERE doc_id % 30 < 10 QUALIFY row_number() OVER (ORDER BY md5('1|' || CAST(doc_id AS VARCHAR)), doc_id) <= 160)
""",
    "coder_join": "SELECT doc_id AS observation, quality AS match_x, toxic AS match_y FROM labels WHERE doc_id % 3 = 2",
    "sql_functions": f"""
WITH n AS (SELECT n_nationkey, 25.0::DOUBLE + n_nationkey AS lat, -120.0::DOUBLE AS lon, -100.5::DOUBLE AS lon2, {_grams("n_name", 2)} AS g FROM nation)
SELECT a.n_nationkey AS a, b.n_nationkey AS b, {_jaccard("a.g", "b.g")} AS sim, round({_MILES.replace("b.lon", "b.lon2")}, 6) AS miles FROM n a JOIN n b ON b.n_nationkey = a.n_nationkey + 1
""",
}
