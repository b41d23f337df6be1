"""SQL of the queries in results_queries."""

from __future__ import annotations

from meshwork.jobs.integrity_oracles import LISTED, spread_labels
from meshwork.jobs.oracles import NAMED, NETWORK
from meshwork.jobs.study_oracles import RELATION, SAMPLE, YEAR

TOTALS = ("clusters", "molecules", "largest", "h2", "bonds")
SUMS = "count(*) AS clusters, CAST(sum(size) AS BIGINT) AS molecules, max(size) AS largest, CAST(sum(h2) AS BIGINT) AS h2, CAST(sum(bonds) AS BIGINT) AS bonds"
LINES = f"""items AS (SELECT *, cluster_id // 200 AS chunk, case_id // 1000000 % 7 AS k FROM doubles
), bad AS (SELECT DISTINCT case_id, chunk, k FROM items WHERE (k IN (1, 3, 5) AND chunk = 0) OR (k IN (2, 4) AND chunk = 1)
), sums AS (SELECT case_id, {SUMS} FROM items ANTI JOIN bad USING (case_id, chunk) GROUP BY ALL
), told AS (SELECT * REPLACE (CASE WHEN case_id // 1000000 % 7 = 6 THEN bonds + 1 ELSE bonds END AS bonds) FROM (SELECT case_id, {SUMS} FROM items GROUP BY ALL))"""
GROUPED = """runs AS (SELECT o_custkey AS customer, o_orderpriority AS priority, o_orderstatus AS grp FROM orders
), planned AS (SELECT c_custkey AS customer, priority, substr('FOP', c_nationkey % 3 + 1, 1) AS grp FROM customer, (SELECT DISTINCT o_orderpriority AS priority FROM orders) WHERE c_mktsegment <> 'BUILDING'
), seen AS (SELECT customer, priority, count(*) AS runs, string_agg(DISTINCT grp, ',' ORDER BY grp) AS groups FROM runs GROUP BY ALL)"""

ORACLES = {
    "cache_quarantine": f"""{NAMED}{NETWORK}, {LINES} SELECT case_id, chunk, unnest(CASE k WHEN 1 THEN ['corrupt'] WHEN 5 THEN ['corrupt'] WHEN 2 THEN ['version'] WHEN 3 THEN ['totals'] ELSE ['repeated', 'totals'] END) AS reason FROM bad""",
    "cache_totals": f"""{NAMED}{NETWORK}, {LINES} SELECT case_id, {', '.join(f's.{t}' for t in TOTALS)}, nullif(concat_ws(',', {', '.join(f"CASE WHEN s.{t} IS DISTINCT FROM told.{t} THEN '{t}' END" for t in TOTALS)}), '') AS differs FROM told LEFT JOIN sums s USING (case_id)""",
    "compact_faults": "SELECT case_id, CASE case_id % 11 WHEN 3 THEN 'text' WHEN 4 THEN 'molecule' WHEN 5 THEN 'target' WHEN 6 THEN 'reuse' ELSE 'format' END AS fault FROM (SELECT DISTINCT o_orderkey // 3000 AS case_id FROM orders) WHERE case_id % 11 BETWEEN 3 AND 7",
    "compact_summary": f"""WITH {LISTED}, steps2 AS (SELECT case_id, molecule_a AS u, molecule_b AS v FROM expected UNION SELECT case_id, molecule_b, molecule_a FROM expected
), {spread_labels(25).replace('steps', 'steps2')}, every AS (SELECT c.case_id, c.molecule, coalesce(root, c.molecule) AS root FROM centres c LEFT JOIN parts p USING (case_id, molecule) WHERE c.case_id % 11 NOT BETWEEN 3 AND 7
), sizes AS (SELECT case_id, root, count(*) AS n FROM every GROUP BY ALL), held AS (SELECT case_id, count(*) AS bonds FROM expected GROUP BY ALL)
SELECT case_id, CAST(sum(n) AS BIGINT) AS molecules, coalesce(any_value(bonds), 0) AS bonds, CAST(13 * sum(n) AS BIGINT) AS occupied, CAST(3 AS BIGINT) AS arm_length, count(*) AS clusters, max(n) AS largest, count(*) FILTER (n = top) AS tied
FROM (SELECT *, max(n) OVER (PARTITION BY case_id) AS top FROM sizes) LEFT JOIN held USING (case_id) GROUP BY ALL""",
    "group_clashes": f"""WITH {GROUPED} SELECT customer, priority, 'repeated' AS problem, runs, groups FROM seen WHERE runs > 1
UNION ALL SELECT customer, priority, 'unexpected', runs, groups FROM seen ANTI JOIN planned USING (customer, priority)
UNION ALL SELECT customer, priority, 'absent', 0, grp FROM planned ANTI JOIN runs USING (customer, priority, grp)""",
    "group_results": "SELECT o_orderstatus AS \"group\", o_orderstatus || '/' || CAST(o_orderkey AS VARCHAR) AS run, o_orderkey AS condition, o_totalprice FROM orders",
    "key_union": f"""SELECT CAST(event_id AS VARCHAR) AS event, CASE WHEN user_id % 2 = 0 THEN CAST(user_id AS VARCHAR) END AS "user", CASE WHEN user_id % 2 = 1 THEN CAST(user_id AS VARCHAR) END AS "odd user",
{', '.join(f"CASE WHEN event_type = '{t}' THEN json_extract_string(props, '$.k') END AS {t}_k" for t in ('view', 'click', 'error', 'purchase', 'signup'))} FROM events""",
    "resume_verified": """SELECT month, state, state <> 'kept' AS again FROM (SELECT month, CASE WHEN month % 7 = 2 THEN 'absent' WHEN month % 5 = 3 THEN 'lost' WHEN month % 11 = 4 THEN 'added' ELSE 'kept' END AS state
FROM (SELECT DISTINCT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS month FROM orders))""",
    "relation_grid": f"""{NAMED}{RELATION}, r AS (SELECT * FROM relation WHERE scope = 'exclude_one_largest') SELECT condition, size_low, size_high, coalesce(fraction_n, 0) AS fraction_n, fraction_mean
FROM (SELECT * FROM (SELECT DISTINCT condition FROM r), (SELECT DISTINCT size_low, size_high FROM r)) g LEFT JOIN r USING (condition, size_low, size_high)""",
    "relation_layout": f"""{NAMED}{RELATION}, totals AS (SELECT {YEAR} AS condition, count(DISTINCT case_id) AS total FROM bonds GROUP BY ALL
), r AS (SELECT condition, CASE WHEN condition % 5 = 1 THEN NULL ELSE CAST(condition % 100 AS INTEGER) END AS percent, size_low, CASE WHEN condition % 3 = 0 AND size_low = 2 THEN total + 1 ELSE samples_with_bin END AS n, total FROM relation JOIN totals USING (condition)
), want AS (SELECT CAST(unnest(range(93, 100)) AS INTEGER) AS percent), have AS (SELECT DISTINCT percent FROM r WHERE percent IS NOT NULL)
SELECT DISTINCT 24 AS size, percent, CASE WHEN percent IS NULL THEN 'percent' ELSE 'contribution' END AS problem FROM r WHERE percent IS NULL OR n NOT BETWEEN 1 AND total
UNION ALL SELECT DISTINCT 24, percent, 'repeated' FROM r WHERE condition % 4 = 1
UNION ALL SELECT 24, percent, 'missing' FROM want ANTI JOIN have USING (percent) UNION ALL SELECT 24, percent, 'unknown' FROM have ANTI JOIN want USING (percent)""",
    "condition_alignment": """WITH y AS (SELECT DISTINCT CAST(year(l_shipdate) AS BIGINT) AS condition FROM lineitem)
SELECT condition, 'unknown' AS problem FROM y WHERE condition % 4 <> 1 AND condition % 3 = 0 UNION ALL SELECT condition, 'missing' FROM y WHERE condition % 4 = 1 AND condition % 3 <> 0""",
    "replicate_check": "SELECT c_mktsegment AS segment, CAST(c_nationkey AS BIGINT) AS nation, count(*) AS samples FROM customer GROUP BY ALL HAVING count(*) <> 12",
    "moment_violations": f"""{NAMED}{SAMPLE} SELECT case_id, 'weighted_all' AS rule FROM samples0 WHERE case_id // 1000000 % 5 = 1
UNION ALL SELECT case_id, 'weighted_excl_all_tied' FROM samples0 WHERE case_id // 1000000 % 7 = 2 AND weighted_excl_all_tied IS NOT NULL UNION ALL SELECT case_id, 'clusters' FROM samples0 WHERE case_id // 1000000 % 11 = 3""",
}
