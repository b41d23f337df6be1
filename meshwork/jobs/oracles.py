"""The same results in SQL, by other means where there are any: recursion for components, plain
theta joins for the stencil, self-joins for cycles."""

from __future__ import annotations

LINES = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


CASE = "CAST(year(l_shipdate) * 100 + month(l_shipdate) AS BIGINT) * 1000000 + l_orderkey // 15000"


def bonds(modulus: int) -> str:
    return f"""
rows0 AS (
  SELECT {CASE} AS case_id, o_custkey % {modulus} AS key_a, l_partkey % {modulus} AS key_b, {LINES} FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), rows1 AS (
  SELECT case_id, key_a, key_b, row_number() OVER (PARTITION BY case_id, key_a ORDER BY {LINES}) - 1 AS rank_a, row_number() OVER (PARTITION BY case_id, key_b ORDER BY {LINES}) - 1 AS rank_b FROM rows0
), rows2 AS (
  SELECT case_id, 2 * (rank_a // 4 * {modulus} + key_a) AS molecule_a, 2 * (rank_b // 4 * {modulus} + key_b) + 1 AS molecule_b, rank_a, rank_b FROM rows1
), bonds AS MATERIALIZED (
  SELECT case_id, molecule_a, molecule_b, 4 * molecule_a + rank_a % 4 AS endpoint_a, 4 * molecule_b + rank_b % 4 AS endpoint_b,
         row_number() OVER (PARTITION BY case_id ORDER BY 4 * molecule_a + rank_a % 4) - 1 AS bond_id FROM rows2
), pairs AS MATERIALIZED (
  SELECT case_id, least(molecule_a, molecule_b) AS molecule_a, greatest(molecule_a, molecule_b) AS molecule_b, count(*) AS multiplicity FROM bonds GROUP BY ALL
), molecules AS (
  SELECT case_id, CAST(m AS BIGINT) AS molecule FROM (SELECT DISTINCT case_id FROM bonds), range(0, {2 * modulus}) AS t(m)
  UNION SELECT case_id, molecule_a FROM bonds UNION SELECT case_id, molecule_b FROM bonds
)"""


DENSE, SPARSE = bonds(16), bonds(800)

FAULTY = f"""{SPARSE}, faulty AS (
  SELECT case_id, CASE WHEN bond_id % 83 = 29 THEN bond_id - 1 ELSE bond_id END AS bond_id, CASE WHEN bond_id % 53 = 7 THEN endpoint_b WHEN bond_id % 59 = 11 THEN 3 ELSE endpoint_a END AS endpoint_a,
         CASE WHEN bond_id % 53 = 7 THEN endpoint_a ELSE endpoint_b END AS endpoint_b,
         CASE WHEN bond_id % 61 = 13 THEN molecule_a + 2 WHEN bond_id % 67 = 17 THEN molecule_a + 1 ELSE molecule_a END AS molecule_a, molecule_b
  FROM bonds WHERE bond_id % 97 <> 41
)"""

NETWORK = f"""{SPARSE}, degrees AS (
  SELECT m.case_id, m.molecule, count(e.molecule) AS bond_degree FROM molecules m
  LEFT JOIN (SELECT case_id, molecule_a AS molecule FROM bonds UNION ALL SELECT case_id, molecule_b FROM bonds) e
    ON e.case_id = m.case_id AND e.molecule = m.molecule GROUP BY ALL
), steps AS (
  SELECT case_id, molecule_a AS u, molecule_b AS v FROM pairs UNION ALL SELECT case_id, molecule_b, molecule_a FROM pairs
), reach AS (
  SELECT case_id, molecule AS u, molecule AS v FROM molecules
  UNION SELECT r.case_id, r.u, s.v FROM reach r JOIN steps s ON s.case_id = r.case_id AND s.u = r.v
), parts AS (
  SELECT case_id, u AS molecule, min(v) AS root FROM reach GROUP BY ALL
), sizes AS (
  SELECT case_id, root, count(*) AS molecule_count FROM parts GROUP BY ALL
), summary AS (
  SELECT s.case_id, s.root, s.molecule_count, count(b.bond_id) AS bond_count,
         dense_rank() OVER (PARTITION BY s.case_id ORDER BY s.root) - 1 AS cluster_id
  FROM sizes s LEFT JOIN (SELECT p.root, b.* FROM bonds b JOIN parts p ON p.case_id = b.case_id AND p.molecule = b.molecule_a) b
    ON b.case_id = s.case_id AND b.root = s.root GROUP BY s.case_id, s.root, s.molecule_count
), marked AS (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY molecule_count DESC, cluster_id) = 1 AS is_largest,
         molecule_count = max(molecule_count) OVER (PARTITION BY case_id) AS tied FROM summary
), doubles AS (
  SELECT m.case_id, m.cluster_id, m.molecule_count AS size, m.bond_count AS bonds, count(d.root) AS h2, m.is_largest
  FROM marked m LEFT JOIN (SELECT q.case_id, p.root FROM pairs q JOIN parts p ON p.case_id = q.case_id AND p.molecule = q.molecule_a WHERE q.multiplicity = 2) d
    ON d.case_id = m.case_id AND d.root = m.root GROUP BY m.case_id, m.cluster_id, m.molecule_count, m.bond_count, m.is_largest
), scoped AS (
  SELECT d.*, scope, CASE WHEN size = 1 THEN 1 ELSE CAST(pow(2, ceil(log2(size))) AS BIGINT) END AS size_high
  FROM doubles d, (VALUES ('all'), ('exclude_one_largest')) AS t(scope) WHERE scope = 'all' OR NOT is_largest
), binned AS (
  SELECT *, CASE WHEN size_high = 1 THEN 1 ELSE size_high // 2 + 1 END AS size_low FROM scoped
), bins AS (
  SELECT case_id, scope, size_low, size_high, count(*) AS cluster_count, CAST(sum(size) AS BIGINT) AS molecule_count, CAST(sum(h2) AS BIGINT) AS h2,
         round(avg(h2 / size), 9) AS fraction_mean, round(sum(h2) / sum(size), 9) AS fraction_pooled FROM binned GROUP BY ALL
)"""

SITES = """sites AS MATERIALIZED (
  SELECT *, (x * 24 + y) * 24 + z AS site, (x * 24 + y) * 24 + z AS endpoint FROM (
    SELECT l_orderkey // 3000 AS case_id, l_partkey % 24 AS x, (7 * l_suppkey + l_orderkey) % 24 AS y, (l_orderkey // 5) % 24 AS z, CASE WHEN l_returnflag = 'N' THEN 'A' ELSE 'B' END AS type,
           row_number() OVER (PARTITION BY l_orderkey // 3000, l_partkey % 24, (7 * l_suppkey + l_orderkey) % 24, (l_orderkey // 5) % 24 ORDER BY %s) AS k,
           count(*) OVER (PARTITION BY l_orderkey // 3000, l_partkey % 24, (7 * l_suppkey + l_orderkey) % 24, (l_orderkey // 5) % 24) AS lines
    FROM lineitem) WHERE k = 1
)""".replace("%s", LINES)

PROBES = SITES + """, axis AS (SELECT unnest(range(-2, 3)) AS v
), offsets AS (SELECT p.v AS dx, q.v AS dy, r.v AS dz, abs(p.v) + abs(q.v) + abs(r.v) AS distance FROM axis p, axis q, axis r WHERE abs(p.v) + abs(q.v) + abs(r.v) BETWEEN 1 AND 2
), probes AS MATERIALIZED (SELECT case_id, endpoint AS endpoint_a, type AS type_a, x + dx AS x, y + dy AS y, z + dz AS z, distance FROM sites, offsets
), candidates AS MATERIALIZED (
  SELECT p.case_id, endpoint_a, s.endpoint AS endpoint_b, distance FROM probes p JOIN sites s ON s.case_id = p.case_id AND s.x = p.x AND s.y = p.y AND s.z = p.z WHERE endpoint_a < s.endpoint AND type_a <> s.type
)"""

SAMPLES = """samples AS (
  SELECT c_mktsegment AS segment, CAST(n_regionkey AS BIGINT) AS region, c_custkey AS sample, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS h
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL
), conditions AS (
  SELECT segment, region, round(avg(h / n), 9) AS share_mean FROM samples GROUP BY ALL
), peaks AS (
  SELECT segment, region AS peak_region, share_mean AS peak_mean FROM conditions
  QUALIFY row_number() OVER (PARTITION BY segment ORDER BY share_mean DESC, region) = 1
)"""


GRID = """grid AS (
  SELECT size, phi, i AS index, 'L' || CAST(size AS VARCHAR) || '_phi' || phi || '_i' || lpad(CAST(i AS VARCHAR), 6, '0') AS case_id
  FROM (SELECT DISTINCT CAST(8 * p_size AS BIGINT) AS size FROM part), (SELECT DISTINCT printf('0.%04d', c_custkey) AS phi FROM customer), range(0, 3) AS t(i)
)"""


def spread(x: str, name: str) -> str:
    return f"count({x}) AS {name}_n, round(avg({x}), 9) AS {name}_mean, round(stddev_samp({x}), 9) AS {name}_sd, round(stddev_samp({x}) / sqrt(count({x})), 9) AS {name}_se"


def prefixes(source: str, value: str, order: str) -> str:
    return f"""SELECT segment, region, first_n, count(v) AS n, round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS sd, round(stddev_samp(v) / sqrt(count(v)), 9) AS se
FROM (SELECT *, {value} AS v, row_number() OVER (PARTITION BY segment, region ORDER BY {order}) AS k, count(*) OVER (PARTITION BY segment, region) AS most FROM {source}) s
JOIN (VALUES ('5'), ('10'), ('20'), ('50'), ('100'), ('200'), ('500'), ('1000'), ('all')) AS c(first_n) ON first_n = 'all' OR (k <= TRY_CAST(first_n AS BIGINT) AND TRY_CAST(first_n AS BIGINT) <= most) GROUP BY ALL"""


def cycle_joins(length: int) -> str:
    """FROM and WHERE of the cycles of this length over steps(case_id, u, v, m)."""
    out, cond = "steps e1", ["e1.v > e1.u"]
    for k in range(2, length + 1):
        out += f" JOIN steps e{k} ON e{k}.case_id = e1.case_id AND e{k}.u = e{k - 1}.v"
        if k < length:
            cond += [f"e{k}.v > e1.u"] + [f"e{k}.v <> e{j}.v" for j in range(1, k)]
    cond += [f"e{length}.v = e1.u", f"e1.v < e{length}.u"]
    return f"FROM {out} WHERE {' AND '.join(cond)}"


STEPS = "steps AS (SELECT case_id, molecule_a AS u, molecule_b AS v, multiplicity AS m FROM pairs UNION ALL SELECT case_id, molecule_b, molecule_a, multiplicity FROM pairs)"
WAYS = {n: " * ".join(f"e{k}.m" for k in range(1, n + 1)) for n in (4, 6)}


def cycle_counts(length: int) -> str:
    return f"c{length} AS (SELECT e1.case_id, count(*) AS cycles, CAST(sum({WAYS[length]}) AS BIGINT) AS edge_cycles {cycle_joins(length)} GROUP BY ALL)"


def two_core_rounds(rounds: int) -> str:
    """A pruning round a step, more than the longest chain needs."""
    out, now = [], "pairs"
    for k in range(rounds):
        out.append(f"""alive{k} AS (SELECT case_id, m FROM (SELECT case_id, molecule_a AS m FROM {now} UNION ALL SELECT case_id, molecule_b FROM {now}) GROUP BY ALL HAVING count(*) >= 2),
core{k} AS MATERIALIZED (SELECT p.* FROM {now} p SEMI JOIN alive{k} a ON a.case_id = p.case_id AND a.m = p.molecule_a SEMI JOIN alive{k} b ON b.case_id = p.case_id AND b.m = p.molecule_b)""")
        now = f"core{k}"
    return ", ".join(out) + f" SELECT case_id, molecule_a, molecule_b, multiplicity FROM {now}"


NAMED = "WITH RECURSIVE "

ORACLES = {
    "pair_multiplicity": f"WITH {DENSE} SELECT * FROM pairs",
    "multiplicity_hist": f"WITH {DENSE} SELECT case_id, {', '.join(f'count(*) FILTER (multiplicity = {k}) AS h{k}' for k in range(1, 5))}, CAST(sum(multiplicity) AS BIGINT) AS bonds FROM pairs GROUP BY ALL",
    "h2_fractions": f"""WITH {DENSE} SELECT case_id, molecules, bonds, h2, round(h2 / 13824, 9) AS h2_per_volume, round(h2 / bonds, 9) AS h2_per_bond,
round(2 * h2 / bonds, 9) AS h2_endpoint_fraction_bonded, round(h2 / molecules, 9) AS h2_endpoint_fraction_all
FROM (SELECT case_id, CAST(sum(multiplicity) AS BIGINT) AS bonds, count(*) FILTER (multiplicity = 2) AS h2 FROM pairs GROUP BY ALL) JOIN (SELECT case_id, count(*) AS molecules FROM molecules GROUP BY ALL) USING (case_id)""",
    "molecule_degree": f"{NAMED}{NETWORK} SELECT * FROM degrees",
    "isolated_count": f"{NAMED}{NETWORK} SELECT case_id, count(*) FILTER (bond_degree = 0) AS isolated FROM degrees GROUP BY ALL",
    "components_members": f"{NAMED}{NETWORK} SELECT p.case_id, p.molecule, s.cluster_id, s.molecule_count AS cluster_size, d.bond_degree FROM parts p JOIN summary s USING (case_id, root) JOIN degrees d USING (case_id, molecule)",
    "components_summary": f"{NAMED}{NETWORK} SELECT case_id, cluster_id, molecule_count, bond_count FROM summary",
    "network_summary": f"""{NAMED}{NETWORK}, ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY molecule_count DESC, cluster_id) AS k FROM summary)
SELECT case_id, CAST(sum(molecule_count) AS BIGINT) AS molecules, CAST(sum(bond_count) AS BIGINT) AS bonds, count(*) AS clusters, max(molecule_count) AS largest,
coalesce(max(molecule_count) FILTER (k = 2), 0) AS second_largest, count(*) FILTER (molecule_count = 1) AS isolated_molecules, round(max(molecule_count) / sum(molecule_count), 9) AS largest_fraction
FROM ranked GROUP BY ALL""",
    "largest_members": f"{NAMED}{NETWORK} SELECT p.case_id, p.molecule, s.cluster_id, s.molecule_count AS cluster_size, d.bond_degree FROM parts p JOIN marked s USING (case_id, root) JOIN degrees d USING (case_id, molecule) WHERE is_largest",
    "largest_edges": f"{NAMED}{NETWORK} SELECT b.case_id, bond_id, molecule_a, molecule_b, endpoint_a, endpoint_b, cluster_id FROM bonds b JOIN parts p ON p.case_id = b.case_id AND p.molecule = b.molecule_b JOIN marked s ON s.case_id = p.case_id AND s.root = p.root WHERE is_largest",
    "tied_largest": f"{NAMED}{NETWORK} SELECT case_id, cluster_id, molecule_count FROM marked WHERE tied",
    "cluster_moments": f"""{NAMED}{NETWORK} SELECT case_id, round(avg(molecule_count), 9) AS size_mean,
round(sum(molecule_count * molecule_count) / sum(molecule_count), 9) AS weighted_all,
round(sum(molecule_count * molecule_count) FILTER (NOT is_largest) / sum(molecule_count) FILTER (NOT is_largest), 9) AS weighted_excl_one,
round(sum(molecule_count * molecule_count) FILTER (NOT tied) / sum(molecule_count) FILTER (NOT tied), 9) AS weighted_excl_all_tied,
count(*) FILTER (tied) AS largest_tie_count, min(cluster_id) FILTER (is_largest) AS selected_largest_id FROM marked GROUP BY ALL""",
    "cluster_histogram": f"{NAMED}{NETWORK} SELECT case_id, molecule_count AS size, count(*) AS count FROM summary GROUP BY ALL",
    "cluster_h2": f"{NAMED}{NETWORK} SELECT case_id, cluster_id, size, bonds, h2, round(h2 / size, 9) AS endpoint_fraction_all, round(CASE WHEN bonds > 0 THEN 2 * h2 / bonds END, 9) AS endpoint_fraction_bonded FROM doubles",
    "size_bins": f"{NAMED}{NETWORK} SELECT * FROM bins",
    "size_relation": f"""{NAMED}{NETWORK} SELECT case_id // 100000000 AS condition, scope, size_low, size_high, count(*) AS samples_with_bin, CAST(sum(cluster_count) AS BIGINT) AS clusters,
{spread('fraction_mean', 'fraction')}, any_value(total) AS total_samples
FROM bins JOIN (SELECT case_id // 100000000 AS c, count(DISTINCT case_id) AS total FROM bonds GROUP BY ALL) ON c = case_id // 100000000 GROUP BY ALL""",
    "presence_counts": f"""{NAMED}{NETWORK}, grid AS (
SELECT * FROM (SELECT DISTINCT case_id FROM doubles), (VALUES ('all'), ('exclude_one_largest')) AS t(scope), (SELECT DISTINCT size_low, size_high FROM binned)
), filled AS (SELECT g.case_id, g.scope, g.size_low, g.size_high, count(b.size) FILTER (b.h2 = 0) AS without_h2, count(b.size) FILTER (b.h2 > 0) AS with_h2
FROM grid g LEFT JOIN binned b USING (case_id, scope, size_low, size_high) GROUP BY ALL
), every AS (SELECT case_id, scope, 'BIN' AS kind, size_low, size_high, without_h2, with_h2 FROM filled
UNION ALL SELECT case_id, scope, 'TOTAL', 0, 0, CAST(sum(without_h2) AS BIGINT), CAST(sum(with_h2) AS BIGINT) FROM filled GROUP BY ALL)
SELECT *, without_h2 + with_h2 AS cluster_count, round(CASE WHEN without_h2 + with_h2 > 0 THEN with_h2 / (without_h2 + with_h2) END, 9) AS fraction_with_h2 FROM every""",
    **{f"cycles{n}": f"WITH {DENSE}, {STEPS}, {cycle_counts(n)} SELECT case_id, coalesce(cycles, 0) AS cycles FROM (SELECT DISTINCT case_id FROM bonds) LEFT JOIN c{n} USING (case_id)" for n in (4, 6)},
    "cycles_edge_multiplicity": f"WITH {DENSE}, {STEPS}, {cycle_counts(4)}, {cycle_counts(6)} SELECT case_id, coalesce(c4.edge_cycles, 0) AS c4_edge, coalesce(c6.edge_cycles, 0) AS c6_edge FROM (SELECT DISTINCT case_id FROM bonds) LEFT JOIN c4 USING (case_id) LEFT JOIN c6 USING (case_id)",
    "cycle_endpoint_share": f"""WITH {DENSE}, {STEPS}, found AS (SELECT e1.case_id, e1.u AS v0, e1.v AS v1, e2.v AS v2, e3.v AS v3 {cycle_joins(4)}),
used AS (SELECT case_id, v0 AS p, v1 AS q FROM found UNION SELECT case_id, v1, v2 FROM found UNION SELECT case_id, v2, v3 FROM found UNION SELECT case_id, v3, v0 FROM found),
own AS (SELECT DISTINCT case_id, least(p, q) AS molecule_a, greatest(p, q) AS molecule_b FROM used),
sums AS (SELECT case_id, CAST(sum(multiplicity) AS BIGINT) AS cycle_bonds FROM own JOIN pairs USING (case_id, molecule_a, molecule_b) GROUP BY ALL)
SELECT b.case_id, b.bonds, coalesce(cycle_bonds, 0) AS cycle_bonds, round(coalesce(cycle_bonds, 0) / b.bonds, 9) AS bond_share FROM (SELECT case_id, count(*) AS bonds FROM bonds GROUP BY ALL) b LEFT JOIN sums USING (case_id)""",
    "two_core": f"WITH {SPARSE}, {two_core_rounds(40)}",
    "stencil_candidates": f"WITH {PROBES} SELECT * FROM candidates",
    "stencil_stats": f"""WITH {SITES}, d AS (SELECT unnest(range(-2, 3)) AS v), o AS (SELECT p.v AS dx, q.v AS dy, r.v AS dz FROM d p, d q, d r WHERE abs(p.v) + abs(q.v) + abs(r.v) BETWEEN 1 AND 2)
SELECT case_id, count(*) AS offsets_tested, count(*) FILTER (x + dx BETWEEN 0 AND 23 AND y + dy BETWEEN 0 AND 23 AND z + dz BETWEEN 0 AND 23) AS site_lookups FROM sites, o GROUP BY ALL""",
    "endpoint_decode": f"WITH {SITES} SELECT case_id, endpoint, endpoint // 4 AS molecule, endpoint % 4 AS arm FROM sites",
    "site_coord_roundtrip": f"WITH {SITES} SELECT case_id, site, x, y, z, site AS again FROM sites",
    "condition_summary": f"WITH {SAMPLES} SELECT segment, region, count(*) AS samples, {spread('h / n', 'share')}, {spread('n', 'n')}, min(n) AS n_min, max(n) AS n_max FROM samples GROUP BY ALL",
    "mean_of_ratios_vs_pooled": f"WITH {SAMPLES} SELECT segment, region, round(avg(h / n), 9) AS mean_of_ratios, round(sum(h) / sum(n), 9) AS pooled_ratio FROM samples GROUP BY ALL",
    "null_safe_ratio": f"WITH {SAMPLES} SELECT sample, round(CASE WHEN h > 0 THEN n / h END, 9) AS ratio FROM samples",
    "convergence_prefix": f"WITH {SAMPLES} " + prefixes("samples", "CASE WHEN h > 0 THEN n / h END", "sample"),
    "prefix_at_peak": f"WITH {SAMPLES}, mine AS (SELECT samples.* FROM samples JOIN peaks ON peaks.segment = samples.segment AND peak_region = region) " + prefixes("mine", "h / n", "CAST(sample AS VARCHAR)"),
    "peak_by_group": f"WITH {SAMPLES} SELECT * FROM peaks",
    "threshold_selection": f"""WITH {SAMPLES} SELECT segment, max(region) FILTER (region < peak_region AND share_mean <= 0.34) AS low_region, any_value(peak_region) AS peak_region,
min(region) FILTER (region > peak_region AND share_mean >= 0.33) AS high_region FROM conditions JOIN peaks USING (segment) GROUP BY segment""",
    "nearest_condition": f"WITH {SAMPLES} SELECT segment, region AS nearest_region FROM conditions QUALIFY row_number() OVER (PARTITION BY segment ORDER BY round(abs(share_mean - 0.33), 9), region) = 1",
    "resource_summary": """SELECT o_orderpriority AS grp, count(*) AS attempted, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'P') AS incomplete,
count(*) FILTER (o_orderstatus = 'O') AS open_ones, round(median(o_totalprice) FILTER (o_orderstatus = 'F'), 9) AS median_value, min(o_totalprice) FILTER (o_orderstatus = 'F') AS least_value,
max(o_totalprice) FILTER (o_orderstatus = 'F') AS most_value FROM orders GROUP BY ALL""",
    "bond_violations": f"""WITH {FAULTY}, ends AS (SELECT case_id, endpoint_a AS e FROM faulty UNION ALL SELECT case_id, endpoint_b FROM faulty),
reused AS (SELECT case_id, count(*) FILTER (n > 1) AS bad FROM (SELECT case_id, e, count(*) AS n FROM ends GROUP BY ALL) GROUP BY ALL),
wide AS (SELECT case_id, count(*) AS n FROM (SELECT case_id, least(molecule_a, molecule_b) AS p, greatest(molecule_a, molecule_b) AS q, count(*) AS m FROM faulty GROUP BY ALL) WHERE m > 4 GROUP BY ALL)
SELECT case_id, 'order' AS rule, count(*) FILTER (endpoint_a >= endpoint_b) AS bad_count FROM faulty GROUP BY ALL
UNION ALL SELECT case_id, 'owner', count(*) FILTER (endpoint_a // 4 <> molecule_a OR endpoint_b // 4 <> molecule_b) FROM faulty GROUP BY ALL
UNION ALL SELECT case_id, 'type', count(*) FILTER (molecule_a % 2 <> 0 OR molecule_b % 2 <> 1) FROM faulty GROUP BY ALL
UNION ALL SELECT case_id, 'numbering', count(*) - count(DISTINCT bond_id) + max(bond_id) + 1 - count(DISTINCT bond_id) FROM faulty GROUP BY ALL
UNION ALL SELECT case_id, 'endpoint_reuse', bad FROM reused
UNION ALL SELECT case_id, 'multiplicity', coalesce(n, 0) FROM (SELECT DISTINCT case_id FROM faulty) LEFT JOIN wide USING (case_id)""",
    "coverage_check": """WITH c AS (SELECT c_custkey, c_mktsegment AS segment, CAST(n_nationkey AS BIGINT) AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey),
expected AS (SELECT DISTINCT segment, nation FROM c), found AS (SELECT DISTINCT segment, nation FROM c JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P')
SELECT segment, nation, 'missing' AS problem FROM (SELECT * FROM expected EXCEPT SELECT * FROM found) UNION ALL SELECT segment, nation, 'unknown' FROM (SELECT * FROM found EXCEPT SELECT * FROM expected)""",
    "duplicate_check": "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "reconciliation": """WITH l AS (SELECT l_orderkey AS key, CASE WHEN bool_and(l_linestatus <> 'O') THEN 'F' WHEN bool_and(l_linestatus <> 'F') THEN 'O' ELSE 'P' END AS status FROM lineitem GROUP BY ALL)
SELECT coalesce(o_orderkey, key) AS key, o_orderstatus AS a_status, status AS b_status FROM orders FULL JOIN l ON key = o_orderkey WHERE o_orderstatus IS DISTINCT FROM status""",
    "value_reconciliation": """WITH l AS (SELECT l_orderkey, sum(l_extendedprice) AS lines FROM lineitem GROUP BY ALL)
SELECT o_orderpriority AS priority, count(*) FILTER (abs(o_totalprice - lines) <= greatest(0.25 * greatest(abs(o_totalprice), abs(lines)), 1.0)) AS near, count(*) AS orders FROM orders JOIN l ON l_orderkey = o_orderkey GROUP BY ALL""",
    "grid_plan": f"WITH {GRID} SELECT size, phi, index, case_id FROM grid",
    "derived_seeds": f"""WITH {GRID}, g AS (SELECT case_id, sha256('study:' || CAST(size AS VARCHAR) || ':' || phi || ':' || CAST(index AS VARCHAR)) AS d FROM grid)
SELECT case_id, CAST(CAST('0x' || substr(d, 1, 16) AS UBIGINT) AS VARCHAR) AS seed FROM g""",
    "resume_antijoin": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "group_union": "SELECT o_custkey AS key, count(*) AS runs, min(o_orderstatus || '_' || CAST(o_orderkey AS VARCHAR)) AS first_run, count(DISTINCT o_orderstatus) AS groups FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL",
    "trajectory_step_check": """WITH s AS (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, count(*) FILTER (event_id <= before) AS backward, count(*) FILTER (event_id = before + 1) AS unit_steps, count(*) AS steps FROM s GROUP BY ALL""",
    "nest_arms": "SELECT user_id, event_type, count(*) AS length, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS ids FROM events GROUP BY ALL",
    "stride_thinning": """SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS nation FROM (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS k,
count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) WHERE k % CAST(ceil(n / 10) AS BIGINT) = 0""",
}
