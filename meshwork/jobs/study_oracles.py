"""SQL of the queries in study_queries."""

from __future__ import annotations

from meshwork.jobs import oracles
from meshwork.jobs.oracles import DENSE, FAULTY, NAMED, NETWORK, PROBES, SAMPLES, SITES, SPARSE, STEPS, cycle_joins, spread

SAMPLE = f"""{NETWORK}, ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY molecule_count DESC, cluster_id) AS k FROM summary
), hist AS (SELECT case_id, {', '.join(f'count(*) FILTER (multiplicity = {k}) AS h{k}' for k in range(1, 5))} FROM pairs GROUP BY ALL
), base AS (
  SELECT case_id, CAST(sum(molecule_count) AS BIGINT) AS molecules, CAST(sum(bond_count) AS BIGINT) AS bonds, count(*) AS clusters, max(molecule_count) AS largest,
         coalesce(max(molecule_count) FILTER (k = 2), 0) AS second_largest, count(*) FILTER (molecule_count = 1) AS isolated_molecules FROM ranked GROUP BY ALL
), moments AS (SELECT case_id, avg(molecule_count) AS size_mean, sum(molecule_count * molecule_count) / sum(molecule_count) AS weighted_all,
  sum(molecule_count * molecule_count) FILTER (NOT is_largest) / sum(molecule_count) FILTER (NOT is_largest) AS weighted_excl_one,
  sum(molecule_count * molecule_count) FILTER (NOT tied) / sum(molecule_count) FILTER (NOT tied) AS weighted_excl_all_tied FROM marked GROUP BY ALL
), samples0 AS (
  SELECT base.*, h1, h2, h3, h4, largest / molecules AS largest_fraction, bonds / (2 * molecules) AS p, clusters / 13824 AS clusters_per_volume,
         h2 / 13824 AS h2_per_volume, h2 / bonds AS h2_per_bond, 2 * h2 / bonds AS h2_endpoint_fraction_bonded, h2 / molecules AS h2_endpoint_fraction_all,
         size_mean, weighted_all, weighted_excl_one, weighted_excl_all_tied
  FROM base JOIN hist USING (case_id) JOIN moments USING (case_id)
)"""
SHARES = ("largest_fraction", "p", "clusters_per_volume", "h2_per_volume", "h2_per_bond", "h2_endpoint_fraction_bonded", "h2_endpoint_fraction_all", "size_mean", "weighted_all", "weighted_excl_one", "weighted_excl_all_tied")
METRICS = ("largest_fraction", "p", "clusters_per_volume", "h2", "h2_per_volume", "h2_per_bond", "h2_endpoint_fraction_bonded", "h2_endpoint_fraction_all", "size_mean", "weighted_all", "weighted_excl_one", "weighted_excl_all_tied")
YEAR = "case_id // 100000000"


def metric_summary(source: str, keys: str, metrics: tuple[str, ...]) -> str:
    key = f"{keys}, " if keys else ""
    return " UNION ALL ".join(
        f"SELECT {key}'{m}' AS metric, count({m}) AS n, round(avg({m}), 9) AS mean, round(stddev_samp({m}), 9) AS sd, round(stddev_samp({m}) / sqrt(count({m})), 9) AS se, CAST(min({m}) AS DOUBLE) AS least, CAST(max({m}) AS DOUBLE) AS most FROM {source} GROUP BY ALL" for m in metrics
    )


PRESENCE = oracles.ORACLES["presence_counts"].removeprefix(NAMED)
HEAD, TAIL = PRESENCE.rsplit("SELECT *, without_h2", 1)
RELATION = f"""{NETWORK}, relation AS (SELECT {YEAR} AS condition, scope, size_low, size_high, count(*) AS samples_with_bin, {spread('fraction_mean', 'fraction')} FROM bins GROUP BY ALL)"""
COMPARED = f"""{RELATION}, compared AS (SELECT a.condition, a.scope, a.fraction_mean AS small_mean, b.fraction_mean AS large_mean, a.fraction_mean > b.fraction_mean AS smaller_is_more
  FROM relation a JOIN relation b ON a.condition = b.condition AND a.scope = b.scope WHERE a.size_high = 2 AND b.size_high = 4)"""


def found(length: int) -> str:
    vs = ", ".join(f"e{k}.v AS v{k}" for k in range(1, length))
    ways = " * ".join(f"e{k}.m" for k in range(1, length + 1))
    return f"found{length} AS MATERIALIZED (SELECT e1.case_id, e1.u AS v0, {vs}, {ways} AS ways {cycle_joins(length)})"


def per_cluster(length: int) -> str:
    sides = " UNION ".join(f"SELECT case_id, least(v{k}, v{(k + 1) % length}) AS molecule_a, greatest(v{k}, v{(k + 1) % length}) AS molecule_b FROM found{length}" for k in range(length))
    return f"""cyc{length} AS (SELECT f.case_id, p.root, count(*) AS n, CAST(sum(ways) AS BIGINT) AS edge FROM found{length} f JOIN parts p ON p.case_id = f.case_id AND p.molecule = f.v0 GROUP BY ALL
), used{length} AS ({sides}), own{length} AS (SELECT u.case_id, p.root, CAST(sum(multiplicity) AS BIGINT) AS b FROM used{length} u JOIN pairs q USING (case_id, molecule_a, molecule_b) JOIN parts p ON p.case_id = u.case_id AND p.molecule = u.molecule_a GROUP BY ALL)"""


CYCLES = f"""{NETWORK.replace(SPARSE, DENSE)}, {STEPS.replace('steps AS', 'around AS')}, {found(4).replace('steps ', 'around ')}, {found(6).replace('steps ', 'around ')}, {per_cluster(4)}, {per_cluster(6)},
cycle_rows AS (
  SELECT m.case_id, m.cluster_id, m.molecule_count AS size, m.bond_count AS bonds, d.h2, coalesce(c4.n, 0) AS c4_mol, coalesce(c6.n, 0) AS c6_mol, coalesce(c4.edge, 0) AS c4_edge, coalesce(c6.edge, 0) AS c6_edge,
         coalesce(o4.b, 0) AS b4, coalesce(o6.b, 0) AS b6, m.is_largest, round(d.h2 / m.molecule_count, 9) AS q_h2, round(coalesce(o4.b, 0) / (2 * m.molecule_count), 9) AS q4, round(coalesce(o6.b, 0) / (2 * m.molecule_count), 9) AS q6,
         round(coalesce(c4.n, 0) / m.molecule_count, 9) AS c4_per_molecule, round(coalesce(c6.n, 0) / m.molecule_count, 9) AS c6_per_molecule
  FROM marked m JOIN doubles d USING (case_id, cluster_id) LEFT JOIN cyc4 c4 USING (case_id, root) LEFT JOIN cyc6 c6 USING (case_id, root) LEFT JOIN own4 o4 USING (case_id, root) LEFT JOIN own6 o6 USING (case_id, root)
), totals AS (
  SELECT case_id, CAST(sum(size) AS BIGINT) AS molecules, CAST(sum(c4_mol) AS BIGINT) AS c4, CAST(sum(c6_mol) AS BIGINT) AS c6, 100 * (sum(c4_mol) / sum(size)) AS c4_per_100, 100 * (sum(c6_mol) / sum(size)) AS c6_per_100 FROM cycle_rows GROUP BY ALL
), cycle_scoped AS (
  SELECT c.*, scope, CASE WHEN size = 1 THEN 1 ELSE CAST(pow(2, ceil(log2(size))) AS BIGINT) END AS size_high FROM cycle_rows c, (VALUES ('all'), ('exclude_one_largest')) AS t(scope) WHERE scope = 'all' OR NOT is_largest
), cycle_bins AS (
  SELECT case_id, scope, CASE WHEN size_high = 1 THEN 1 ELSE size_high // 2 + 1 END AS size_low, size_high, count(*) AS cluster_count, {', '.join(f'round(avg({m}), 9) AS {m}' for m in ('q_h2', 'q4', 'q6', 'c4_per_molecule', 'c6_per_molecule'))} FROM cycle_scoped GROUP BY ALL
)"""

ORACLES = {
    "sample_rows": f"{NAMED}{SAMPLE} SELECT * REPLACE ({', '.join(f'round({c}, 9) AS {c}' for c in SHARES)}) FROM samples0",
    "sample_violations": f"""{NAMED}{SAMPLE}, faulty0 AS (SELECT * REPLACE (CASE WHEN case_id // 1000000 % 5 = 1 THEN h1 + 1 ELSE h1 END AS h1, CASE WHEN case_id // 1000000 % 7 = 2 THEN largest_fraction + 1e-6 ELSE largest_fraction END AS largest_fraction) FROM samples0)
SELECT case_id, 'bonds' AS rule FROM faulty0 WHERE h1 + 2 * h2 + 3 * h3 + 4 * h4 <> bonds
UNION ALL SELECT case_id, 'double_share' FROM faulty0 WHERE NOT abs(h2 / molecules - p * 2 * h2 / bonds) <= 1e-8
UNION ALL SELECT case_id, 'range' FROM faulty0 WHERE NOT (2 * h2 <= bonds AND bonds <= 2 * molecules AND h2 >= 0)
UNION ALL SELECT case_id, 'largest' FROM faulty0 WHERE NOT abs(largest_fraction - largest / molecules) <= 1e-8
UNION ALL SELECT case_id, 'sizes' FROM faulty0 WHERE NOT (second_largest <= largest AND largest + second_largest <= molecules AND isolated_molecules <= clusters AND clusters <= molecules)""",
    "study_summary": f"{NAMED}{SAMPLE}, s AS (SELECT *, {YEAR} AS condition FROM samples0) {metric_summary('s', 'condition', METRICS)}",
    "percent_summary": f"{NAMED}{SAMPLE}, s AS (SELECT {YEAR} AS condition, 100 * (2 * bonds / (4 * molecules)) AS bonded, 100 * largest_fraction AS largest, 100 * h2_endpoint_fraction_bonded AS doubled FROM samples0) {metric_summary('s', 'condition', ('bonded', 'largest', 'doubled'))}",
    "largest_h2": f"""{NAMED}{NETWORK} SELECT case_id, CAST(sum(h2) AS BIGINT) AS h2, CAST(sum(h2) FILTER (is_largest) AS BIGINT) AS h2_largest, max(size) FILTER (is_largest) AS largest,
round(CASE WHEN sum(h2) > 0 THEN sum(h2) FILTER (is_largest) / sum(h2) END, 9) AS h2_share, round(max(size) FILTER (is_largest) / sum(size), 9) AS largest_fraction, round(sum(h2) FILTER (is_largest) / max(size) FILTER (is_largest), 9) AS h2_per_molecule FROM doubles GROUP BY ALL""",
    "presence_summary": f"{NAMED}{HEAD}, counted AS (SELECT *, without_h2{TAIL}), s AS (SELECT *, {YEAR} AS condition FROM counted) {metric_summary('s', 'condition, scope, kind, size_low, size_high', ('without_h2', 'with_h2', 'cluster_count', 'fraction_with_h2'))}",
    "bin_comparison": f"{NAMED}{COMPARED} SELECT * FROM compared",
    "bin_diagnostics": f"{NAMED}{COMPARED} SELECT scope, count(*) AS eligible, count(*) FILTER (smaller_is_more) AS satisfied, coalesce(string_agg(CAST(condition AS VARCHAR), ',' ORDER BY condition) FILTER (NOT smaller_is_more), '') AS opposite FROM compared GROUP BY ALL",
    "bin_plot_rows": f"{NAMED}{RELATION} SELECT condition, scope, size_low, size_high, round(sqrt(size_low * size_high), 9) AS middle, round(100 * fraction_mean, 9) AS percent FROM relation",
    "cycle_clusters": f"{NAMED}{CYCLES} SELECT * FROM cycle_rows",
    "cycle_bins": f"{NAMED}{CYCLES} SELECT * FROM cycle_bins",
    "cycle_bin_summary": f"""{NAMED}{CYCLES} SELECT {YEAR} AS condition, scope, size_low, size_high, count(*) AS n_contributing, any_value(total) AS n_total, round(sum(cluster_count) / any_value(total), 9) AS cluster_count_mean,
{', '.join(f'round(avg({m}), 9) AS {m}_mean, round(stddev_samp({m}) / sqrt(count({m})), 9) AS {m}_se' for m in ('q_h2', 'q4', 'q6', 'c4_per_molecule', 'c6_per_molecule'))}
FROM cycle_bins JOIN (SELECT {YEAR} AS y, count(DISTINCT case_id) AS total FROM cycle_rows GROUP BY ALL) ON y = {YEAR} GROUP BY ALL""",
    "cycle_totals": f"{NAMED}{CYCLES} SELECT * REPLACE (round(c4_per_100, 9) AS c4_per_100, round(c6_per_100, 9) AS c6_per_100) FROM totals",
    "cycle_summary": f"{NAMED}{CYCLES}, s AS (SELECT *, {YEAR} AS condition FROM totals) {metric_summary('s', 'condition', ('c4', 'c6', 'c4_per_100', 'c6_per_100'))}",
    "cycle_violations": f"""{NAMED}{CYCLES}, f AS (SELECT * REPLACE (CASE WHEN cluster_id % 2 = 0 THEN c4_edge + 1 ELSE c4_mol END AS c4_mol) FROM cycle_rows)
SELECT case_id, count(*) FILTER (c4_edge < c4_mol OR c6_edge < c6_mol) AS fewer_edge_cycles, count(*) FILTER (b4 > bonds OR b6 > bonds) AS too_many_bonds, count(*) FILTER ((c4_mol > 0) <> (b4 > 0) OR (c6_mol > 0) <> (b6 > 0)) AS unmatched FROM f GROUP BY ALL""",
    "graph_violations": f"""{NAMED}{NETWORK}, {FAULTY.split('), faulty AS')[1].join(['faulty AS', ''])}, placed AS (SELECT f.*, a.root AS root_a, b.root AS root_b FROM faulty f LEFT JOIN parts a ON a.case_id = f.case_id AND a.molecule = f.molecule_a LEFT JOIN parts b ON b.case_id = f.case_id AND b.molecule = f.molecule_b),
counted AS (SELECT s.case_id, s.root, s.molecule_count AS size, count(p.bond_id) AS bonds FROM sizes s LEFT JOIN placed p ON p.case_id = s.case_id AND p.root_b = s.root GROUP BY ALL),
degree AS (SELECT case_id, m, count(*) AS n FROM (SELECT case_id, molecule_a AS m FROM faulty UNION ALL SELECT case_id, molecule_b FROM faulty) GROUP BY ALL),
rules AS (SELECT case_id, 'apart' AS rule, count(*) AS bad_count FROM placed WHERE root_a IS DISTINCT FROM root_b GROUP BY ALL
UNION ALL SELECT case_id, 'same_type', count(*) FROM placed WHERE (molecule_a - molecule_b) % 2 = 0 GROUP BY ALL
UNION ALL SELECT case_id, 'degree', count(*) FROM degree WHERE n > 4 GROUP BY ALL
UNION ALL SELECT case_id, 'too_few', count(*) FROM counted WHERE bonds < size - 1 GROUP BY ALL
UNION ALL SELECT case_id, 'too_many', count(*) FROM counted WHERE bonds > 2 * size GROUP BY ALL
UNION ALL SELECT case_id, 'lone', count(*) FROM counted WHERE size = 1 AND bonds > 0 GROUP BY ALL) SELECT * FROM rules""",
    "candidate_violations": f"""WITH {PROBES}, every AS (SELECT * FROM candidates UNION ALL SELECT * FROM candidates WHERE endpoint_a % 41 = 3 UNION ALL SELECT case_id, endpoint_b, endpoint_a, distance FROM candidates WHERE endpoint_a % 37 = 5),
per AS (SELECT case_id, e, count(*) AS n FROM (SELECT case_id, endpoint_a AS e FROM every UNION ALL SELECT case_id, endpoint_b FROM every) GROUP BY ALL),
copies AS (SELECT case_id, count(*) AS n FROM every GROUP BY case_id, endpoint_a, endpoint_b)
SELECT case_id, 'order' AS rule, count(*) FILTER (endpoint_a >= endpoint_b) AS bad_count FROM every GROUP BY ALL
UNION ALL SELECT case_id, 'crowded', count(*) FILTER (n > 24) FROM per GROUP BY ALL
UNION ALL SELECT case_id, 'repeated', count(*) FILTER (n > 1) FROM copies GROUP BY ALL""",
    "trajectory_violations": """WITH s AS (SELECT l_orderkey AS molecule, CAST(l_linenumber AS BIGINT) AS step, l_partkey % 24 AS x, l_suppkey % 24 AS y, l_orderkey % 24 AS z, l_returnflag AS type FROM lineitem),
d AS (SELECT DISTINCT * FROM s), p AS (SELECT *, lag(step) OVER w AS step0, lag(x) OVER w AS x0, lag(y) OVER w AS y0, lag(z) OVER w AS z0 FROM d WINDOW w AS (PARTITION BY molecule ORDER BY step, x, y, z, type)),
m AS (SELECT molecule, count(*) FILTER (step0 IS NOT NULL AND step <> step0 + 1) AS gaps, count(*) FILTER (step0 IS NOT NULL AND abs(x - x0) + abs(y - y0) + abs(z - z0) <> 1) AS jumps, count(*) - count(DISTINCT (x, y, z)) AS crossings, CAST(count(DISTINCT type) > 1 AS INTEGER) AS mixed FROM p GROUP BY ALL)
SELECT molecule, gaps, jumps, crossings, mixed FROM m WHERE gaps + jumps + crossings + mixed > 0""",
    "candidate_rows": f"""WITH {PROBES} SELECT r.case_id, endpoint_a, a.type AS type_a, a.site AS site_a, a.x AS x_a, a.y AS y_a, a.z AS z_a, endpoint_b, b.type AS type_b, b.site AS site_b, b.x AS x_b, b.y AS y_b, b.z AS z_b, distance
FROM candidates r JOIN sites a ON a.case_id * 100000 + a.endpoint = r.case_id * 100000 + r.endpoint_a JOIN sites b ON b.case_id * 100000 + b.endpoint = r.case_id * 100000 + r.endpoint_b""",
    "occupied_sites": f"WITH {SITES} SELECT case_id, count(*) AS sites, count(*) FILTER (type = 'A') AS type_a, count(*) FILTER (type = 'B') AS type_b, CAST(sum(lines) AS BIGINT) AS lines, count(*) FILTER (lines > 1) AS shared FROM sites GROUP BY ALL",
    "component_order": f"{NAMED}{NETWORK} SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY molecule_count DESC, root) AS place, root, molecule_count FROM summary QUALIFY place <= 5",
    "first_cases": f"WITH {SPARSE} SELECT * FROM (SELECT {YEAR} AS condition, case_id, count(*) AS bonds FROM bonds GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY condition ORDER BY case_id) <= 2",
    "over_the_cap": f"WITH {SPARSE} SELECT case_id, count(*) AS bonds FROM bonds GROUP BY ALL HAVING count(*) > 60",
    "tolerant_selection": f"WITH {SAMPLES} SELECT sample, n, h FROM samples WHERE 2 * h = n",
    "subset_check": f"WITH {SAMPLES}, r AS (SELECT DISTINCT segment, region FROM samples WHERE h >= 2 * (n - h)) SELECT s.segment, t.region FROM (SELECT DISTINCT segment FROM r) s, (SELECT DISTINCT region FROM r) t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.segment = s.segment AND r.region = t.region)",
    "safe_names": "SELECT page_id, name, regexp_matches(name, '^[A-Za-z0-9][A-Za-z0-9._-]*$') AS safe FROM (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS name FROM pages)",
    "file_digests": "SELECT page_id, sha256(coalesce(html, '')) AS sha256, octet_length(encode(coalesce(html, ''))) AS bytes FROM pages",
    "stale_entries": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'missing' WHEN page_id % 5 = 0 THEN 'stale' ELSE 'kept' END AS state FROM pages",
    "folder_bytes": "SELECT host, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS total, round(avg(bytes), 9) AS mean, max(bytes) AS most FROM (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, octet_length(encode(coalesce(html, ''))) AS bytes FROM pages) GROUP BY ALL",
    "token_lines": "SELECT event_id, event_type AS kind, user_id FROM events",
    "manifest_status": "SELECT event_type, k // 10 AS level, count(*) AS rows, count(k) AS known FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY ALL",
    "best_export": "SELECT o_custkey AS customer, o_orderkey AS run, lines FROM orders JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY lines DESC, o_orderkey DESC) = 1",
    "single_rows": "SELECT lines, count(*) AS orders FROM (SELECT o_orderkey, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) WHERE lines <> 1 GROUP BY ALL",
    "complete_folders": "SELECT l_suppkey AS supplier, count(DISTINCT p_size) AS sizes FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL HAVING count(DISTINCT p_size) = (SELECT count(DISTINCT p_size) FROM part)",
    "cluster_json": f"{NAMED}{NETWORK} SELECT case_id, count(*) AS clusters, CAST(sum(size) AS BIGINT) AS molecules, CAST(sum(h2) AS BIGINT) AS h2 FROM doubles WHERE bonds > 0 GROUP BY ALL",
    "memory_estimate": "SELECT part, molecules, 12 * volume + molecules * 196 AS bytes, greatest(1000, 100 * molecules) AS attempts FROM (SELECT p_partkey AS part, CAST(8 * p_size AS BIGINT) * 8 * p_size * 8 * p_size AS volume, CAST(8 * p_size AS BIGINT) * 8 * p_size * 8 * p_size // 10 // 21 AS molecules FROM part)",
}
