"""SQL of the queries in integrity_queries."""

from __future__ import annotations

from meshwork.jobs.oracles import LINES, NAMED, NETWORK, CASE, two_core_rounds

SITES = [(-1, 0, 0, 0, 0)] + [(arm, step, dx, dy, step - 1) for arm, (dx, dy) in enumerate(((1, 0), (-1, 0), (0, 1), (0, -1))) for step in (1, 2, 3)]

TRAJECTORIES = f"""centres AS (
  SELECT o_orderkey // 3000 AS case_id, o_orderkey AS molecule, CASE WHEN o_custkey % 2 = 0 THEN 'A' ELSE 'B' END AS type,
         1 + 4 * (o_orderkey % 3000 % 16) AS cx, 1 + 4 * (o_orderkey % 3000 // 16 % 16) AS cy, 1 + 4 * (o_orderkey % 3000 // 256) AS cz FROM orders
), steps AS (SELECT * FROM (VALUES {', '.join(map(str, SITES))}) AS s(arm, step, dx, dy, dz)
), trajectories AS (SELECT case_id, molecule, type, arm, step, cx + dx AS x, cy + dy AS y, cz + dz AS z FROM centres, steps
), faulty AS MATERIALIZED (
  SELECT case_id, molecule, CASE WHEN molecule % 109 = 9 AND arm = 3 THEN CASE WHEN type = 'A' THEN 'B' ELSE 'A' END WHEN molecule % 139 = 23 THEN 'C' ELSE type END AS type,
         CASE WHEN molecule % 131 = 17 AND arm = 3 THEN 4 ELSE arm END AS arm, CASE WHEN molecule % 137 = 19 AND arm = -1 THEN 1 ELSE step END AS step,
         CASE WHEN molecule % 103 = 5 AND arm = 1 AND step = 3 THEN x + 5 ELSE x END AS x, y, CASE WHEN molecule % 107 = 7 AND arm = 0 AND step = 3 THEN z - 2 ELSE z END AS z
  FROM trajectories WHERE NOT (molecule % 101 = 3 AND arm = 2 AND step = 2) AND NOT (molecule % 113 = 11 AND arm = 3 AND step = 3)
  UNION ALL SELECT case_id, molecule, type, arm, step, x, y, z + 1000 FROM trajectories WHERE molecule % 127 = 13 AND arm = -1
), centre AS (SELECT case_id, molecule, x AS x0, y AS y0, z AS z0 FROM faulty WHERE arm = -1 QUALIFY row_number() OVER (PARTITION BY case_id, molecule ORDER BY step, x, y, z) = 1
), placed AS (
  SELECT *, row_number() OVER w AS place, lag(x) OVER w AS xb, lag(y) OVER w AS yb, lag(z) OVER w AS zb FROM faulty WINDOW w AS (PARTITION BY case_id, molecule, arm ORDER BY step, x, y, z, type)
), judged AS (
  SELECT case_id, molecule, CAST(count(DISTINCT type) <> 1 OR count(*) FILTER (type NOT IN ('A', 'B')) > 0 AS BIGINT) AS types,
         CAST(count(*) FILTER (arm = -1) <> 1 OR count(*) FILTER (arm = -1 AND step <> 0) > 0 AS BIGINT) AS centres,
         count(*) FILTER (arm NOT BETWEEN -1 AND 3) AS arms, count(*) FILTER (arm BETWEEN 0 AND 3 AND step <> place) AS steps,
         CAST(len(list_distinct([count(*) FILTER (arm = 0), count(*) FILTER (arm = 1), count(*) FILTER (arm = 2), count(*) FILTER (arm = 3)])) > 1 AS BIGINT) AS lengths,
         count(*) FILTER (arm BETWEEN 0 AND 3 AND abs(x - coalesce(xb, x0)) + abs(y - coalesce(yb, y0)) + abs(z - coalesce(zb, z0)) <> 1) AS jumps,
         count(*) - count(DISTINCT (x, y, z)) AS crossings
  FROM placed LEFT JOIN centre USING (case_id, molecule) GROUP BY ALL
)"""
BAD = "types + centres + arms + steps + lengths + jumps + crossings"


def ends(source: str) -> str:
    return f"SELECT case_id, 4 * molecule + arm AS endpoint, molecule, arm, type, x, y, z FROM {source} WHERE arm BETWEEN 0 AND 3 QUALIFY row_number() OVER (PARTITION BY case_id, molecule, arm ORDER BY step DESC) = 1"


FIELDS = [f"{c}_{s}" for s in "ab" for c in ("molecule", "arm", "type", "x", "y", "z")] + ["distance"]
LISTED = f"""{TRAJECTORIES}, points AS MATERIALIZED ({ends('trajectories')}
), axis AS (SELECT unnest(range(-2, 3)) AS v), offsets AS (SELECT p.v AS dx, q.v AS dy, r.v AS dz FROM axis p, axis q, axis r WHERE abs(p.v) + abs(q.v) + abs(r.v) BETWEEN 1 AND 2
), probes AS (SELECT p.*, x + dx AS px, y + dy AS py, z + dz AS pz, abs(dx) + abs(dy) + abs(dz) AS distance FROM points p, offsets
), expected AS MATERIALIZED (
  SELECT a.case_id, a.endpoint AS endpoint_a, b.endpoint AS endpoint_b, {', '.join(f'{s}.{c} AS {c}_{s}' for s in 'ab' for c in ('molecule', 'arm', 'type', 'x', 'y', 'z'))}, distance
  FROM probes a JOIN points b ON a.case_id = b.case_id AND px = b.x AND py = b.y AND pz = b.z WHERE a.endpoint < b.endpoint AND a.type <> b.type AND a.molecule <> b.molecule
), changed AS (
  SELECT * REPLACE (CASE WHEN endpoint_a % 59 = 11 THEN x_a + 1 ELSE x_a END AS x_a, CASE WHEN endpoint_a % 61 = 13 THEN CASE WHEN type_b = 'A' THEN 'B' ELSE 'A' END ELSE type_b END AS type_b,
    CASE WHEN endpoint_a % 67 = 17 THEN 3 - distance ELSE distance END AS distance, CASE WHEN endpoint_a % 79 = 31 THEN arm_b + 4 ELSE arm_b END AS arm_b) FROM expected WHERE endpoint_a % 53 <> 7
), listed AS MATERIALIZED (
  SELECT * FROM changed UNION ALL SELECT * FROM changed WHERE endpoint_a % 71 = 19 UNION ALL SELECT * REPLACE (endpoint_b + 4 AS endpoint_b) FROM changed WHERE endpoint_a % 73 = 23
)"""
APART = "abs(x_a - x_b) + abs(y_a - y_b) + abs(z_a - z_b)"
STORED = """members AS (SELECT p.case_id, p.molecule, p.root, s.cluster_id, s.molecule_count AS cluster_size, d.bond_degree FROM parts p JOIN summary s USING (case_id, root) JOIN degrees d USING (case_id, molecule)
), stored0 AS (
  SELECT case_id, molecule, CASE WHEN cluster_id % 11 = 3 THEN cluster_id - 1 WHEN cluster_id % 13 = 5 AND molecule // 2 % 2 = 1 THEN cluster_id + 1000000 WHEN cluster_id % 17 = 7 THEN cluster_id + 5000000 ELSE cluster_id END AS label,
         CASE WHEN cluster_id % 19 = 11 THEN cluster_size + 1 ELSE cluster_size END AS stored_size, CASE WHEN molecule % 89 = 7 THEN bond_degree + 1 ELSE bond_degree END AS stored_degree FROM members WHERE molecule % 97 <> 13
), stored AS MATERIALIZED (
  SELECT * FROM stored0 UNION ALL SELECT * FROM stored0 WHERE molecule % 103 = 29 UNION ALL SELECT * REPLACE (molecule + 8000000 AS molecule) FROM stored0 WHERE molecule % 101 = 31
)"""
DIFFERENCES = """, cells AS (SELECT case_id, label, m.root, m.cluster_id, count(*) AS molecules FROM (SELECT DISTINCT case_id, molecule, label FROM stored) JOIN members m USING (case_id, molecule) GROUP BY ALL
), wide AS (SELECT *, count(*) OVER (PARTITION BY case_id, label) AS roots, count(*) OVER (PARTITION BY case_id, root) AS labels FROM cells)
SELECT case_id, label, root, molecules, CASE WHEN labels > 1 AND roots > 1 THEN 'mixed' WHEN labels > 1 THEN 'split' WHEN roots > 1 THEN 'merged' ELSE 'renamed' END AS kind
FROM wide WHERE labels > 1 OR roots > 1 OR label <> cluster_id"""


def spread_labels(rounds: int) -> str:
    """Smallest molecule reachable: neighbours' least label, then the label's own label, in turn."""
    out, now = ["label0 AS MATERIALIZED (SELECT DISTINCT case_id, u AS molecule, u AS label FROM steps)"], "label0"
    for k in range(1, rounds + 1):
        out.append(f"""low{k} AS (SELECT s.case_id, s.u AS molecule, least(any_value(o.label), min(l.label)) AS label FROM steps s JOIN {now} l ON l.case_id = s.case_id AND l.molecule = s.v JOIN {now} o ON o.case_id = s.case_id AND o.molecule = s.u GROUP BY ALL
), label{k} AS MATERIALIZED (SELECT a.case_id, a.molecule, b.label FROM low{k} a JOIN low{k} b ON b.case_id = a.case_id AND b.molecule = a.label)""")
        now = f"label{k}"
    return ", ".join(out) + f", parts AS MATERIALIZED (SELECT case_id, molecule, label AS root FROM {now})"


GIANT = f"""lines AS (
  SELECT CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE {CASE} END AS case_id, l_orderkey AS key_a, l_partkey * 10 + l_suppkey % 10 AS key_b, {LINES} FROM lineitem
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY case_id, key_a ORDER BY {LINES}) - 1 AS rank_a, row_number() OVER (PARTITION BY case_id, key_b ORDER BY {LINES}) - 1 AS rank_b FROM lines
), owned AS (
  SELECT case_id, rank_a, rank_b, 2 * (dense_rank() OVER (PARTITION BY case_id ORDER BY key_a, rank_a // 4) - 1) AS molecule_a, 2 * (dense_rank() OVER (PARTITION BY case_id ORDER BY key_b, rank_b // 4) - 1) + 1 AS molecule_b FROM ranked
), bonds AS MATERIALIZED (
  SELECT case_id, molecule_a, molecule_b, row_number() OVER (PARTITION BY case_id ORDER BY 4 * molecule_a + rank_a % 4) - 1 AS bond_id FROM owned
), pairs AS MATERIALIZED (
  SELECT case_id, least(molecule_a, molecule_b) AS molecule_a, greatest(molecule_a, molecule_b) AS molecule_b, count(*) AS multiplicity FROM bonds GROUP BY ALL
)"""
GIANT_NETWORK = f"""{GIANT}, steps AS MATERIALIZED (SELECT case_id, molecule_a AS u, molecule_b AS v FROM pairs UNION ALL SELECT case_id, molecule_b, molecule_a FROM pairs
), {spread_labels(20)}, degrees AS (SELECT case_id, molecule, count(*) AS bond_degree FROM (SELECT case_id, molecule_a AS molecule FROM bonds UNION ALL SELECT case_id, molecule_b FROM bonds) GROUP BY ALL
), sizes AS (SELECT case_id, root, count(*) AS molecule_count FROM parts GROUP BY ALL
), summary AS MATERIALIZED (
  SELECT s.case_id, s.root, s.molecule_count, count(*) AS bond_count, dense_rank() OVER (PARTITION BY s.case_id ORDER BY s.root) - 1 AS cluster_id
  FROM sizes s JOIN parts p USING (case_id, root) JOIN bonds b ON b.case_id = s.case_id AND b.molecule_a = p.molecule GROUP BY s.case_id, s.root, s.molecule_count
)"""

ORACLES = {
    "molecule_faults": f"WITH {TRAJECTORIES} SELECT * FROM judged WHERE {BAD} > 0",
    "nested_molecules": f"""WITH {TRAJECTORIES}, good AS (SELECT case_id, molecule FROM judged WHERE {BAD} = 0),
paths AS (SELECT case_id, molecule, arm, min(type) AS type, string_agg(x || ' ' || y || ' ' || z, ';' ORDER BY step) AS path FROM faulty JOIN good USING (case_id, molecule) GROUP BY ALL)
SELECT c.case_id, c.molecule, c.type, c.path AS centre, string_agg(c.path || ';' || a.path, '|' ORDER BY a.arm) AS arms FROM paths c JOIN paths a ON a.case_id = c.case_id AND a.molecule = c.molecule AND c.arm = -1 AND a.arm >= 0 GROUP BY ALL""",
    "molecule_ends": f"WITH {TRAJECTORIES} {ends('faulty')}",
    "candidate_reconciliation": f"""WITH {LISTED}, met AS (SELECT DISTINCT l.*, e.case_id IS NULL AS invented, {', '.join(f'e.{v} AS e_{v}' for v in FIELDS)} FROM listed l LEFT JOIN expected e USING (case_id, endpoint_a, endpoint_b))
SELECT case_id, endpoint_a, endpoint_b, 'missing' AS problem, NULL AS field FROM expected ANTI JOIN listed USING (case_id, endpoint_a, endpoint_b)
UNION ALL SELECT DISTINCT case_id, endpoint_a, endpoint_b, 'invented', NULL FROM met WHERE invented
UNION ALL SELECT case_id, endpoint_a, endpoint_b, 'repeated', NULL FROM listed GROUP BY ALL HAVING count(*) > 1
{' '.join(f"UNION ALL SELECT DISTINCT case_id, endpoint_a, endpoint_b, 'altered', '{v}' FROM met WHERE NOT invented AND {v} <> e_{v}" for v in FIELDS)}""",
    "bond_row_faults": f"""WITH {LISTED}, met AS MATERIALIZED (SELECT l.*, a.endpoint AS known_a, b.endpoint AS known_b, {', '.join(f'{s}.{c} AS k{c}_{s}' for s in 'ab' for c in ('type', 'x', 'y', 'z'))}
  FROM listed l LEFT JOIN points a ON a.case_id = l.case_id AND a.endpoint = l.endpoint_a LEFT JOIN points b ON b.case_id = l.case_id AND b.endpoint = l.endpoint_b),
rules AS (SELECT case_id, 'order' AS rule FROM met WHERE endpoint_a >= endpoint_b
UNION ALL SELECT case_id, 'owner' FROM met WHERE endpoint_a <> 4 * molecule_a + arm_a OR endpoint_b <> 4 * molecule_b + arm_b
UNION ALL SELECT case_id, 'arm' FROM met WHERE arm_a NOT BETWEEN 0 AND 3 OR arm_b NOT BETWEEN 0 AND 3
UNION ALL SELECT case_id, 'unknown' FROM met WHERE known_a IS NULL OR known_b IS NULL
UNION ALL SELECT case_id, 'type' FROM met WHERE type_a IS DISTINCT FROM ktype_a OR type_b IS DISTINCT FROM ktype_b
UNION ALL SELECT case_id, 'same_type' FROM met WHERE type_a = type_b
UNION ALL SELECT case_id, 'coordinates' FROM met WHERE {' OR '.join(f'{c}_{s} IS DISTINCT FROM k{c}_{s}' for s in 'ab' for c in 'xyz')}
UNION ALL SELECT case_id, 'reach' FROM met WHERE {APART} NOT BETWEEN 1 AND 2
UNION ALL SELECT case_id, 'distance' FROM met WHERE {APART} <> distance
UNION ALL SELECT case_id, 'reuse' FROM (SELECT case_id, e FROM (SELECT case_id, endpoint_a AS e FROM listed UNION ALL SELECT case_id, endpoint_b FROM listed) GROUP BY ALL HAVING count(*) > 1))
SELECT case_id, rule, count(*) AS bad_count FROM rules GROUP BY ALL""",
    "partition_differences": f"{NAMED}{NETWORK}, {STORED}{DIFFERENCES}",
    "membership_faults": f"""{NAMED}{NETWORK}, {STORED}, met AS (SELECT case_id, molecule, n, stored_size, most, stored_degree, highest, m.cluster_size, m.bond_degree FROM
  (SELECT case_id, molecule, count(*) AS n, min(stored_size) AS stored_size, max(stored_size) AS most, min(stored_degree) AS stored_degree, max(stored_degree) AS highest FROM stored GROUP BY ALL) FULL JOIN members m USING (case_id, molecule)),
rules AS (SELECT case_id, 'missing' AS rule FROM met WHERE n IS NULL UNION ALL SELECT case_id, 'unknown' FROM met WHERE cluster_size IS NULL UNION ALL SELECT case_id, 'repeated' FROM met WHERE n > 1
UNION ALL SELECT case_id, 'size' FROM met WHERE stored_size <> cluster_size OR most <> cluster_size UNION ALL SELECT case_id, 'degree' FROM met WHERE stored_degree <> bond_degree OR highest <> bond_degree)
SELECT case_id, rule, count(*) AS bad_count FROM rules GROUP BY ALL""",
    "giant_clusters": f"""WITH {GIANT_NETWORK} SELECT case_id, cluster_id, root, molecule_count, bond_count, row_number() OVER (PARTITION BY case_id ORDER BY molecule_count DESC, cluster_id) = 1 AS is_largest,
molecule_count = max(molecule_count) OVER (PARTITION BY case_id) AS tied FROM summary""",
    "giant_two_core": f"WITH {GIANT}, {two_core_rounds(40)}",
    "giant_partition_differences": f"WITH {GIANT_NETWORK}, {STORED}{DIFFERENCES}",
}
