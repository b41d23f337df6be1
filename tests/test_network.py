import random
from itertools import permutations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from meshwork.operators import components, constraints, cores, graph, kernels, motifs, spatial, stats

COLUMNS = "case_id long, bond_id long, endpoint_a long, endpoint_b long, molecule_a long, molecule_b long"


def bonds(spark, pairs, case=1):
    """A bond for each pair of molecules; a window over the ends of a molecule deals its arms out."""
    ends = spark.createDataFrame([(case, k, side, m) for k, pair in enumerate(pairs) for side, m in zip("ab", pair)], "case_id long, bond_id long, side string, molecule long")
    arm = F.row_number().over(Window.partitionBy("molecule").orderBy("bond_id", "side")) - 1
    wide = ends.withColumn("endpoint", (4 * F.col("molecule") + arm).cast("long")).groupBy("case_id", "bond_id").pivot("side", ["a", "b"]).agg(F.first("endpoint").alias("endpoint"), F.first("molecule").alias("molecule"))
    return wide.select("case_id", "bond_id", *(F.col(f"{side}_{c}").alias(f"{c}_{side}") for c in ("endpoint", "molecule") for side in "ab"))


def molecules(spark, n, case=1):
    return spark.createDataFrame([(case, m) for m in range(n)], "case_id long, molecule long")


def summary(spark, pairs, n):
    b, m = bonds(spark, pairs), molecules(spark, n)
    parts = graph.members(b, m)
    return b, m, parts, graph.with_largest(graph.clusters(b, parts))


def test_known_sample():
    """The published counts of the 16-site lattice with seed 3."""
    rows, counts = kernels.place_sample(16, 3, kernels.molecules_for("0.1", 16, 5), 5, 0.5, 10_000)
    assert (counts["placed"], counts["attempts"], counts["center_occupied"], counts["trapped"]) == (19, 23, 2, 2)
    assert sum(r[2] == "A" for r in rows) == 4 * 11


def test_known_sample_bonds_and_clusters(spark):
    cases = spark.createDataFrame([(1, 16, 3, "0.1", 5, 0.5)], "case_id long, size int, seed long, phi string, arm_length int, p_a double")
    placed = kernels.place(cases)
    assert spatial.candidates(kernels.endpoints_of(placed), 16, ("case_id",)).count() == 7
    b = kernels.bond(placed, 16)
    parts = graph.members(b, molecules(spark, 19))
    row = graph.network_summary(graph.with_largest(graph.clusters(b, parts))).first()
    assert (row.bonds, row.clusters, row.isolated_molecules, row.largest, row.second_largest) == (3, 16, 13, 2, 2)


@pytest.mark.parametrize("phi,n", [("0.105", 5), ("0.104999999999999999", 4), ("0.105000000000000001", 5), ("1.05e-1", 5), ("1", 47), (".105", 5), ("+0.1050", 5)])
def test_exact_fraction(phi, n):
    assert kernels.molecules_for(phi, 10, 5) == n


def test_unbuildable_corner():
    rows, counts = kernels.place_sample(2, 1, 1, 3, 0.5, 7)
    assert not rows and counts["placed"] == 0 and counts["trapped"] == 7 and not counts["completed"]


def test_matching_conflict():
    edges = [(0, 5), (0, 4), (1, 4)]
    for seed in range(40):
        assert len(kernels.match_sample(edges, 8, seed)) in (1, 2)
        assert len(kernels.match_sample(edges, 8, seed, several=False)) == 1


def test_two_bonds_exactly(spark):
    b, m, parts, s = summary(spark, [(0, 1), (0, 1), (1, 2), (3, 4), (3, 4), (3, 4)], 7)
    got = graph.cluster_doubles(b, parts, s).orderBy("cluster_id").collect()
    assert [(r.size, r.bonds, r.h2) for r in got] == [(3, 3, 1), (2, 3, 0), (1, 0, 0), (1, 0, 0)]
    assert [r.root for r in parts.orderBy("molecule").collect()] == [0, 0, 0, 3, 3, 5, 6]
    assert got[2].endpoint_fraction_bonded is None


def test_one_of_tied_largest_is_left_out(spark):
    b, m, parts, s = summary(spark, [(0, 1), (0, 1), (2, 3)], 4)
    rows = graph.cluster_doubles(b, parts, s).join(s.select("case_id", "cluster_id", "is_largest"), ["case_id", "cluster_id"])
    got = {r.scope: r.fraction_mean for r in stats.size_bins(rows).collect()}
    assert got == {"all": 0.25, "exclude_one_largest": 0.0}


def test_moments_of_ties(spark):
    rows = [(1, 2, 3, 2), (1, 9, 3, 2), (1, 20, 1, 0)]
    s = graph.with_largest(spark.createDataFrame(rows, "case_id long, cluster_id long, molecule_count long, bond_count long"))
    r = stats.moments(s).first()
    assert (r.selected_largest_id, r.weighted_excl_one, r.weighted_excl_all_tied, r.largest_tie_count) == (2, 2.5, 1.0, 2)


def test_residual_is_null(spark):
    s = graph.with_largest(spark.createDataFrame([(1, 0, 2, 1)], "case_id long, cluster_id long, molecule_count long, bond_count long"))
    assert stats.moments(s).first().weighted_excl_one is None


@pytest.mark.parametrize("n,four,six", [(3, 9, 6), (4, 36, 96)])
def test_complete_bipartite(spark, n, four, six):
    b = bonds(spark, [(a, n + c) for a in range(n) for c in range(n)])
    assert [motifs.cycle_counts(b, k).first().cycles for k in (4, 6)] == [four, six]


def test_square_with_parallel_bond(spark):
    b = bonds(spark, [(0, 1), (0, 1), (1, 2), (2, 3), (3, 0)])
    counts = motifs.cycle_counts(b, 4).first()
    assert (counts.cycles, counts.edge_cycles) == (1, 2)
    assert motifs.participating(b, 4).first().cycle_bonds == 5


def test_random_graphs_against_brute_force(spark):
    rng = random.Random(27)
    for _ in range(3):
        edges = [(a, 3 + b) for a in range(3) for b in range(3) if rng.random() < 0.6] or [(0, 3)]
        near = {e for a, b in edges for e in ((a, b), (b, a))}
        want = {k: sum(all((p[i], p[(i + 1) % k]) in near for i in range(k)) for p in permutations(range(6), k)) // (2 * k) for k in (4, 6)}
        for k in (4, 6):
            assert motifs.cycle_counts(bonds(spark, edges), k).first().cycles == want[k]


def test_two_core_drops_trees(spark):
    got = cores.two_core(bonds(spark, [(0, 1), (1, 2), (2, 3), (3, 0), (3, 4), (4, 5)])).collect()
    assert {(r.molecule_a, r.molecule_b) for r in got} == {(0, 1), (1, 2), (2, 3), (0, 3)}


def test_stencil_has_24_offsets_and_no_wraparound(spark):
    assert len(spatial.OFFSETS) == 24
    rows = [(0, "A", 0, 0, 0), (5, "B", 1, 0, 0), (9, "B", 0, 2, 0), (13, "B", 3, 0, 0), (17, "B", 1, 1, 1), (21, "B", 7, 0, 0), (25, "A", 0, 0, 1)]
    ends = spark.createDataFrame(rows, "endpoint long, type string, x int, y int, z int")
    got = {(r.endpoint_a, r.endpoint_b) for r in spatial.candidates(ends, 8).collect()}
    brute = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and sum(abs(x - y) for x, y in zip(a[2:], b[2:])) <= 2}
    assert got == brute


def test_empty_network(spark):
    b, m = bonds(spark, [(0, 1)]).where("false"), molecules(spark, 3)
    parts = graph.members(b, m)
    row = graph.network_summary(graph.with_largest(graph.clusters(b, parts))).first()
    assert (row.molecules, row.bonds, row.clusters, row.isolated_molecules) == (3, 0, 3, 3)


def test_violations_are_counted(spark):
    rows = [(1, 0, 0, 100, 0, 25), (1, 1, 0, 101, 0, 25), (1, 5, 8, 4, 2, 1), (1, 6, 16, 24, 4, 6)]
    got = {r.rule: r.bad_count for r in constraints.bond_violations(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {"order": 1, "owner": 0, "type": 1, "numbering": 3, "endpoint_reuse": 1, "multiplicity": 0}


@pytest.mark.parametrize(
    "pairs, n, want",
    [
        ([(0, 1), (0, 1), (1, 2), (2, 3), (3, 0)], 4, {"c4_mol": 1, "c6_mol": 0, "c4_edge": 2, "b4": 5, "b6": 0, "h2": 1, "q4": 0.625, "q_h2": 0.25}),
        ([(0, 1), (1, 2), (2, 3), (3, 0), (1, 4), (4, 5), (5, 0)], 6, {"c4_mol": 2, "c6_mol": 1, "b4": 7, "b6": 6, "q4": round(7 / 12, 9)}),
    ],
)
def test_cycles_of_a_cluster(spark, pairs, n, want):
    b, _, parts, marked = summary(spark, pairs, n)
    doubles = graph.cluster_doubles(b, parts, marked).join(marked.select("case_id", "cluster_id", "is_largest"), ["case_id", "cluster_id"])
    rows = motifs.cluster_cycles(b, parts, doubles).collect()
    assert len(rows) == 1 and {k: rows[0][k] for k in want} == want


def test_hubs_and_large_cases(spark):
    """A hub whose minimum is broadcast, a long chain, and a molecule number beyond a case's range."""
    edges = [(0, k) for k in range(1, 600)] + [(k, k + 1) for k in range(1000, 1100)] + [(599, 1000)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys([*range(1, 600), *range(1000, 1101)], 0)
    near = {(r.a, r.b) for r in components.contracted(spark.createDataFrame(edges, "a long, b long").coalesce(1)).collect()}
    assert near == {(k, 0) for k in got}
    with pytest.raises(Exception, match="molecule 16777216"):
        graph.members(bonds(spark, [(0, 1 << 24)]), molecules(spark, 2)).collect()


def test_a_bond_between_two_clusters_fails(spark):
    parts = spark.createDataFrame([(1, 0, 0), (1, 1, 1)], "case_id long, molecule long, root long")
    with pytest.raises(Exception, match="between two clusters"):
        graph.clusters(bonds(spark, [(0, 1)]), parts).collect()


def test_summary_of_undefined_values(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, None), (2, None)], "condition long, x double")
    got = {r.condition: (r.n, r["mean"], r.sd, r.se) for r in stats.metric_summary(rows, ["condition"], ("x",)).collect()}
    assert got == {1: (1, 1.0, None, None), 2: (0, None, None, None)}


def test_candidate_rules_take_one_pass(spark):
    from meshwork.jobs import queries as jobs

    rows = [(1, 5, 9), (1, 5, 9), (1, 9, 5), (2, 0, 1), *((3, 7, 10 + k) for k in range(25))]
    got = constraints.candidate_violations(spark.createDataFrame(rows, "case_id long, endpoint_a long, endpoint_b long"))
    want = {(1, "order", 1), (1, "crowded", 0), (1, "repeated", 1), (2, "order", 0), (2, "crowded", 0), (2, "repeated", 0), (3, "order", 0), (3, "crowded", 1), (3, "repeated", 0)}
    assert {tuple(r) for r in got.collect()} == want and got.columns == ["case_id", "rule", "bad_count"]
    plan = jobs.queries()["candidate_violations"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]
    assert plan.count("ShuffledHashJoin") == 1 and "SortMergeJoin" not in plan  # candidates are worked out once, their probes not sorted
