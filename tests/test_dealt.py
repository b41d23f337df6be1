"""Frames dealt out by case: joins without guesses of size, components and candidates without rounds or shuffled probes."""

import random

import numpy as np

from meshwork.jobs import queries as network
from meshwork.operators import components, spatial

SMALL = "/root/testdata/sf0.001"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_no_join_is_broadcast_by_an_estimate(spark):
    """frames of 600 MB went to the driver."""
    for conf in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.unset(conf)
    for name in ("greedy_matching", "components_members"):
        assert "BroadcastHashJoin" not in plan_of(network.queries()[name](spark, SMALL))


def test_groups_are_contracted_whole(spark, monkeypatch):
    monkeypatch.setattr(components, "EDGES_AT_ONCE", 40)
    rng = random.Random(5)
    rows = [(g, 1000 * g + rng.randrange(60), 1000 * g + rng.randrange(60)) for g in range(30) for _ in range(rng.choice((1, 5, 35)))]
    got = {(r.a, r.b) for r in components.contracted_groups(spark.createDataFrame(rows, "g long, a long, b long"), "g").collect()}
    want = components.forest(*(np.array([r[k] for r in rows]) for k in (1, 2)))
    assert got == set(zip(*(w.tolist() for w in want)))


def test_candidates_from_half_the_sites(spark):
    """each endpoint went to 24 sites in a shuffle. Pairs as before, beyond the lattice too."""
    rng = random.Random(7)
    sites = rng.sample([(x, y, z) for x in range(-2, 6) for y in range(-2, 6) for z in range(-2, 6)], 200)
    points = [(k % 3, k, rng.choice("AB"), *s) for k, s in enumerate(sites)]
    frame = spark.createDataFrame(points, "case_id long, endpoint long, type string, x int, y int, z int").repartition("case_id")
    found = spatial.candidates(frame, 4, ("case_id",))
    far = lambda p, q: sum(abs(a - b) for a, b in zip(p[3:], q[3:]))
    want = {(p[0], p[1], q[1], far(p, q)) for p in points for q in points if p[0] == q[0] and p[1] < q[1] and p[2] != q[2] and far(p, q) <= 2 and all(0 <= v < 4 for v in q[3:])}
    assert {tuple(r) for r in found.select("case_id", "endpoint_a", "endpoint_b", "distance").collect()} == want and want
    network.queries()["pair_multiplicity"](spark, SMALL)
    assert plan_of(found).count("hashpartitioning") <= 2 and "hashpartitioning(case_id" in plan_of(found) and ", x" not in "".join(p.split(")")[0] for p in plan_of(found).split("hashpartitioning(")[1:])


def test_kept_steps_are_not_dealt_out_again(spark):
    """F8, F13 to F22, F28 to F30: every query dealt the kept bonds, members and clusters out anew."""
    for name in ("cluster_h2", "largest_members", "tied_largest", "size_bins", "cluster_json", "partition_differences", "network_summary"):
        made = network.queries()[name](spark, SMALL)
        plan = plan_of(made)
        assert "Exchange hashpartitioning" not in plan and "REPARTITION" not in plan, name
        assert made.count() > 0
    for name in ("relation_grid", "relation_layout", "bin_comparison", "bin_diagnostics", "bin_plot_rows"):
        plan = plan_of(network.queries()[name](spark, SMALL))
        assert "relation-" in plan and "clusters" not in plan and "members" not in plan, name
    # Six unions of whole tables became sums by case.
    assert plan_of(network.queries()["graph_violations"](spark, SMALL)).count("Union") == 1
    assert plan_of(network.queries()["graph_violations"](spark, SMALL)).count("Scan parquet") <= 8


def test_size_queries_read_kept_cases(spark):
    """F14 to F22: no case is dealt out again, which took 2,000,000 MB at 360 times sf0.1 by projection."""
    for name in ("cluster_h2", "largest_members", "size_bins", "size_relation", "bin_plot_rows", "largest_h2", "bin_diagnostics", "cluster_json", "relation_layout"):
        assert "hashpartitioning(case_id" not in plan_of(network.queries()[name](spark, SMALL)), name


def test_repeated_lines_are_bonds_as_in_the_sql(spark, tmp_path):
    """Lines that tie in order, number and part, of other suppliers, quantities and months; whole repeats are ties of the SQL."""
    import datetime

    import duckdb

    rng = random.Random(11)
    day = lambda k: datetime.datetime(1995, 1 + k % 3, 5)
    lines = [(o, rng.choice((1, 7)), rng.randrange(9), float(rng.randrange(3)), rng.choice((1, 2)), day(rng.randrange(9))) for o in range(0, 40_000, 500) for _ in range(rng.choice((1, 4, 12)))]
    rows = [(o, p, s, n, q, 1.0, 0.0, 0.0, "N", "O", d) for o, p, s, q, n, d in set(lines)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o, o // 500 % 7) for o in range(0, 40_000, 500)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    for name in ("pair_multiplicity", "components_members", "cluster_h2", "partition_differences", "graph_violations"):
        want = con.execute(network.oracle_sql()[name])
        names = [c[0] for c in want.description]
        assert sorted(map(str, map(tuple, network.queries()[name](spark, str(tmp_path)).select(*names).collect()))) == sorted(map(str, want.fetchall())), name


def test_kept_tables_keep_their_buckets(spark, tmp_path):
    """Kept tables are read again as they are dealt out, and made again once their files are gone."""
    from meshwork.sources import storage

    spark.range(10).write.parquet(f"{tmp_path}/t.parquet")
    made = []
    make = lambda: made.append(1) or spark.range(100).selectExpr("id % 7 AS case_id", "id").repartition(8, "case_id")
    network.queries()["h2_fractions"](spark, SMALL)
    for _ in range(2):
        rows = storage.kept(spark, f"file://{tmp_path}", ("t",), "x", make, "case_id")
        assert rows.count() == 100 and "Exchange hashpartitioning" not in plan_of(rows.groupBy("case_id", "id").count())
    assert len(made) == 1
    for path in list(storage.KEPT.values()):
        if "/x-" in path:
            storage.dropped(spark, path)
    assert storage.kept(spark, f"file://{tmp_path}", ("t",), "x", make, "case_id").count() == 100 and len(made) == 2
